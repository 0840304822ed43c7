"""Spelling variants against all pairs of the vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from usetrail.llm import spelling


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    forms, out = {}, Counter()
    found = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[(w, forms[w], root, n[w], len(found[w]), n[forms[w]] if forms[w] else None)] += 1
    return out


def corpus():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdéß÷") for _ in range(rng.randrange(5, 12))) for _ in range(25)]
    words = []
    for stem in stems:
        words += [stem] * 40
        for _ in range(6):
            at = rng.randrange(len(stem))
            kind = rng.randrange(3)
            other = stem[:at] + ("" if kind == 0 else rng.choice("abcÉÿ")) + stem[at + (kind < 2) :]
            words += [other] * rng.choice([4, 5, 7, 40])
    words += ["aaaaaa"] * 3000 + ["aaaaab"] * 500 + ["aaaabb"] * 90 + ["aaabbb"] * 15 + ["aabbbb"] * 5 + ["b" * 300] * 9 + ["b" * 299] * 50
    words += ["Straße"] * 30 + ["STRASSE"] * 6 + ["strasse"] * 5
    rng.shuffle(words)
    cut = [" ".join(words[i : i + 90]) for i in range(0, len(words), 90)]
    rows = [(i, t) for i, t in enumerate(cut)]
    return rows + [(None, cut[0]), (None, None), (7, ""), (3, cut[3]), (900, "x" * 50000), (901, "1 2, 3")]


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_variants_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(spelling, "HELD", 40)
    rows = corpus()
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(table.repartition(3)).collect()
    want = brute(rows)
    assert Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert any(r.form != r.root for r in got if r.form)


def test_one_in_199_runs_is_damaged():
    hit = [(i, run) for i in range(400) for run in ("letter", "spelling") if zlib.crc32(f"{i}:{run}".encode()) % 199 == 0]
    assert hit
    for i, run in hit:
        assert len(spelling.damaged(i, run, zlib.crc32(f"{i}:".encode()))) == len(run) - 1


def test_a_hash_follows_its_edits():
    words = {3: 1, 5: 1, 6: 1}
    held = spelling.Filter(words)
    assert held.blocks[3] == held.blocks[6] == 1 and held.blocks[4] == 0
    one, two = spelling.word_hashes(["abc", "acb"])
    assert one != two


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).collect() == []
