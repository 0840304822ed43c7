"""The whole pipeline against a plain version of its stages on a small corpus."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from usetrail.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string"
WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus():
    rng = random.Random(17)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [" ".join(prose(30)), " ".join(prose(12)), "Short item here", None, ""]
    rows = []
    for i in range(30):
        body = prose(rng.randrange(40, 90))
        rows.append((i, " ".join(body)))
        if i % 3 == 0:
            rows.append((100 + i, " ".join([*body[:-1], "changed"])))  # near copy
        if i % 5 == 0:
            rows.append((200 + i, " ".join(body)))  # exact copy
        if i % 7 == 0:  # too far to be one
            rows.append((300 + i, " ".join(w if n % 4 else f"x{rng.randrange(9999)}" for n, w in enumerate(body))))
    rows += [(400 + k, " ".join([*prose(20), *items[0].split()[k : k + 9 + k % 2], *prose(20)])) for k in range(6)]
    rows += [(410, f"{' '.join(prose(30))} {items[1].upper()}"), (411, f"{' '.join(prose(30))}, short, ITEM here!")]
    rows += [(420, f"{' '.join(prose(30))} password = hunter2hunter2 {' '.join(prose(5))} AKIA{'Q7' * 9}"), (421, f"{' '.join(prose(15))} <|endoftext|> end")]
    rows += [(430, "few words"), (431, "one two three four five " * 9), (432, None), (433, ""), (434, " \n\t"), (None, " ".join(prose(25))), (None, None)]
    rows += [rows[0], rows[0]]
    rng.shuffle(rows)
    return rows, items


def plain(rows, items):
    """(doc_id, text) of what comes to packing."""
    left = []
    for i, text in rows:
        words = re.findall(WORD, text or "")
        times = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {k + j for k in range(len(words) - 4) if times[tuple(words[k : k + 5])] > 1 for j in range(5)}
        if len(words) >= 10 and 100 * len(again) <= 20 * len(words):
            left.append((i, text))
    left = list(dict.fromkeys(left))
    sets = []
    for _, text in left:
        w = re.findall(WORD, lower(text))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for n, row in enumerate(left):
        groups.setdefault(find(n), []).append(row)
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    windows = set()
    for item in items:
        w = re.findall(ITEM_WORD, lower(item or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def hit(text):
        w = re.findall(ITEM_WORD, lower(text))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    secret = re.compile(r"password = \S+|AKIA[A-Z0-9]{16,}")
    return Counter((i, secret.sub("[SECRET]", t)) for i, t in left if not hit(t))


def written(spark, folder, rows, items):
    shown = [(i, t, "en", "s", None if t is None else len(t), "k") for i, t in rows]
    spark.createDataFrame(shown, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_equals_the_plain_stages(spark, tmp_path):
    rows, items = corpus()
    written(spark, tmp_path, rows, items)
    made = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for (i, text), n in plain(rows, items).items():
        want[(i, np.array([*made.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes())] += n
    pieces, used = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = Counter((i, b"".join(ids for _, ids in sorted(parts))) for i, parts in pieces.items())
    assert got == want and len(want) > 25
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "few words"), (1, "few words")]])
def test_run_on_tables_with_nothing_to_keep(spark, tmp_path, rows):
    written(spark, tmp_path, rows, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
