"""Near-dedup and repeated passages against brute force, and hand-made corners."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from usetrail.llm import anchors, graph, minhash, substring, suffix

SCHEMA = "doc_id long, text string, row_key string, doc string, head string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus():
    """Copies, near copies in two densities, shared passages, empties, nulls, repeated rows."""
    rng = random.Random(3)
    rows = []
    base = words(rng, 300)
    passage = words(rng, 60)
    for i in range(40):
        other = list(base)
        for _ in range(i % 7):
            other[rng.randrange(300)] = "x%d" % rng.randrange(1000)
        rows.append((i, " ".join(other)))
    for i in range(40, 80):
        one = words(rng, 50) + passage + words(rng, rng.randrange(80))
        rows.append((i, "\n".join(" ".join(one[j : j + 9]) for j in range(0, len(one), 9))))
    rows += [(80, rows[41][1]), (81, None), (82, ""), (83, " \n\t"), (84, "One two"), (85, "one  TWO"), (86, "a" * 3000)]
    rows += [(87, "é" * 1500), (88, "x " + "ab" * 1200), (89, "ab " * 900), (None, rows[50][1]), (None, None), rows[45], (51, rows[52][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "d", "h") for i, t in corpus()], SCHEMA).repartition(3)


def sets_of(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, docs, width, percent):
    rows = corpus()
    sets = [sets_of(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    group = {}
    for n, (i, _) in enumerate(rows):
        group.setdefault(find(n), []).append(i)
    want = Counter()
    for n, (i, _) in enumerate(rows):
        ids = [x for x in group[find(n)] if x is not None]
        least = min(ids) if ids else None
        want[(i, len(sets[n]), least, i == least)] += 1
    found = minhash.near_duplicates(docs, width, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want


def test_one_document_of_each_group_stays(spark, docs):
    kept = minhash.deduplicated(docs, 3, 85)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and ids[45] == 1 and ids[85] == 0 and ids[84] == 1
    assert all(ids[i] == 1 for i in (81, 82, 83))


def test_neighbours_across_range_cuts_are_found(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "TASK_ROWS", 150)
    few = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "TASK_ROWS", 10**6)
    assert few == {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}


def test_links_inside_a_crowded_family_are_found(spark, monkeypatch):
    """1,600 texts of one template, most pairs just below the threshold, 200 planted ones above."""
    monkeypatch.setattr(minhash, "BLOCK", 300)
    rng = random.Random(11)
    base = words(rng, 300, 10**6)

    def edited(text, n, name):
        out = list(text)
        for at in rng.sample(range(0, 300, 3), n):
            out[at] = f"{name}.{at}"
        return out

    texts = [edited(base, 5, f"a{i}") for i in range(1400)]
    texts += [edited(texts[i], 8, f"b{i}") for i in range(200)]
    rng.shuffle(texts)
    sets = [sets_of(" ".join(t), 3) for t in texts]
    column = {s: n for n, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(column)), np.float32)
    for n, found in enumerate(sets):
        has[n, [column[s] for s in found]] = 1
    shared, size = has @ has.T, has.sum(axis=1)
    linked = np.argwhere(np.triu(100 * shared >= 85 * (size[:, None] + size - shared), 1))
    assert len(linked) >= 150
    links = spark.createDataFrame([(int(a).to_bytes(2), int(b).to_bytes(2)) for a, b in linked], "u binary, v binary")
    want = {n: n for n in range(len(texts))}
    want |= {int.from_bytes(r.node): int.from_bytes(r.root) for r in graph.components(links).collect()}
    table = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()} == want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(200, 200)]
    links = spark.createDataFrame([(bytes([a // 256, a % 256]), bytes([b // 256, b % 256])) for a, b in links], "u binary, v binary")
    found = {(r.node[0] * 256 + r.node[1]): r.root[0] * 256 + r.root[1] for r in graph.components(links.repartition(5)).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)}


def removed_words(rows, window):
    first = {}
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for n in order:
        for s in range(len(split[n]) - window + 1):
            first.setdefault(tuple(split[n][s : s + window]), (rows[n][0], s))
    out = Counter()
    for n, (i, _) in enumerate(rows):
        gone = set()
        for s in range(len(split[n]) - window + 1):
            if first[tuple(split[n][s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = [w for x, w in enumerate(split[n]) if x not in gone]
        out[(i, len(split[n]), len(gone), " ".join(kept))] += 1
    return out


def test_word_repeats(spark, docs):
    rows = [r for r in corpus() if r[0] != 51]  # an id with two texts has no order between them
    found = substring.cleaned(docs.where("doc_id IS NULL OR doc_id <> 51")).collect()
    got = Counter((r.doc_id, r.n_words, sum(x["last"] - x["first"] for x in r.removed), r.kept) for r in found)
    assert got == removed_words(rows, substring.WINDOW)


@pytest.mark.parametrize("groups", [1, 1 << 14])
def test_byte_repeats(spark, docs, groups):
    rows = [(i, (t or "").encode()) for i, t in corpus()]
    times = Counter(d[s : s + 400] for _, d in rows for s in range(len(d) - 399))
    want = Counter()
    for i, d in rows:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - 399):
            if times[d[s : s + 400]] > 1:
                gone[s : s + 400] = True
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        want[(i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    spans = suffix.repeats
    try:
        suffix.repeats = lambda *a, **k: spans(*a, **k, group_bytes=groups)
        found = suffix.cleaned(docs).collect()
    finally:
        suffix.repeats = spans
    got = Counter(
        (r.doc_id, r.n_bytes, sum(x["last"] - x["first"] for x in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in found
    )
    assert got == want


def test_levels_grow_geometrically_and_find_all_repeats():
    rng = np.random.default_rng(1)
    index, rows = suffix.Levels(), np.zeros(4000, anchors.RUN)
    rows["anchor"], rows["content"] = rng.integers(0, 800, 4000), rng.integers(0, 3, 4000)
    rows["doc"] = np.arange(4000)
    found = np.concatenate([index.add(part) for part in np.array_split(rows, 13)])
    times = Counter(zip(rows["anchor"], rows["content"], strict=True))
    want = sorted(int(r["doc"]) for r in rows if times[(r["anchor"], r["content"])] > 1)
    assert sorted(found["doc"].tolist()) == want
    ranks = [rank for rank, _ in index.levels]
    assert ranks == sorted(set(ranks), reverse=True) and len(index.all()) == len(times)


def test_long_documents_are_cut_into_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 6000, dtype=np.uint8).tobytes()
    whole = suffix.runs_of(data, 400, 32)
    monkeypatch.setattr(suffix, "CHUNK", 700)
    parts = suffix.runs_of(data, 400, 32)
    assert whole["n"].sum() == parts["n"].sum() == 6000 - 399
    assert set(whole["anchor"]) == set(parts["anchor"])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert minhash.near_duplicates(none).collect() == []
    assert substring.cleaned(none).collect() == [] and suffix.cleaned(none).collect() == []
