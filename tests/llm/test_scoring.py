"""Language-model scores against a plain count of the whole model."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from usetrail.llm import scoring


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def corpus(n=160):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["É", "Hot", "a.b"]
    rows = []
    for i in range(n):
        body = [words[min(int(rng.expovariate(0.08)), 62)] for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(body) if i % 9 else "hot hot HOT " * 30))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "new words only"), (None, "w1 w2"), rows[4], (4, "w3")]
    rows.append((n + 4, "w1 " * 30000))
    return rows


def discounts(counts):
    n = Counter(min(c, 5) for c in counts)
    if min(n[k] for k in (1, 2, 3, 4)):
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return [0, *d]
    return [0, 0.5, 1.0, 1.5]


def brute(rows):
    left_out = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    single, pairs, starts = Counter(), Counter(), 0
    for (_, text), out in zip(rows, left_out):
        if not out:
            found = tokens(text)
            single.update(found)
            pairs.update(zip(["<s>", *found], found))
            starts += 1
    total, words = sum(single.values()), len(single)
    before, after = Counter(b for _, b in pairs), defaultdict(Counter)
    for (a, _), n in pairs.items():
        after[a][min(n, 3)] += 1
    high, low = discounts(pairs.values()), discounts(before.values())
    seen = sum(before.values())
    rest = sum(low[min(c, 3)] for c in before.values()) / seen if seen else 1.0
    want = Counter()
    for (i, text), out in zip(rows, left_out):
        found = tokens(text)
        base = sum(math.log10((single[t] + 0.1) / (total + 0.1 * (words + 1))) for t in found)
        score = 0.0
        for a, b in zip(["<s>", *found], found):
            p = (before[b] - low[min(before[b], 3)]) / max(1, seen) + rest / (words + 1)
            count = starts if a == "<s>" else single[a]
            if count:
                n = pairs[a, b]
                p = (n - high[min(n, 3)]) / count + p * sum(high[k] * x for k, x in after[a].items()) / count
            score += math.log10(p)
        want[(i, out, len(found), sum(single[t] > 0 for t in found), total, round(base, 6), round(score, 6))] += 1
    return want


@pytest.fixture(params=["whole", "cut"])
def small(request, monkeypatch):
    if request.param == "cut":
        for name, size in (("WORD_SHARD", 8), ("BIGRAM_SHARD", 300), ("SLICE", 50), ("TOKENS", 500)):
            monkeypatch.setattr(scoring, name, size)


def found(table):
    return Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in scoring.perplexities(table).collect()
    )


def test_scores_equal_the_plain_model(spark, small):
    rows = corpus()
    table = spark.createDataFrame([(i, t, "n", True) for i, t in rows], "doc_id long, text string, n_tokens string, held_out boolean")
    assert found(table.repartition(3)) == brute(rows)


def test_no_training_text_and_no_rows(spark):
    table = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = scoring.perplexities(table).collect()
    assert [(r.held_out, r.train_tokens, r.base_score, r.score) for r in rows] == [(True, 0, 0.0, 0.0)] * 2
    assert scoring.perplexities(table.limit(0)).collect() == []


def test_held_out_texts_are_less_surprising_than_to_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = scoring.perplexities(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.97
