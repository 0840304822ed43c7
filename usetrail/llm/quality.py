"""Quality rules: counted facts of a text, and a hashed n-gram logistic regression.

The classifier learns from labelled documents. A text becomes the relative frequencies of its
hashed word unigrams and bigrams and of its hashed byte trigrams and 5-grams; a logistic
regression over them is fitted on one part of the labelled sample and calibrated (Platt
scaling) on the other. Texts are scored in Arrow batches against a fixed threshold.

A second regression learns the toxic labels, which a few words of an otherwise good text
decide. Its features are the distinct hashed words, each scaled by the square of how much more
(or less) often toxic texts have it (a naive Bayes log ratio), so that words of no consequence
do not drown those few; only its known words are kept, a bounded list.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import SPACES, fresh, named, text_of
from usetrail.llm.hashing import BYTE, LOWER, grams, prefix, segments, word_bounds

#: Buckets of each n-gram family.
BITS = 15
FAMILIES = 4
#: Documents that keep at least this calibrated probability of good quality are kept.
KEEP_FROM = 0.15
#: Documents of at least this calibrated probability of being toxic go; buckets of words (bits), and how many
#: learnt documents must have a word.
TOXIC_FROM, TOXIC_BITS, LEAST_DOCS = 0.3, 20, 5
#: About so many labelled documents are learnt from, chosen by a hash of their id.
SAMPLE = 4000
#: What the learner reads of them at most, in bytes of text.
SAMPLE_BYTES = 64 << 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
FACTS = "n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur at least twice."""
    runs = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(runs)) == len(runs):
        return 0
    times = Counter(runs)
    covered, upto = 0, 0
    for i, run in enumerate(runs):
        if times[run] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def facts(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(data.count(c) for c in SPACES),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def features(data: bytes) -> list[np.ndarray]:
    """Bucket numbers of the n-grams of a text, family by family."""
    raw, start, end = word_bounds(data)
    words = segments(prefix(BYTE[raw]), start, end)
    shift = np.uint64(64 - BITS)
    small = raw.astype(np.uint32)
    tri = small[:-2] | small[1:-1] << 8 | small[2:] << 16 if len(raw) > 2 else small[:0]
    five = (
        (tri[:-2] * np.uint32(0x9E3779B1)) ^ ((small[3:-1] | small[4:] << 8) * np.uint32(0x85EBCA77))
        if len(raw) > 4 else small[:0]
    )
    narrow = np.uint32(32 - BITS)
    return [
        words >> shift,
        grams(words, 2) >> shift,
        tri * np.uint32(0x9E3779B1) >> narrow,
        five * np.uint32(0xC2B2AE3D) >> narrow,
    ]


def margin(data: bytes, weights: np.ndarray, bias: float) -> float:
    """The linear score: each family adds the mean weight of its n-grams."""
    total = bias
    for row, found in zip(weights, features(data), strict=True):
        if len(found):
            total += float(row[found].mean())
    return total


def _sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, feature numbers and relative frequencies of all texts."""
    index, value, start = [], [], [0]
    for data in texts:
        for family, found in enumerate(features(data)):
            at, n = np.unique(found, return_counts=True)
            index.append((at + np.asarray(family << BITS, at.dtype)).astype(np.int32))
            value.append((n / max(1, len(found))).astype(np.float32))
        start.append(start[-1] + sum(len(x) for x in index[-FAMILIES:]))
    return np.array(start), np.concatenate(index), np.concatenate(value)


def fit(texts: list[bytes], good: np.ndarray, epochs: int = 5, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights per family and bucket, and bias, by AdaGrad; both classes weigh the same."""
    start, index, value = _sparse(texts)
    weight, speed = np.zeros(FAMILIES << BITS), np.full(FAMILIES << BITS, 1e-8)
    bias, bias_speed = 0.0, 1e-8
    share = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum())) * len(good)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(texts)):
            at, x = index[start[i] : start[i + 1]], value[start[i] : start[i + 1]]
            z = bias + float(weight[at] @ x)
            slope = share[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[i])
            step = slope * x
            speed[at] += step * step
            weight[at] -= rate * step / np.sqrt(speed[at])
            bias_speed += slope * slope
            bias -= 0.1 * rate * slope / np.sqrt(bias_speed)
    return weight.reshape(FAMILIES, -1), bias


def calibrate(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        slope = np.array([((p - target) * z).sum() + a - 1, (p - target).sum()])
        bend = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def word_buckets(data: bytes) -> np.ndarray:
    """Buckets of the distinct words of a text, in lower case."""
    raw, start, end = word_bounds(data.translate(LOWER))
    return np.unique(segments(prefix(BYTE[raw]), start, end) >> np.uint64(64 - TOXIC_BITS)).astype(np.int64)


def toxic_margin(data: bytes, index: np.ndarray, weight: np.ndarray, bias: float) -> float:
    """The linear score of the words that are known (`index`, ascending), by the root of their number."""
    found = word_buckets(data)
    at = np.minimum(np.searchsorted(index, found), max(0, len(index) - 1))
    known = at[index[at] == found] if len(index) else at[:0]
    return bias + float(weight[known].sum()) / max(1, len(known)) ** 0.5


def fit_toxic(texts: list[bytes], toxic: np.ndarray, epochs: int = 5, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray, float]:
    """Known buckets, their weights and the bias, by AdaGrad on log-ratio features; both classes weigh the same."""
    found = [word_buckets(t) for t in texts]
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    with_word = np.zeros((2, 1 << TOXIC_BITS))
    for at, is_toxic in zip(found, toxic, strict=True):
        with_word[int(is_toxic)][at] += 1
    ratio = np.log((with_word[1] + 1) / (n1 + 2)) - np.log((with_word[0] + 1) / (n0 + 2))
    index = np.flatnonzero(with_word.sum(axis=0) >= LEAST_DOCS)
    scale = np.sign(ratio[index]) * ratio[index] ** 2
    rows = [np.searchsorted(index, np.intersect1d(at, index, assume_unique=True)) for at in found]
    weight, speed = np.zeros(len(index)), np.full(len(index), 1e-8)
    bias, bias_speed = 0.0, 1e-8
    share = np.where(toxic, 0.5 / n1, 0.5 / n0) * len(toxic)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            x = scale[at] / max(1, len(at)) ** 0.5
            slope = share[i] * (1 / (1 + np.exp(-np.clip(bias + weight[at] @ x, -30, 30))) - toxic[i])
            step = slope * x
            speed[at] += step * step
            weight[at] -= rate * step / np.sqrt(speed[at])
            bias_speed += slope * slope
            bias -= 0.1 * rate * slope / np.sqrt(bias_speed)
    return index, weight * scale, bias


def _parts(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on and rows to calibrate on; all rows for both where a part lacks a class."""
    fold = np.arange(len(labels)) % 4 == 0
    if any(not part.any() or part.all() for part in (labels[fold], labels[~fold])):
        return np.arange(len(labels)), np.arange(len(labels))
    return np.flatnonzero(~fold), np.flatnonzero(fold)


MODEL = "weights binary, bias double, a double, b double, words binary, word_weights binary, word_bias double, word_a double, word_b double"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fit on about `sample` labelled documents; None if neither label has examples of both classes.

    The sample follows from a hash of the document id. Ids with several labels count as bad
    or toxic if any of them says so; null ids and null labels teach nothing. The sampled rows
    meet in one task, which reads at most SAMPLE_BYTES of text; the model is 2**BITS numbers
    per n-gram family and the known words. A table of labels without `toxic` teaches quality alone.
    """
    toxic = F.max("toxic") if "toxic" in labels.columns else F.lit(None)
    known = (
        labels.where(named(labels, "doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), toxic.cast("long").alias("toxic"))
        .where("quality IS NOT NULL OR toxic IS NOT NULL")
    )
    share = sample / max(1, known.count())

    def chosen(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(F.lit(5), df["doc_id"].cast("long")), F.lit(1 << 30)) < int(share * (1 << 30)))

    texts = chosen(docs.select("doc_id", text_of(docs).alias("text"))).where("text <> ''")
    rows = texts.join(chosen(known), "doc_id").select(
        F.xxhash64(F.lit(6), "doc_id", "text").alias("order"), "text", "quality", "toxic"
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, text, quality, is_toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size < SAMPLE_BYTES:
                    held.append((text.encode(), quality, is_toxic))
                    size += len(held[-1][0])
        model: dict = dict.fromkeys(x.split(" ")[0] for x in MODEL.split(", "))
        told = [(t, q == 1) for t, q, _ in held if q is not None]
        data, good = [t for t, _ in told], np.array([g for _, g in told], bool)
        if good.any() and not good.all():
            part, rest = _parts(good)
            weights, bias = fit([data[i] for i in part], good[part])
            a, b = calibrate(np.array([margin(data[i], weights, bias) for i in rest]), good[rest])
            model |= {"weights": weights.astype(np.float32).tobytes(), "bias": bias, "a": a, "b": b}
        told = [(t, x == 1) for t, _, x in held if x is not None]
        data, bad = [t for t, _ in told], np.array([x for _, x in told], bool)
        if bad.any() and not bad.all():
            part, rest = _parts(bad)
            index, weight, bias = fit_toxic([data[i] for i in part], bad[part])
            a, b = calibrate(np.array([toxic_margin(data[i], index, weight, bias) for i in rest]), bad[rest])
            model |= {"words": index.tobytes(), "word_weights": weight.tobytes(), "word_bias": bias, "word_a": a, "word_b": b}
        if model["weights"] is not None or model["words"] is not None:
            kinds = {"binary": pa.binary(), "double": pa.float64()}
            fields = [x.split(" ") for x in MODEL.split(", ")]
            yield pa.record_batch([pa.array([model[c]], kinds[k]) for c, k in fields], [c for c, _ in fields])

    model = rows.repartition(1).sortWithinPartitions("order", "text").mapInArrow(learn, MODEL).first()
    return None if model is None else model.asDict()


def judged(docs: DataFrame, model: dict | None, keep_from: float = KEEP_FROM, text: str = "text") -> Column:
    """Facts and verdict of each text as one struct column.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability (of
    good quality) and toxicity (both null without a model), kept: neither base_failed nor below
    keep_from nor of TOXIC_FROM or more. Null and empty texts have no words, so they fail.
    Without a model the facts alone decide.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or {})
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def chances(margins: list[float], a: float, b: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a * np.array(margins) + b, -30, 30)))

    @F.arrow_udf(f"struct<{FACTS}, base_failed: boolean, probability: double, toxicity: double, kept: boolean>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = [facts(t) for t in texts]
            bad = [failed(f[0], f[4]) for f in found]
            good: list[float | None] = [None] * len(texts)
            toxic: list[float | None] = [None] * len(texts)
            if model.get("weights"):
                weights = np.frombuffer(bytes(model["weights"]), np.float32).reshape(FAMILIES, -1)
                good = list(chances([margin(t.encode(), weights, model["bias"]) for t in texts], model["a"], model["b"]))
            if model.get("words"):
                index, weight = np.frombuffer(bytes(model["words"]), np.int64), np.frombuffer(bytes(model["word_weights"]))
                margins = [toxic_margin(t.encode(), index, weight, model["word_bias"]) for t in texts]
                toxic = list(chances(margins, model["word_a"], model["word_b"]))
            kept = [
                not x and (p is None or p >= keep_from) and (t is None or t < TOXIC_FROM)
                for x, p, t in zip(bad, good, toxic, strict=True)
            ]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 5
            yield pa.StructArray.from_arrays(
                [*columns, pa.array(bad, pa.bool_()), pa.array(good, pa.float64()), pa.array(toxic, pa.float64()),
                 pa.array(kept, pa.bool_())],
                [*names, "base_failed", "probability", "toxicity", "kept"],
            )

    return scored(text_of(docs, text))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns as they are."""
    (verdict,) = fresh(docs, "verdict")
    marked = docs.withColumn(verdict, judged(docs, train(docs, labels)))
    return marked.where(f"{verdict}.kept").drop(verdict)
