"""Language-model scores from an interpolated modified Kneser-Ney bigram model.

The model is counted in Spark. Words of the training texts are hashed; their hashes, cut into
shards by leading bits, become sorted arrays with counts, and a word's id is its rank over
all shards. Bigrams (two ids in one number) are counted in shards of their own and stored as
sorted arrays too. What the smoothing needs of a word, the number of different words before
it and of its followers seen once, twice or more often, is added up from the bigram shards.
All arrays are Arrow files in the folder that driver and executors share. Scoring tasks map
them into memory one shard at a time and look up the distinct words and bigrams of some
documents in sorted order, so no task holds the model and nothing is sent to it.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named, text_of
from usetrail.llm.hashing import LOWER, mix, word_hashes
from usetrail.session import scratch_dir

#: Hash of the token that ends every text, and the words a shard of words holds on average at most.
END = np.uint64(0x9D39247E33776D41)
WORD_SHARD, BIGRAM_SHARD = 1 << 20, 4 << 20
#: Bigrams that begin with one word go to several shards beyond so many occurrences of it.
SLICE = 1 << 18
#: Tokens that one task counts or scores at a time.
TOKENS = 2 << 20
#: A token takes two bytes of text or more, and words are repeated; only the number of shards depends on it.
BYTES_PER_TOKEN, TOKENS_PER_WORD = 2, 16
ADDED = 0.1


class Store:
    """Arrow files of arrays in the shared folder; mapped where it is mounted, read otherwise."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _place(self, name: str) -> tuple[fs.FileSystem, str]:
        parts = urlparse(self.folder)
        if parts.scheme in ("", "file"):
            return fs.LocalFileSystem(use_mmap=True), f"{parts.path}/{name}"
        system, path = fs.FileSystem.from_uri(self.folder)
        return system, f"{path}/{name}"

    def write(self, name: str, **arrays: np.ndarray) -> None:
        """Write under a name of its own first: a task that is run again replaces the whole file."""
        system, path = self._place(name)
        system.create_dir(os.path.dirname(path), recursive=True)
        batch = pa.record_batch({k: pa.array(v) for k, v in arrays.items()})
        started = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(started) as sink, pa.ipc.new_file(sink, batch.schema) as out:
            out.write_batch(batch)
        system.move(started, path)

    def read(self, name: str) -> dict[str, np.ndarray]:
        system, path = self._place(name)
        with system.open_input_file(path) as source:
            batch = pa.ipc.open_file(source).get_batch(0)
            return {k: batch[k].to_numpy(zero_copy_only=False) for k in batch.schema.names}


def packed(values: np.ndarray) -> bytes:
    """Numbers, differences of ascending ones above all, with equal bytes beside each other."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1)


def _ascending(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


BLOCK = "shard long, n long, keys binary, counts binary"


def _blocks(shard: np.ndarray, keys: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """One row per shard that occurs: its keys in ascending order, with their counts."""
    order = np.lexsort((keys, shard))
    shard, keys, counts = shard[order], keys[order], tuple(c[order] for c in counts)
    first = np.flatnonzero(np.diff(shard, prepend=-2))
    rows = [
        (int(shard[a]), b - a, _ascending(keys[a:b]), b"".join(_sized(packed(c[a:b])) for c in counts))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)
    ]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["shard", "n", "keys", "counts"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _sized(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + data


def _added(rows: pa.Table, width: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different keys of all blocks in ascending order, and the sums of their counts."""
    keys, counts = [], [[] for _ in range(width)]
    for n, found, held in zip(rows["n"].to_pylist(), rows["keys"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        keys.append(np.cumsum(unpacked(found, n), dtype=np.uint64))
        at = 0
        for column in counts:
            size = int.from_bytes(held[at : at + 4], "little")
            column.append(unpacked(held[at + 4 : at + 4 + size], n))
            at += 4 + size
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return every, [np.bincount(place, np.concatenate(c), len(every)).astype(np.uint64) for c in counts]


def tokens_of(text: str) -> np.ndarray:
    """Hashes of the words of a text, in lower case, and of its end."""
    return np.append(word_hashes(text.encode().translate(LOWER)), END)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows and their tokens, some documents at a time."""
    rows, tokens, size = [], [], 0
    for batch in batches:
        others = [batch[c].to_pylist() for c in batch.schema.names if c != "text"]
        for n, text in enumerate(batch["text"]):
            rows.append([c[n] for c in others])
            tokens.append(tokens_of(text.as_py()))
            size += len(tokens[-1])
            if size >= TOKENS:
                yield rows, tokens
                rows, tokens, size = [], [], 0
    if rows:
        yield rows, tokens


def discounts(times: list[int]) -> list[float]:
    """What is taken from counts 1, 2 and 3 or more, given how many counts are 1, 2, 3 and 4.

    0.5, 1 and 1.5 where the counts do not tell.
    """
    n1, n2, n3, n4 = times
    if min(times) > 0:
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return [0.5, 1.0, 1.5]


def _less(counts: np.ndarray, taken: list[float]) -> np.ndarray:
    return np.where(counts > 0, counts - np.array([0.0, *taken])[np.minimum(counts, 3).astype(np.int64)], 0.0)


class Model:
    """Sizes and discounts of a trained model, and the look-ups in its arrays."""

    def __init__(self, store: Store, bits: int, sizes: list[int], tokens: int, texts: int, bigram_shards: int) -> None:
        self.store, self.bits, self.tokens, self.texts, self.shards = store, bits, tokens, texts, bigram_shards
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.words = int(self.first[-1])
        self.taken, self.taken_low, self.left_low, self.seen_before = [0.5, 1.0, 1.5], [0.5, 1.0, 1.5], 1.0, 0
        self.start: dict[str, int] = {}
        self.filled: set[int] = set()

    def shard_of_word(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def shard_of_bigram(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bigrams of one first word lie together, of a frequent one in slices by the second."""
        slices = count.astype(np.uint64) // np.uint64(SLICE) + np.uint64(1)
        first, second = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        return (mix(mix(first + np.uint64(1)) + second % slices) % np.uint64(self.shards)).astype(np.int64)

    def look_up(self, hashes: np.ndarray, stats: bool) -> dict[str, np.ndarray]:
        """id (-1: unknown) and counts of ascending word hashes."""
        names = ["count", *(["before", "once", "twice", "more"] if stats else [])]
        out = {"id": np.full(len(hashes), -1, np.int64)} | {c: np.zeros(len(hashes), np.int64) for c in names}
        shard = self.shard_of_word(hashes)
        cut = np.searchsorted(shard, np.arange(len(self.first)))
        for k in np.unique(shard).tolist():
            if self.first[k] == self.first[k + 1]:
                continue
            asked = slice(cut[k], cut[k + 1])
            held = self.store.read(f"stats/{k}" if stats else f"words/{k}")
            at = np.searchsorted(held["keys"], hashes[asked])
            at[at == len(held["keys"])] = 0
            known = held["keys"][at] == hashes[asked]
            out["id"][asked] = np.where(known, self.first[k] + at, -1)
            for c in names:
                out[c][asked] = np.where(known, held[c][at], 0)
        return out

    def bigram_counts(self, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How often ascending bigrams occur in the training texts; `count` is that of their first word."""
        out = np.zeros(len(keys), np.int64)
        shard = self.shard_of_bigram(keys, count)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in self.filled.intersection(shard.tolist()):
            asked = order[cut[k] : cut[k + 1]]
            held = self.store.read(f"bigrams/{k}")
            at = np.searchsorted(held["keys"], keys[asked])
            at[at == len(held["keys"])] = 0
            out[asked] = np.where(held["keys"][at] == keys[asked], held["counts"][at], 0)
        return out

    def bigrams(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the bigrams that end at each token; a text begins after the id beyond all words."""
        before = np.roll(ids, 1)
        before[starts] = self.words
        return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)

    def probability_low(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """Of words by how many different words they follow."""
        known = _less(found["before"], self.taken_low) / max(1, self.seen_before)
        return known + self.left_low / (self.words + 1)

    def left_over(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """The share of a first word's probability that the lower order deals out."""
        taken = sum(d * found[c] for d, c in zip(self.taken, ("once", "twice", "more"), strict=True))
        return np.where(found["count"] > 0, taken / np.maximum(1, found["count"]), 1.0)


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _parts(batches):
            keys, n = np.unique(np.concatenate(tokens), return_counts=True)
            shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
            yield _blocks(shard, keys, n)

    return docs.mapInArrow(words, BLOCK)


def train(texts: DataFrame) -> Model:
    """Count the model over the column `text` (not null) of a table and write it."""
    spark = texts.sparkSession
    store = Store(scratch_dir(spark, "ngrams"))
    held = texts.select("text").agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n_texts, most = held[1], (held[0] or 0) // BYTES_PER_TOKEN + held[1]
    bits = max(0, math.ceil(math.log2(max(1, most / TOKENS_PER_WORD / WORD_SHARD))))

    def words_kept(key: tuple, rows: pa.Table) -> pa.Table:
        keys, (n,) = _added(rows)
        store.write(f"words/{key[0].as_py()}", keys=keys, count=n.astype(np.int64))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n": [len(keys)], "tokens": [int(n.sum())]})

    found = _counted(texts.select("text"), bits).repartition(1 << bits, "shard").groupBy("shard").applyInArrow(words_kept, "shard long, n long, tokens long").collect()
    sizes = [0] * (1 << bits)
    for row in found:
        sizes[row.shard] = row.n
    tokens = sum(row.tokens for row in found)
    model = Model(store, bits, sizes, tokens, n_texts, max(1, math.ceil(tokens / BIGRAM_SHARD)))
    if not tokens:
        return model

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _parts(batches):
            starts = np.cumsum([0, *map(len, tokens[:-1])])
            every, place = np.unique(np.concatenate(tokens), return_inverse=True)
            known = model.look_up(every, False)
            keys, n = np.unique(model.bigrams(known["id"][place], starts), return_counts=True)
            yield _blocks(model.shard_of_bigram(keys, _first_counts(model, keys, known)), keys, n)

    def bigrams_kept(key: tuple, rows: pa.Table) -> pa.Table:
        keys, (n,) = _added(rows)
        store.write(f"bigrams/{key[0].as_py()}", keys=keys, counts=n.astype(np.uint32))
        times = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5]
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        words, place = np.unique(np.concatenate((first, second)), return_inverse=True)
        kind = np.concatenate((np.minimum(n, 3).astype(np.int64), np.zeros(len(n), np.int64)))
        table = np.bincount(place * 4 + kind, minlength=4 * len(words)).reshape(-1, 4)
        inside = words < model.words
        words, table = words[inside], table[inside]
        shard = np.searchsorted(model.first, words, side="right") - 1
        out = _blocks(shard, (words - model.first[shard]).astype(np.uint64), *table.T)
        start = np.bincount(np.minimum(n[first == model.words], 3).astype(np.int64), minlength=4)[1:]
        own = _blocks(np.array([-1]), np.array([key[0].as_py()], np.uint64)).to_pydict()
        own["counts"] = [np.concatenate((times, start)).astype("<i8").tobytes()]
        return pa.Table.from_batches([out, pa.record_batch(own, out.schema)])

    counted = texts.select("text").mapInArrow(bigrams, BLOCK).repartition(model.shards, "shard").groupBy("shard").applyInArrow(bigrams_kept, BLOCK)
    folder = f"{store.folder}/followers"
    counted.write.parquet(folder)
    counted = spark.read.schema(BLOCK).parquet(folder)

    def stats_kept(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[0].as_py()
        keys, sums = _added(rows, 4)
        names, n = ("before", "once", "twice", "more"), sizes[k]
        full = {c: np.zeros(n, np.int64) for c in names}
        for c, s in zip(names, sums, strict=True):
            full[c][keys.astype(np.int64)] = s.astype(np.int64)
        store.write(f"stats/{k}", **store.read(f"words/{k}"), **full)
        times = np.bincount(np.minimum(full["before"], 5), minlength=6)[1:5].tolist()
        three = int((full["before"] >= 3).sum())
        return pa.table({"total": [int(full["before"].sum())], "three": [three], "times": pa.array([times], pa.list_(pa.int64()))})

    low = counted.where("shard >= 0").repartition(1 << bits, "shard").groupBy("shard").applyInArrow(stats_kept, "total long, three long, times array<long>").collect()
    rows = counted.where("shard = -1").select("keys", "counts").collect()
    model.filled = {int(unpacked(r.keys, 1)[0]) for r in rows}
    total = np.sum([np.frombuffer(r.counts, "<i8") for r in rows], axis=0)
    model.taken = discounts(total[:4].tolist())
    model.start = dict(zip(("once", "twice", "more"), total[4:7].tolist(), strict=True))
    times = np.sum([r.times for r in low], axis=0).tolist()
    model.taken_low, model.seen_before = discounts(times), sum(r.total for r in low)
    d = model.taken_low
    model.left_low = (d[0] * times[0] + d[1] * times[1] + d[2] * sum(r.three for r in low)) / model.seen_before
    return model


def _first_counts(model: Model, keys: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """How often the first word of each bigram occurs; `known` lists the words in ascending order of their id."""
    first = (keys >> np.uint64(32)).astype(np.int64)
    have = known["id"] >= 0
    ids, count = known["id"][have], known["count"][have]
    at = np.minimum(np.searchsorted(ids, first), max(0, len(ids) - 1))
    return np.where(first == model.words, model.texts, count[at] if len(ids) else 0)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", *extra) -> DataFrame:
    """doc_id, the columns `extra`, n_tokens, n_known, base_score, score of every row of a table.

    base_score: sum of log10((count + 0.1) / (tokens + 0.1 (words + 1))) over the tokens, the
    end included; score: the model's log10 probability of the text. Null texts are empty:
    their one token is the end. A word the training texts do not have takes the share of the
    one unknown word; after it the lower order alone decides. Without training texts every
    probability is 1. Null ids and repeated rows are scored like others.
    """
    source = docs.select(named(docs, key).cast("long").alias("doc_id"), *extra, text_of(docs, text).alias("text"))
    names = [c for c in source.columns if c != "text"]
    kinds = [pa.int64() if t == "bigint" else pa.bool_() for c, t in source.dtypes if c != "text"]
    scale = model.tokens + ADDED * (model.words + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tokens in _parts(batches):
            size = np.array([len(t) for t in tokens])
            starts = np.concatenate(([0], np.cumsum(size)[:-1]))
            every, place = np.unique(np.concatenate(tokens), return_inverse=True)
            found = model.look_up(every, True) if model.tokens else {"id": np.full(len(every), -1), "count": np.zeros(len(every))}
            base = np.log10((found["count"] + ADDED) / scale)[place]
            chance = np.zeros(len(place))
            if model.tokens:
                left, low = model.left_over(found), model.probability_low(found)
                ids = found["id"][place]
                count = np.roll(found["count"][place], 1)
                share = np.roll(left[place], 1)
                at_start = {k: np.array([v]) for k, v in (model.start | {"count": model.texts}).items()}
                count[starts], share[starts] = model.texts, model.left_over(at_start)[0]
                known = ids >= 0
                known &= np.where(np.isin(np.arange(len(ids)), starts), True, np.roll(known, 1))
                pairs, where = np.unique(model.bigrams(ids, starts)[known], return_inverse=True)
                times = np.zeros(len(ids))
                if len(pairs):
                    times[known] = _less(model.bigram_counts(pairs, _first_counts(model, pairs, found)), model.taken)[where]
                chance = np.log10(times / np.maximum(1, count) + share * low[place])
            yield pa.record_batch(
                [
                    *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)),
                    pa.array(size, pa.int64()),
                    pa.array(np.add.reduceat((found["count"] > 0)[place].astype(np.int64), starts), pa.int64()),
                    pa.array(np.add.reduceat(base, starts), pa.float64()),
                    pa.array(np.add.reduceat(chance, starts), pa.float64()),
                ],
                [*names, "n_tokens", "n_known", "base_score", "score"],
            )

    kept = ", ".join(f"{c} {t}" for c, t in source.dtypes if c != "text")
    return source.mapInArrow(score, f"{kept}, n_tokens long, n_known long, base_score double, score double")


def held_out(docs: DataFrame, key: str = "doc_id"):
    """Whether a document is left out of the training texts: a tenth by a hash of its id, and null ids."""
    return F.pmod(F.crc32(F.coalesce(named(docs, key).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def perplexities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all documents by a model of those not held out, with its token count and the perplexity.

    One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity. An empty table gives no row.
    """
    model = train(docs.where(~held_out(docs, key)).select(text_of(docs, text).alias("text")))
    rows = scored(docs, model, key, text, held_out(docs, key).alias("held_out"))
    return rows.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
