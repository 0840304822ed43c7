"""Grouping of spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted in Spark. A blocked Bloom filter per word length holds it; together
the filters have a bounded size, so they go to all tasks (beyond the bound they let more
through, and the join still decides). Every word generates its edits, one code point deleted
or replaced, as rolling hashes without making the strings; insertions are the deletions of
the longer word. Only edits that the filter of their length lets pass become strings and are
shuffled to an exact join with the vocabulary, which removes the false positives.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named, table_written, text_of
from usetrail.llm.hashing import UNBASE, mix, powers
from usetrail.session import scratch_dir

#: Words, what is folded in them, and one in how many is misspelt.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {c: c + 32 for c in range(65, 91)}
DAMAGED = 199
LEAST_LETTERS, LEAST_TIMES, RATIO = 6, 5, 5
#: Different words that a task counts before it hands them on.
HELD = 400_000
#: Bits of a block, bits of filter per word, tests per word, and blocks of all lengths together at most (64 MB).
BLOCK_BITS, WORD_BITS, TESTS, MOST_BLOCKS = 512, 16, 6, 1 << 20
#: Lengths beyond share the last filter; edits that are probed at a time.
LAST_LENGTH, PROBES = 40, 1 << 20
#: Words whose edits one task makes.
TASK_WORDS = 20_000
#: Each form is RATIO times as frequent, so this many doublings follow every chain of counts below 2**63.
DOUBLINGS = 5


def damaged(doc_id: int | None, run: str, start: int) -> str:
    """The run as it counts: one in DAMAGED loses a code point. `start` is the crc32 of the id and a colon."""
    found = zlib.crc32(run.encode(), start)
    if found % DAMAGED:
        return run
    at = found % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: words of enough letters and occurrences, counted over whole texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, body in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(RUN.findall(body.as_py().translate(FOLD))).items():
                    if len(run) >= LEAST_LETTERS:
                        word = damaged(doc_id, run, start)
                        if len(word) >= LEAST_LETTERS:
                            held[word] += n
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    source = docs.select(named(docs, key).cast("string").alias("doc_id"), text_of(docs, text).alias("text"))
    words = source.mapInArrow(counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


def _spread(points: np.ndarray) -> np.ndarray:
    return mix(points + np.uint64(0x51ED270B))


def word_hashes(words: list[str]) -> np.ndarray:
    """Polynomial hashes of words of one length."""
    points = _points(words)
    return np.sum(_spread(points) * powers(points.shape[1]), axis=1, dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of the words of each length."""
    held: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        held.setdefault(len(word), []).append(i)
    yield from held.values()


class Filter:
    """Blocked Bloom filters of all lengths in one array; a length has a run of blocks."""

    def __init__(self, words_of_length: dict[int, int]) -> None:
        wanted = {k: max(1, -(-n * WORD_BITS // BLOCK_BITS)) for k, n in sorted(words_of_length.items())}
        scale = min(1.0, MOST_BLOCKS / max(1, sum(wanted.values())))
        self.blocks = np.zeros(LAST_LENGTH + 1, np.uint64)
        for k, n in wanted.items():
            self.blocks[k] = max(1, int(n * scale))
        self.first = np.concatenate(([0], np.cumsum(self.blocks)[:-1])).astype(np.uint64)
        self.bits = np.zeros(0, np.uint64)

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and the value its bits in the block come from."""
        spread = mix(hashes)
        k = min(length, LAST_LENGTH)
        block = ((spread >> np.uint64(32)) * self.blocks[k]) >> np.uint64(32)
        return block + self.first[k], mix(spread ^ np.uint64(0xA0761D6478BD642F))

    def passed(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Places of the hashes that may be of words of that length."""
        k = min(length, LAST_LENGTH)
        if not self.blocks[k]:
            return np.zeros(0, np.int64)
        block, value = self.places(hashes, length)
        left = np.arange(len(hashes))
        for test in range(TESTS):
            bit = value[left] >> np.uint64(9 * test) & np.uint64(BLOCK_BITS - 1)
            word = self.bits[block[left] * np.uint64(BLOCK_BITS // 64) + (bit >> np.uint64(6))]
            left = left[(word >> (bit & np.uint64(63)) & np.uint64(1)) == 1]
        return left


def filter_of(words: DataFrame) -> Filter:
    """The filter of a vocabulary (word, n); parts of it are filled in tasks, at most 64 MB meet on the driver."""
    size = F.least(F.length("word"), F.lit(LAST_LENGTH))
    out = Filter({r.size: r.n for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()})
    per_part = 1 << 12

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            rows = [out.places(word_hashes([words[i] for i in at]), len(words[at[0]])) for at in by_length(words)]
            if rows:
                block, value = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.record_batch(
                    [pa.array((block // np.uint64(per_part)).astype(np.int64)), pa.array((block % np.uint64(per_part)).astype(np.int32)),
                     pa.array(value.view(np.int64))], ["part", "block", "value"],
                )

    def filled(key: tuple, rows: pa.Table) -> pa.Table:
        block, value = rows["block"].to_numpy().astype(np.int64), rows["value"].to_numpy().view(np.uint64)
        bits = np.zeros(per_part * BLOCK_BITS // 64, np.uint64)
        for test in range(TESTS):
            bit = value >> np.uint64(9 * test) & np.uint64(BLOCK_BITS - 1)
            at = block * (BLOCK_BITS // 64) + (bit >> np.uint64(6)).astype(np.int64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (bit & np.uint64(63)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    placed_rows = words.select("word").mapInArrow(placed, "part long, block int, value long")
    parts = -(-int(out.blocks.sum()) // per_part)
    bits = np.zeros((parts, per_part * BLOCK_BITS // 64), np.uint64)
    for row in placed_rows.groupBy("part").applyInArrow(filled, "part long, bits binary").collect():
        bits[row.part] = np.frombuffer(row.bits, np.uint64)
    out.bits = bits.reshape(-1)
    return out


def edits_passed(words: list[str], alphabet: np.ndarray, held: Filter) -> Iterator[tuple[int, str]]:
    """The edits of words of one length, one code point deleted or replaced, that the filter lets pass.

    Yields the place of the word and the edit.
    """
    points = _points(words)
    n, power = points.shape[1], powers(points.shape[1])
    terms, letters = _spread(points) * power, _spread(alphabet)
    upto = np.concatenate((np.zeros((len(words), 1), np.uint64), np.cumsum(terms, axis=1)), axis=1)
    if n > LEAST_LETTERS:
        # Deleting the first of a run of equal code points gives the same as deleting the others.
        row, at = np.nonzero(np.concatenate((np.ones((len(words), 1), bool), points[:, 1:] != points[:, :-1]), axis=1))
        shorter = upto[row, at] + (upto[row, -1] - upto[row, at + 1]) * UNBASE
        for k in held.passed(shorter, n - 1).tolist():
            yield int(row[k]), words[row[k]][: at[k]] + words[row[k]][at[k] + 1 :]
    wide = min(n, max(1, PROBES // max(1, len(alphabet))))
    for a in range(0, len(words), high := max(1, PROBES // max(1, wide * len(alphabet)))):
        for b in range(0, n, wide):
            part = (slice(a, a + high), slice(b, b + wide))
            other = (upto[part[0], -1:] - terms[part])[:, :, None] + letters * power[part[1], None]
            for place in held.passed(other.reshape(-1), n).tolist():
                row, at, letter = np.unravel_index(place, other.shape)
                if alphabet[letter] != points[a + row, b + at]:
                    word = words[a + row]
                    yield int(a + row), word[: b + at] + chr(int(alphabet[letter])) + word[b + at + 1 :]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of a vocabulary (word, n) that differ by one edit, both ways round."""
    letters = [r.letter for r in words.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect()]
    alphabet = np.array(sorted(ord(x) for x in letters if x), np.uint64)
    sent = words.sparkSession.sparkContext.broadcast(filter_of(words))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, times = batch["word"].to_pylist(), batch["n"].to_pylist()
            rows = [
                (edit, every[at[i]], times[at[i]], len(edit) < len(every[at[i]]))
                for at in by_length(every) for i, edit in edits_passed([every[i] for i in at], alphabet, sent.value)
            ]
            if rows:
                kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
                names = ["near", "word", "n", "shorter"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    tasks = -(-words.count() // TASK_WORDS) or 1
    positives = words.repartition(tasks, "word").mapInArrow(probed, "near string, word string, n long, shorter boolean")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = positives.join(known, "near")
    # A deletion is found from the longer word only, a replacement from either.
    ends = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.when(F.col("shorter"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))),
    )
    return pairs.select(F.explode(ends).alias("p")).where("p IS NOT NULL").select("p.*")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary.

    form: the near word of largest n (the first in code-point order among equals) if it is
    RATIO times as frequent or more; root: where the chain of forms ends. Null and empty texts
    have no words, null ids count as empty, repeated rows count each time; an empty table
    gives no row.
    """
    folder = scratch_dir(docs.sparkSession, "spelling")
    words = table_written(vocabulary(docs, key, text), f"{folder}/words")
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    ).select("word", "n_near", F.when(-F.col("best.n") >= RATIO * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.n")).alias("form_n"))).alias("f"))
    found = table_written(best, f"{folder}/near")
    links = table_written(found.where("f IS NOT NULL").select("word", F.col("f.form").alias("root")), f"{folder}/0")
    for turn in range(1, DOUBLINGS + 1):
        next_ = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = table_written(links.join(next_, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ), f"{folder}/{turn}")
        moved = not links.where("moved").isEmpty()
        links = links.select("word", "root")
        if not moved:
            break
    return words.join(found, "word", "left").join(links, "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.form_n").alias("form_n"),
    )
