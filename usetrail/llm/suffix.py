"""Suffix-array dedup of bytes with a logarithmic index family.

Suffixes are sampled at winnowed anchors and ordered by (hash of the bytes the suffix begins
with, hash of all bytes its windows span): a sparse suffix array. The order is cut into
groups by its leading hash. In each group the documents come in batches; a batch's suffix
array is merge-scanned against the existing levels, where equal neighbours are long matches,
then becomes a level itself, and levels of equal rank merge into one of the next rank.
Suffixes that share an anchor but differ around it are compared in blocks of windows: windows
of a block share the bytes in the middle, so a block is their hash and the bytes on both
sides, from which every window's hash follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.anchors import (
    CHUNK, FOUND, NO_ID, RUN, SCATTERED, SPAN, choices, found, gathered, group_count, joined_spans, keyed, mask,
    of_documents, scattered, spans_of,
)
from usetrail.llm.common import table_written
from usetrail.llm.hashing import BASE, BYTE, mix, prefix, segments
from usetrail.session import scratch_dir

WINDOW, SEED = 400, 32
BATCHES = 8
BLOCK = 32
GROUP_BYTES = 8 << 20
#: Windows of one block: hash of the shared middle, document, first byte of the block's first
#: window, the windows that count, whether they only serve comparison, bytes on both sides.
PIECE = np.dtype(
    [("middle", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<i4"), ("first", "u1"), ("last", "u1"), ("known", "u1"),
     ("left", "u1", BLOCK - 1), ("right", "u1", BLOCK - 1)]
)


def runs_of(data: bytes, window: int, seed: int) -> np.ndarray:
    """The runs of one document, without its key."""
    raw = np.frombuffer(data, np.uint8)
    parts = []
    for base in range(0, max(0, len(raw) - window + 1), CHUNK):
        running = prefix(BYTE[raw[base : base + CHUNK + window - 1]])
        at = np.arange(len(running) - seed)
        seeds = segments(running, at, at + seed)
        anchor, lo, hi = choices(seeds, window - seed + 1)
        rows = np.zeros(len(lo), RUN)
        rows["anchor"], rows["content"] = seeds[anchor], segments(running, lo, hi + window)
        rows["lo"], rows["n"] = base + lo, hi - lo + 1
        parts.append(rows)
    return np.concatenate(parts) if parts else np.zeros(0, RUN)


def collapsed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row per (anchor, content), `many` if it stands for several; and all rows of those.

    Rows that already stood for several are settled and not listed again.
    """
    rows = rows[np.lexsort((rows["lo"], rows["row"], rows["doc"], rows["content"], rows["anchor"]))]
    if not len(rows):
        return rows, rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["content"][1:] != rows["content"][:-1])
    group = np.cumsum(new) - 1
    several = (np.bincount(group) > 1) | (np.bincount(group, rows["many"]) > 0)
    fresh = several[group] & (rows["many"] == 0)
    one = rows[new].copy()
    one["many"] = several
    return one, rows[fresh]


class Levels:
    """Suffix arrays of geometrically growing sizes."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    def add(self, batch: np.ndarray) -> np.ndarray:
        """Merge-scan a batch against every level; the suffixes found to be repeated by that."""
        array, settled = collapsed(batch)
        out = [settled]
        known = np.zeros(len(array), bool)
        for _, level in self.levels:
            both = np.concatenate((level["content"], array["content"]))
            order = np.lexsort((np.arange(len(both)), both, np.concatenate((level["anchor"], array["anchor"]))))
            anchors = np.concatenate((level["anchor"], array["anchor"]))[order]
            twin = (anchors[1:] == anchors[:-1]) & (both[order][1:] == both[order][:-1])
            old, new = order[:-1][twin], order[1:][twin] - len(level)
            out += [level[old][level["many"][old] == 0], array[new][array["many"][new] == 0]]
            level["many"][old] = 1
            known[new] = True
        array = array[~known]
        rank = 0
        while self.levels and self.levels[-1][0] <= rank:
            array, _ = collapsed(np.concatenate((self.levels.pop()[1], array)))
            rank += 1
        self.levels.append((rank, array))
        return np.concatenate(out)

    def all(self) -> np.ndarray:
        return collapsed(np.concatenate([x for _, x in self.levels]))[0] if self.levels else np.zeros(0, RUN)


def pieces_of(data: bytes, spans: list[tuple[int, int, bool]], window: int, seed: int) -> np.ndarray:
    """Blocks of the windows lo..hi of a document, cut at fixed distances from their anchor."""
    raw = np.frombuffer(data, np.uint8)
    parts = []
    for lo, hi, known in spans:
        begin = max(0, lo - BLOCK)
        text = raw[begin : hi + window + BLOCK]
        running = prefix(BYTE[text])
        at = np.arange(lo - begin, hi - begin + window - seed + 1)
        seeds = segments(running, at, at + seed)
        anchor = lo + int(choices(seeds, window - seed + 1)[0][0])
        block = np.arange((lo - anchor) // BLOCK, (hi - anchor) // BLOCK + 1)
        start = anchor + block * BLOCK
        rows = np.zeros(len(block), PIECE)
        rows["start"], rows["known"] = start, known
        rows["first"], rows["last"] = np.maximum(lo - start, 0), np.minimum(hi - start, BLOCK - 1)
        rows["middle"] = segments(running, start + BLOCK - 1 - begin, start + window - begin)
        side = np.arange(BLOCK - 1)
        for name, place in (("left", start[:, None] + side), ("right", start[:, None] + window + side)):
            inside = (place >= lo) & (place < hi + window)
            rows[name] = np.where(inside, text[np.clip(place - begin, 0, len(text) - 1)], 0)
        parts.append(rows)
    return np.concatenate(parts) if parts else np.zeros(0, PIECE)


def repeated_windows(rows: np.ndarray) -> np.ndarray:
    """Spans of the windows, other than known ones, whose bytes occur in another piece."""
    if not len(rows):
        return np.zeros(0, SPAN)
    hashes = np.empty((len(rows), BLOCK), np.uint64)
    running = np.zeros(len(rows), np.uint64)
    for j in range(BLOCK - 1, -1, -1):  # the left side from byte j on
        hashes[:, j] = running
        if j:
            running = running * BASE + BYTE[rows["left"][:, j - 1]]
    running = np.zeros(len(rows), np.uint64)
    for j in range(BLOCK):  # the right side up to byte j
        hashes[:, j] = mix(rows["middle"] ^ mix(hashes[:, j] + np.uint64(j)) ^ mix(running ^ np.uint64(0xA5A5 + j)))
        if j < BLOCK - 1:
            running = running * BASE + BYTE[rows["right"][:, j]]
    column = np.arange(BLOCK)
    real = (column >= rows["first"][:, None]) & (column <= rows["last"][:, None])
    row, at = np.nonzero(real)
    value = hashes[row, at]
    order = np.argsort(value)
    value = value[order]
    twin = np.zeros(len(value), bool)
    twin[1:] = value[1:] == value[:-1]
    twin[:-1] |= twin[1:]
    row, at = row[order][twin], at[order][twin]
    open_ = rows["known"][row] == 0
    row, at = row[open_], at[open_]
    return joined_spans(rows["doc"][row], rows["row"][row], rows["start"][row] + at)


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text",
            group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc, row, at: spans of windows of `window` bytes that also start anywhere else.

    Repeated rows are documents of their own, so each repeats the other. Tasks settle what
    repeats among their own documents before anything is shuffled and send one record on.
    """
    folder = scratch_dir(docs.sparkSession, "suffix")
    texts, groups = keyed(docs, key, text), group_count(docs, group_bytes, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, row, body in zip(batch["doc"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True):
                rows = runs_of(body.as_py().encode(), window, seed)
                rows["doc"], rows["row"] = doc, row
                parts.append(rows)
            if parts:
                one, settled = collapsed(np.concatenate(parts))
                yield from scattered(one, one["anchor"], groups, spans_of(settled))

    def index(group: pa.Table) -> pa.Table:
        rows, levels = gathered(group, "rows", RUN), Levels()
        batch = mix(rows["doc"].astype(np.uint64) + rows["row"]) % np.uint64(BATCHES)
        settled = [levels.add(rows[batch == b]) for b in range(BATCHES)]
        array = levels.all()
        at, n = np.unique(array["anchor"], return_counts=True)
        array = array[np.repeat(n > 1, n)] if len(at) else array
        done = np.concatenate((gathered(group, "done", SPAN), *map(spans_of, settled)))
        single = array["many"] == 0
        return pa.concat_tables([found(0, done), found(1, spans_of(array[single])), found(2, spans_of(array[~single]))])

    runs = texts.mapInArrow(scan, SCATTERED).groupBy("group").applyInArrow(index, FOUND)
    runs = table_written(runs, f"{folder}/runs")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            columns = (batch["doc"].to_pylist(), batch["row"].to_pylist(), batch["text"], batch["at"].to_pylist())
            for doc, row, body, at in zip(*columns, strict=True):
                spans = [((x & ~KNOWN) >> 32, x & 0xFFFFFFFF, bool(x & KNOWN)) for x in sorted(set(at))]
                rows = pieces_of(body.as_py().encode(), spans, window, seed)
                rows["doc"], rows["row"] = doc, row
                parts.append(rows)
            if parts:
                rows = np.concatenate(parts)
                yield from scattered(rows, rows["middle"], groups, np.zeros(0, SPAN))

    def compare(group: pa.Table) -> pa.Table:
        return found(0, repeated_windows(gathered(group, "rows", PIECE)))

    opened = runs.where("kind > 0").select(
        "doc", "row", F.when(F.col("kind") == 2, F.col("at").bitwiseOR(F.lit(KNOWN))).otherwise(F.col("at")).alias("at")
    )
    opened = of_documents(texts, opened, "inner")
    more = opened.mapInArrow(pieces, SCATTERED).groupBy("group").applyInArrow(compare, FOUND)
    return runs.where("kind = 0").union(table_written(more, f"{folder}/windows")).select("doc", "row", "at")


#: Marks spans that only serve comparison.
KNOWN = 1 << 63 >> 1
CLEANED = "struct<n_bytes: long, removed: array<struct<first: long, last: long>>, kept: binary>"


def cleaned(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (half-open byte runs), kept (the other bytes).

    One row per input row; null texts are empty. `kept` is bytes, since a cut may fall
    inside a character.
    """
    texts = keyed(docs, key, text)
    spans = repeats(docs, window, seed, key, text)
    kind = pa.struct([("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary())])

    @F.arrow_udf(CLEANED)
    def clean(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for body, at in zip(bodies, spans.to_pylist(), strict=True):
            data, removed, kept = body.as_py().encode(), [], None
            if at:
                gone = mask(at, len(data), window)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                removed = [{"first": int(a), "last": int(b)} for a, b in edge.reshape(-1, 2)]
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append({"n_bytes": len(data), "removed": removed, "kept": data if kept is None else kept})
        return pa.array(out, kind)

    joined = of_documents(texts, spans, "left").select("doc", clean("text", "at").alias("c"))
    return joined.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "c.*")
