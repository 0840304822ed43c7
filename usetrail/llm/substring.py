"""Substring dedup by seed and extend over words.

Seeds are winnowed k-word anchors, one per run of windows. A run is an anchor extended both
ways over all windows that chose it. Equal runs are settled as wholes: every one but the
first repeats it. What differs around an equal anchor is extended window by window, among the
first occurrences of the differing runs only. Repeated windows that touch make up the
maximal repeats; each is at least WINDOW words long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.anchors import (
    CHUNK, FOUND, NO_ID, RUN, SCATTERED, SPAN, choices, found, gathered, group_count, joined_spans, keyed, mask, of_documents,
    scattered, spans_of,
)
from usetrail.llm.common import table_written
from usetrail.llm.hashing import grams, prefix, segments, word_hashes
from usetrail.session import scratch_dir

WINDOW, SEED = 20, 4
GROUP_BYTES = 8 << 20
#: A window: its hash, document and first word.
PLACE = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("start", "<i4")])


def runs_of(words: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The runs of one document, without its key."""
    parts = []
    for base in range(0, max(0, len(words) - window + 1), CHUNK):
        part = words[base : base + CHUNK + window - 1]
        seeds = grams(part, seed)
        anchor, lo, hi = choices(seeds, window - seed + 1)
        rows = np.zeros(len(lo), RUN)
        rows["anchor"], rows["content"] = seeds[anchor], segments(prefix(part), lo, hi + window)
        rows["lo"], rows["n"] = base + lo, hi - lo + 1
        parts.append(rows)
    return np.concatenate(parts) if parts else np.zeros(0, RUN)


def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each (anchor, content), in that order; and later ones."""
    rows = rows[np.lexsort((rows["lo"], rows["row"], rows["doc"], rows["content"], rows["anchor"]))]
    if not len(rows):
        return rows, rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["content"][1:] != rows["content"][:-1])
    head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (rows["doc"] != head["doc"]) | (rows["row"] != head["row"]) | (rows["lo"] != head["lo"])
    return rows[new], rows[~new & later]


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text",
            group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc, row, at: spans of windows that also start earlier (doc and row as in `keyed`).

    Earlier is: in a document of a smaller id (null is the largest; of equal ids with other
    texts the one with the smaller text hash), or earlier in the same document. Rows
    that repeat an id and its text are one document. Tasks settle what repeats among
    their own documents before anything is shuffled, so a passage that very many
    documents share costs one record per batch of them.
    """
    folder = scratch_dir(docs.sparkSession, "repeats")
    texts, groups = keyed(docs, key, text), group_count(docs, group_bytes, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, row, body in zip(batch["doc"].to_pylist(), batch["row"].to_pylist(), batch["text"], strict=True):
                rows = runs_of(word_hashes(body.as_py().encode()), window, seed)
                rows["doc"], rows["row"] = doc, row
                parts.append(rows)
            if parts:
                first, later = firsts(np.concatenate(parts))
                yield from scattered(first, first["anchor"], groups, spans_of(later))

    def settle(group: pa.Table) -> pa.Table:
        first, later = firsts(gathered(group, "rows", RUN))
        at, n = np.unique(first["anchor"], return_counts=True)
        open_ = np.repeat(n > 1, n) if len(at) else np.zeros(0, bool)
        done = np.concatenate((gathered(group, "done", SPAN), spans_of(later)))
        return pa.concat_tables([found(0, done), found(1, spans_of(first[open_]))])

    runs = texts.mapInArrow(scan, SCATTERED).groupBy("group").applyInArrow(settle, FOUND)
    runs = table_written(runs, f"{folder}/runs")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            columns = (batch["doc"].to_pylist(), batch["row"].to_pylist(), batch["text"], batch["at"].to_pylist())
            for doc, row, body, at in zip(*columns, strict=True):
                words = word_hashes(body.as_py().encode())
                start = np.flatnonzero(mask(at, len(words), 1))
                rows = np.zeros(len(start), PLACE)
                rows["hash"], rows["start"] = segments(prefix(words), start, start + window), start
                rows["doc"], rows["row"] = doc, row
                parts.append(rows)
            if parts:
                first, later = first_places(np.concatenate(parts))
                yield from scattered(first, first["hash"], groups, joined_spans(later["doc"], later["row"], later["start"]))

    def compare(group: pa.Table) -> pa.Table:
        _, later = first_places(gathered(group, "rows", PLACE))
        done = np.concatenate((gathered(group, "done", SPAN), joined_spans(later["doc"], later["row"], later["start"])))
        return found(0, done)

    opened = of_documents(texts, runs.where("kind = 1").distinct(), "inner")
    more = opened.mapInArrow(windows, SCATTERED).groupBy("group").applyInArrow(compare, FOUND)
    return runs.where("kind = 0").union(table_written(more, f"{folder}/windows")).select("doc", "row", "at")


def first_places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each window, and later ones."""
    rows = rows[np.lexsort((rows["start"], rows["row"], rows["doc"], rows["hash"]))]
    if not len(rows):
        return rows, rows
    new = np.ones(len(rows), bool)
    new[1:] = rows["hash"][1:] != rows["hash"][:-1]
    head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (rows["doc"] != head["doc"]) | (rows["row"] != head["row"]) | (rows["start"] != head["start"])
    return rows[new], rows[~new & later]


CLEANED = "struct<n_words: long, removed: array<struct<first: long, last: long>>, kept: string>"


def cleaned(docs: DataFrame, window: int = WINDOW, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, removed (half-open word runs), kept (words joined by one space).

    One row per input row; null and empty texts have no words. Words are the runs of other
    characters than ASCII white space, unchanged.
    """
    texts = keyed(docs, key, text)
    spans = repeats(docs, window, seed, key, text)
    kind = pa.struct([("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.string())])

    @F.arrow_udf(CLEANED)
    def clean(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for body, at in zip(bodies, spans.to_pylist(), strict=True):
            words = body.as_py().encode().split()
            removed = []
            if at:
                gone = mask(at, len(words), window)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                removed = [{"first": int(a), "last": int(b)} for a, b in edge.reshape(-1, 2)]
                n, words = len(words), [w for w, x in zip(words, gone, strict=True) if not x]
            else:
                n = len(words)
            out.append({"n_words": n, "removed": removed, "kept": b" ".join(words).decode()})
        return pa.array(out, kind)

    joined = of_documents(texts, spans, "left").select("doc", clean("text", "at").alias("c"))
    return joined.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "c.*")
