"""Winnowed anchors, and the runs of windows that choose them.

Of a sequence of units (words or bytes) every window of `window` units chooses the least
hash among the k-grams inside it. The choice depends on the window alone, so equal windows
choose equal k-grams at equal offsets. Consecutive windows with one choice are a run; equal
windows lie in runs whose anchors have equal hashes, and equal runs are equal windows all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named, text_of

#: Windows whose choice is computed at a time; positions fit the low bits of the choice.
CHUNK = 1 << 16
_POSITION = np.uint64((1 << 20) - 1)
#: Key of a null id.
NO_ID = 2**63 - 1
#: A run: hash of its anchor, of its units, document, first window and number of windows.
RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("row", "<u4"), ("lo", "<i4"), ("n", "<i4"), ("many", "u1")])
#: Windows lo..hi of a document.
SPAN = np.dtype([("doc", "<i8"), ("row", "<u4"), ("lo", "<i4"), ("hi", "<i4")])


def choices(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window of every run over windows of `width` k-grams."""
    m = len(grams) - width + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    value = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    span, low = 1, value
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:m], low[width - span : width - span + m])
    anchor = (low & _POSITION).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    lo = np.concatenate(([0], cut))
    return anchor[lo], lo, np.concatenate((cut, [m])) - 1


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, row, text: a key per document that survives null and repeated ids."""
    body = text_of(docs, text)
    return docs.select(*keys(docs, key, text), body.alias("text"))


def keys(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    return (
        F.coalesce(named(docs, key).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.pmod(F.xxhash64(text_of(docs, text)), F.lit(1 << 31)).cast("int").alias("row"),
    )


def group_count(docs: DataFrame, group_bytes: int, text: str = "text") -> int:
    """Groups of about `group_bytes` of text each."""
    size = docs.agg(F.sum(F.octet_length(text_of(docs, text)))).first()[0]
    return max(1, math.ceil((size or 0) / group_bytes))


def scattered(rows: np.ndarray, by: np.ndarray, groups: int, done: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records as packed bytes per group; what is settled already travels with them."""
    group = (by % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    at, first = np.unique(group[order], return_index=True)
    packed = [part.tobytes() for part in np.split(rows[order], first[1:])] if len(at) else []
    settled = [part.tobytes() for part in np.array_split(done, max(1, len(at)))]
    if not len(at):
        at, packed = np.zeros(1, np.int64), [b""]
    yield pa.record_batch(
        [pa.array(at, pa.int64()), pa.array(packed, pa.binary()), pa.array(settled, pa.binary())], ["group", "rows", "done"]
    )


SCATTERED = "group long, rows binary, done binary"


def gathered(group: pa.Table, column: str, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(group[column].to_pylist()), dtype)


def spans_of(rows: np.ndarray) -> np.ndarray:
    """Runs as spans of windows."""
    out = np.zeros(len(rows), SPAN)
    out["doc"], out["row"], out["lo"], out["hi"] = rows["doc"], rows["row"], rows["lo"], rows["lo"] + rows["n"] - 1
    return out


def joined_spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Single windows as spans, consecutive ones of a document as one."""
    order = np.lexsort((start, row, doc))
    doc, row, start = doc[order], row[order], start[order].astype(np.int64)
    if not len(doc):
        return np.zeros(0, SPAN)
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(row.astype(np.int64)) != 0) | (np.diff(start) > 1)))
    first = np.flatnonzero(new)
    out = np.zeros(len(first), SPAN)
    out["doc"], out["row"], out["lo"] = doc[first], row[first], start[first]
    out["hi"] = start[np.concatenate((first[1:], [len(doc)])) - 1]
    return out


FOUND = "kind int, doc long, row int, at long"


def found(kind: int, spans: np.ndarray) -> pa.Table:
    """Spans as rows, first and last window in one number."""
    return pa.table(
        {
            "kind": pa.array(np.full(len(spans), kind, np.int32)),
            "doc": pa.array(spans["doc"]), "row": pa.array(spans["row"].astype(np.int32)),
            "at": pa.array(spans["lo"].astype(np.int64) << 32 | spans["hi"].astype(np.int64)),
        }
    )


def of_documents(texts: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """doc, row, text and the spans of each document as an array (null if none)."""
    lists = spans.groupBy("doc", "row").agg(F.collect_list("at").alias("at"))
    return texts.join(lists, ["doc", "row"], how)


def mask(at, units: int, window: int) -> np.ndarray:
    """Units covered by windows whose spans are given."""
    edge = np.zeros(units + 1, np.int64)
    if at:
        spans = np.array(at, np.int64)
        np.add.at(edge, spans >> 32, 1)
        np.add.at(edge, (spans & 0xFFFFFFFF) + window, -1)
    return np.cumsum(edge[:-1]) > 0
