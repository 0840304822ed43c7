"""Cost-balanced packing of token sequences.

A document costs linear * tokens + quadratic * tokens**2 in a sequence where attention stays
inside documents. Pieces go in descending order to the lowest-cost sequence with room for
them, so costs even out; what fits nowhere whole is cut over the room that is left.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import named, text_of
from usetrail.llm.tokens import END, default_path, encoder

CAPACITY = 1024
#: Text per packing group, which is one task's unit of work; at most one sequence's worth of
#: padding per group.
GROUP_BYTES = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Ids leave a tokenizing task in batches of about so many bytes.
FLUSH_BYTES = 8 << 20


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Per sequence the (piece, first, last) parts it gets, in order.

    `lengths` descend and none exceeds the capacity. There are just enough sequences for
    all tokens. Sequences without room for the piece at hand wait apart, by room, until
    pieces are short enough for them.
    """
    count = math.ceil(sum(lengths) / capacity)
    room, cost = [capacity] * count, [0.0] * count
    made: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    open_, waiting, left = [(0.0, s) for s in range(count)], [], []

    def put(piece: int, first: int, last: int, s: int) -> None:
        made[s].append((piece, first, last))
        room[s] -= last - first
        cost[s] += linear * (last - first) + quadratic * (last - first) ** 2

    for piece, length in enumerate(lengths):
        while waiting and -waiting[0][0] >= length:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(open_, (cost[s], s))
        while open_ and room[open_[0][1]] < length:
            s = heapq.heappop(open_)[1]
            if room[s]:
                heapq.heappush(waiting, (-room[s], s))
        if not open_:
            left.append(piece)
            continue
        s = open_[0][1]
        put(piece, 0, length, s)
        heapq.heapreplace(open_, (cost[s], s))
    gaps = [(cost[s], s) for s in range(count) if room[s]]
    heapq.heapify(gaps)
    for piece in left:
        first = 0
        while first < lengths[piece]:
            s = gaps[0][1]
            last = min(lengths[piece], first + room[s])
            put(piece, first, last, s)
            first = last
            heapq.heappop(gaps)
            if room[s]:
                heapq.heappush(gaps, (cost[s], s))
    return made


def packed(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, key: str = "doc_id",
    text: str = "text", group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit little-endian).

    One row per piece: `ids` are the document's ids from `start` on, and stand in sequence
    `sequence_id` from `offset` on. A document is its ids and the end id 0, so null and empty
    texts make one piece of one id. Longer documents than the capacity are cut there first.
    Pieces are spread over groups by a hash of key, start and ids; a group is packed in one
    task and its size is bounded, whatever source or copies the pieces come from. Null keys
    and repeated rows are packed like all others. Sequence ids are unique, not consecutive.
    """
    path = tokenizer or default_path()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of(docs, text))), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / group_bytes))
    names = ["group", "doc_id", "start", "doc_tokens", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        rows, held = [], 0
        for batch in batches:
            for doc, body in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.append(made.encode(body.as_py(), added=True), np.uint16(END)).astype("<u2")
                salt = zlib.crc32(str(doc).encode())
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity].tobytes()
                    rows.append((zlib.crc32(piece, salt + start & 0xFFFFFFFF) % groups, doc, start, len(ids), piece))
                held += 2 * len(ids)
                if held >= FLUSH_BYTES:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def pack(group: pa.Table) -> pa.Table:
        number = group["group"][0].as_py()
        rows = list(zip(*(group[c].to_pylist() for c in names[1:]), strict=True))
        rows.sort(key=lambda r: (-len(r[3]), r[0] is None, r[0] or 0, r[1], r[3]))
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        for s, parts in enumerate(assign([len(r[3]) // 2 for r in rows], capacity)):
            offset = 0
            for piece, first, last in parts:
                doc, start, total, ids = rows[piece]
                values = (
                    doc, start + first, last - first, total, number << 24 | s, offset,
                    np.frombuffer(ids, "<u2")[first:last].astype("<u4").tobytes(),
                )
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
                offset += last - first
        return pa.table({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    texts = docs.select(named(docs, key).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return (
        texts.mapInArrow(tokenized, "group long, doc_id long, start long, doc_tokens long, ids binary")
        .groupBy("group")
        .applyInArrow(pack, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    )
