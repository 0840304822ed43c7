"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usetrail.session import scratch_dir

#: Links that one task contracts at a time.
LOCAL = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the links of one task to stars, so that chains are short from the start."""

    def flush(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in root]
        rows = [(x, r) for x, r in rows if x != r]
        return pa.record_batch([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["u", "v"])

    held: list[tuple[bytes, bytes]] = []
    for batch in batches:
        held += zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True)
        if len(held) >= LOCAL:
            yield flush(held)
            held = []
    if held:
        yield flush(held)


def _written(links: DataFrame, path: str) -> DataFrame:
    links.write.mode("overwrite").parquet(path)
    return links.sparkSession.read.schema("u binary, v binary").parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node, root: every node of the links (u binary, v binary) with the least node it reaches.

    Each round hangs the larger neighbours of a node, then the node and its smaller ones, on
    the least of them; rounds number about the logarithm of the longest chain. A round's
    links are written to shared storage, so lineage stays short and lost executors cost one
    round. Nodes with very many links are joined, not grouped, beyond their least neighbour.
    """
    folder = scratch_dir(links.sparkSession, "components")
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = _written(edges.mapInArrow(_stars, "u binary, v binary").distinct(), f"{folder}/0")
    mark = None
    for turn in range(1, 100):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("at"), F.least("u", "m").alias("m")
        )
        large = both.join(least, both["u"] == least["at"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _written(large.distinct(), f"{folder}/{turn}a")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
        small = large.join(least, large["u"] == least["at"])
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("at").alias("u"), F.col("m").alias("v"))
        )
        edges = _written(small.distinct(), f"{folder}/{turn}b")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
