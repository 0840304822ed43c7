"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of
their content; pass two shuffles each bucket with Fisher-Yates. A record's place in the
global order is its bucket's offset plus its place in the bucket, and shard k takes the k-th
of equal cuts of that order, so shard counts are at most one apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usetrail.llm.common import named, text_of

OVERHEAD = 16
COARSE = 1024


def _offsets(counts: DataFrame) -> DataFrame:
    """bucket -> rows in all lower buckets, by two levels of running sums.

    One window runs per 1,024 buckets and one over a row per 1,024 buckets, so no task
    sees the list of all buckets.
    """
    coarse = F.expr(f"bucket div {COARSE}")
    before = Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("coarse").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("coarse", coarse)
    tops = counts.groupBy("coarse").agg(F.sum("n").alias("n")).select(
        "coarse", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return (
        counts.withColumn("lower", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(tops, "coarse")
        .select("bucket", (F.col("base") + F.col("lower")).alias("first"))
    )


def external_shuffle(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 17,
    bucket_bytes: int = 16 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """record struct (all input columns), shard int, slot long; one row per input row.

    The order depends on seed and content only, not on partitions or task order. Null keys
    and texts hash like any other value, equal rows are interchangeable and take
    neighbouring places in one bucket's base order before it is shuffled, an empty table
    gives no row, and input columns of any name stay inside `record`. Size of a record:
    UTF-8 bytes of its text plus 16.
    """
    spread = F.xxhash64(F.lit(seed), named(docs, key), named(docs, text))
    plain = [docs[f"`{f.name}`"] for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("record"),
        spread.alias("spread"),
        F.xxhash64(F.lit(seed + 1), *plain).alias("tie"),
        (F.octet_length(text_of(docs, text)) + OVERHEAD).cast("long").alias("size"),
    )
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(size / bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.col("spread"), F.lit(buckets)))
    offsets = _offsets(rows.groupBy("bucket").agg(F.count("*").alias("n")))

    def shuffled(bucket: pa.Table) -> pa.Table:
        order = np.lexsort((bucket["tie"].to_numpy(), bucket["spread"].to_numpy()))
        number = bucket["bucket"][0].as_py()
        order = order[np.random.default_rng([seed, number]).permutation(len(order))]
        place = bucket["first"][0].as_py() + np.arange(len(order), dtype=np.int64)
        shard = place * shards // total
        return pa.table(
            {
                "record": bucket["record"].take(pa.array(order)),
                "shard": pa.array(shard, pa.int32()),
                "slot": pa.array(place + (-shard * total) // shards, pa.int64()),
            }
        )

    schema = T.StructType(
        [rows.schema["record"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    )
    scattered = rows.drop("size").repartition(buckets, "bucket").join(offsets, "bucket")
    return scattered.groupBy("bucket").applyInArrow(shuffled, schema)


def write_shards(shuffled: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard and read the table back.

    A bucket covers a run of the global order, so it writes into the few shards that run
    crosses. Rows carry their slot, so a reader can restore the order inside a shard.
    """
    shuffled.write.mode("overwrite").partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)
