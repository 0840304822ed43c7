"""Session settings used by the bench and the tests."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one part, in bytes: its words or nodes are sorted in memory.
PART_BYTES = 2 << 20
#: The folders given out, by application.
_GIVEN: dict[str, list[str]] = {}


def build(master: str = "local[*]", partitions: int = 8, memory: str = "12g", shared: str | None = None) -> SparkSession:
    """A local session. On a cluster the submit command sets all of this."""
    builder = SparkSession.builder
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = (
        builder.master(master)
        .appName("usetrail")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path for written tables, in storage that driver and executors share.

    The parent is the folder the cluster names in spark.checkpoint.dir; where that is
    unset (tests, local runs) it lies in the warehouse, which is shared as well.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    parent = shared or spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    alone = spark.conf.get("spark.master", "local").startswith("local[") or spark.conf.get("spark.master", "local") == "local"
    if not shared and not alone and parent.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{parent.rstrip('/')}/usetrail-{name}-{uuid.uuid4().hex}"
    _GIVEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _table_name(folder: str) -> str:
    return folder.rsplit("/", 1)[1].replace("-", "_")


def drop_scratch(spark: SparkSession) -> int:
    """Delete the folders that this application was given by `scratch_dir`; their number.

    Operators write what they read more than once, and their results read those tables; so
    call this when the results have been written or collected. Other folders are left alone.
    """
    paths = _GIVEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for name in paths:
        spark.sql(f"DROP TABLE IF EXISTS {_table_name(name)}")
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def staged(df: DataFrame, name: str, on: str | None = None) -> DataFrame:
    """Write an intermediate table once and go on from the written copy.

    For results that several later steps read and that cost windows and joins to make.
    Unlike a cached frame the table outlives lost executors. `on`: keep the rows spread by that
    column, in buckets, so what reads the table joins and groups by it without a shuffle.
    """
    if on is not None:
        return gathered([df], name, on)
    path = scratch_dir(df.sparkSession, name) + "/table"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(frames: list[DataFrame], name: str, on: str) -> DataFrame:
    """Rows of all frames in one written table, in buckets by `on`: a union that needs no shuffle.

    Frames of the same columns are written one after the other. There are as many buckets as
    parts in a shuffle, so inside `in_place` all such tables have the same; rows that are
    spread so already are written where they are.
    """
    spark, columns = frames[0].sparkSession, frames[0].columns
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_dir(spark, name)
    table = _table_name(folder)
    for frame in frames:
        rows = frame.select(*columns).repartition(parts, on)
        rows.write.bucketBy(parts, on).option("path", f"{folder}/table").mode("append").saveAsTable(table, format="parquet")
    return spark.table(table)


def parts_of(rows: DataFrame, text: str) -> int:
    """Number of parts for rows with a long text, each of about `PART_BYTES` of text.

    Texts are cut up and sorted part by part, and what comes out is many times the text. The
    number of parts follows the bytes of all texts, so a part stays as small on any input;
    by default parts are as large as their packed texts allow. The texts are read once for it.
    """
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spark = rows.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / PART_BYTES))


def spread(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with a long text spread by key, into `parts_of` parts."""
    if rows.isStreaming:
        return rows.repartition(key)
    return rows.repartition(parts_of(rows, text), key)


@contextmanager
def in_place(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Joins planned inside meet where both sides are spread by some of their keys already.

    For tables that are spread by document in the same way, over `parts` parts if given. Only what
    is written inside (`staged`) is planned so; a join over keys that may be hot must stay outside.
    """
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
    if parts:
        settings |= {"spark.sql.shuffle.partitions": str(parts), "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
