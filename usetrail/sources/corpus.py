"""Readers and stored-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_corpus(
    spark: SparkSession, path: str, fmt: str = "text", glob: str | None = None
) -> DataFrame:
    """One row per document.

    `text` reads whole files with their path as key; `binaryFile` and the table
    formats are passed to the reader of that name.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "text":
        files = reader.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return files.select(
            F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"),
            F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder"),
        )
    return reader.format(fmt).load(path)


def same_package(corpus: DataFrame, package: str) -> DataFrame:
    """Documents of one folder whose first package clause names `package`."""
    clause = F.regexp_extract("text", r"(?m)^\s*package\s+(\w+)", 1)
    return corpus.filter(clause == package)


def overlay(base: DataFrame, unsaved: DataFrame, key: str, col: str) -> DataFrame:
    """Unsaved content replaces stored content of the same key; empty is ignored."""
    fresh = unsaved.select(F.col(key), F.col(col).alias("_unsaved"))
    content = F.coalesce(F.nullif(F.col("_unsaved"), F.lit("")), F.col(col))
    joined = base.join(fresh, key, "left")
    return joined.select(*[content.alias(c) if c == col else F.col(c) for c in base.columns])


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key.

    A max over a struct is combined before the shuffle, so a key with very many
    versions sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_v"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def decode(df: DataFrame, col: str, schema: T.StructType | str, into: str = "decoded") -> DataFrame:
    """Decode a JSON payload; a malformed one gives NULL fields and no failure."""
    return df.withColumn(into, F.from_json(col, schema, {"mode": "PERMISSIVE"}))
