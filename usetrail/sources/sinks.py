"""Sinks: lifecycle records as JSON, findings as a replaceable log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usetrail.operators.classify import color_key, kind_table
from usetrail.plans.scan import stacked

HEAD_RULE = "_analysed"


def lifecycle_records(
    rows: DataFrame, name: Column, file: Column, line: Column, col: Column
) -> DataFrame:
    """Nested lifecycle points of rows (entity name, op, kind, flags)."""
    is_decl = F.col("op") == "decl"
    return rows.withColumn(
        "point",
        F.struct(
            name.alias("name"), file.alias("file"),
            F.struct(line.alias("line"), col.alias("col")).alias("pos"),
            F.struct(
                F.col("var"),
                F.when(is_decl, "decl").otherwise("use").alias("kind"),
                F.col("pointer"),
                (~is_decl & F.col("reassign")).alias("reassign"),
                (~is_decl & F.col("captured")).alias("captured"),
                F.col("kind").alias("decoration"),
                color_key(F.col("kind")).alias("color_key"),
            ).alias("expected"),
        ),
    )


def to_lifecycle_json(records: DataFrame) -> DataFrame:
    return records.withColumn("json", F.to_json("point")).drop("point")


def write_lifecycle_json(records: DataFrame, path: str) -> None:
    records.select("point.*").write.mode("overwrite").json(path)


def with_colors(df: DataFrame, key: str, colors: DataFrame | None = None) -> DataFrame:
    """Colour of each row's colour key, '' where none is configured.

    `colors` is a settings table (color_key, color_value); by default the seven fixed
    ones, which are small enough to broadcast. A given table is left to Spark.
    """
    dim = colors
    if dim is None:
        dim = F.broadcast(kind_table(df.sparkSession))
    dim = dim.select(F.col("color_key").alias("_key"), F.col("color_value").alias("_color"))
    return df.join(dim, F.col(key) == F.col("_key"), "left").select(
        *df.columns, F.coalesce("_color", F.lit("")).alias("color_value")
    )


def write_findings(
    findings: DataFrame, analysed: DataFrame, path: str, version: int, doc: str = "doc_id"
) -> None:
    """Replace the findings of every analysed document; an empty set clears it.

    The table is a log: a run adds its findings and one head row per document it
    looked at. Nothing is overwritten, so a lost task or a repeated run does no harm,
    and no document needs a partition of its own.
    """
    heads = analysed.select(doc).distinct().withColumn("rule", F.lit(HEAD_RULE))
    rows = stacked(findings, heads, partial=True)
    (
        rows.withColumn("version", F.lit(version).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("version").parquet(path)
    )


def read_findings(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """Findings of the last version of every document."""
    log = spark.read.parquet(path)
    newest = log.filter(F.col("rule") == HEAD_RULE).groupBy(doc).agg(
        F.max("version").alias("version")
    )
    kept = log.filter(F.col("rule") != HEAD_RULE).join(newest, [doc, "version"])
    return kept.drop("version")


def compact_findings(spark: SparkSession, path: str, into: str, doc: str = "doc_id") -> None:
    """Write the log anew to another folder with the last version of every document only.

    Readers of the old folder are not disturbed: it stays as it is, and a run that is
    broken off leaves nothing that is read. Versions and heads stay, so later runs go on in
    the new folder, and an older run that is repeated there changes nothing.
    """
    log = spark.read.parquet(path)
    newest = log.filter(F.col("rule") == HEAD_RULE).groupBy(doc).agg(F.max("version").alias("version"))
    kept = log.join(newest, [doc, "version"])
    kept.write.mode("errorifexists").partitionBy("version").parquet(into)
