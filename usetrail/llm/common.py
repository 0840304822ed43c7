"""Helpers the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words and what bytes.split() splits on.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that no column of the frame has, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    names = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def named(df: DataFrame, column: str) -> Column:
    """A column by its exact name, dots and all."""
    return df[f"`{column}`"]


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(named(df, column).cast("string"), F.lit(""))


def table_written(df: DataFrame, path: str) -> DataFrame:
    """Write a table to shared storage once and go on from the written copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
