"""Counts, current status and request statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_entities(nodes: DataFrame, key: str, classes: dict[str, Column]) -> DataFrame:
    """Counts per document, one column per class of node."""
    return nodes.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in classes.items()])


def code_classes(strict: bool = True) -> dict[str, Column]:
    """Classes of a syntax-node table (kind, parent_kind, grand_kind, field, list_field).

    Variables are names a declaration introduces. Names on the right of `:=` do not
    count unless `strict` is off.
    """
    name = F.col("kind") == "identifier"
    declares = ["var_spec", "short_var_declaration"]
    direct = name & F.col("parent_kind").isin(declares)
    listed = name & F.col("grand_kind").isin(declares) & (F.col("parent_kind") == "expression_list")
    if strict:
        direct = direct & (F.coalesce("field", F.lit("")) != "value")
        listed = listed & (F.col("list_field") == "left")
    return {
        "variables": direct | listed,
        "functions": F.col("kind") == "function_declaration",
        "channels": F.col("kind") == "channel_type",
        "goroutines": F.col("kind") == "go_statement",
    }


def status(counts: DataFrame, order: str) -> DataFrame:
    """The counts of the last document, not their sum."""
    newest = counts.agg(F.max(F.struct(order, *[c for c in counts.columns if c != order])).alias("_s"))
    return newest.select(*[F.col(f"_s.{c}").alias(c) for c in counts.columns])


def parse_info(requests: DataFrame, text: Column, parse_ms: Column) -> DataFrame:
    """Per request: hit flag, parse time (NULL on a hit) and text length."""
    return requests.withColumn("code_len", F.length(text).cast("long")).withColumn(
        "parse_ms", F.when(~F.col("cache_hit"), parse_ms)
    )
