"""What each use is: reassigned, captured, its kind, label and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions import fixed
from usetrail.functions.columns import named, ranked
from usetrail.plans.scan import numbered


def reassign_flag(
    parent_kind: Column, side: Column, token: Column, newly_defined: Column, is_direct: Column
) -> Column:
    """A direct target of an assignment, of ++/--, or of a range with `=`.

    In `:=` forms a name counts only if it is not newly defined there.
    """
    define = token == ":="
    target = (side == "left") & is_direct
    in_assign = parent_kind.isin("assignment_statement", "short_var_declaration")
    in_step = parent_kind.isin("inc_statement", "dec_statement")
    in_range = parent_kind == "range_clause"
    flag = (
        F.when(in_assign, target & (~define | ~newly_defined))
        .when(in_step, is_direct)
        .when(in_range, target & F.when(define, ~newly_defined).otherwise(token == "="))
    )
    return F.coalesce(flag, F.lit(False))


def captured_flag(
    use_ctx: Column, use_is_closure: Column, decl_ctx: Column, is_global: Column
) -> Column:
    """Used inside a closure other than where it was declared; globals never are."""
    flag = use_is_closure & decl_ctx.isNotNull() & (use_ctx != decl_ctx) & ~is_global
    return F.coalesce(flag, F.lit(False))


def lifecycle_kind(
    op: Column, pointer: Column, reassign: Column, captured: Column, race: Column
) -> Column:
    """Kind of a row; `race` is a race severity or NULL."""
    return (
        F.when(op == "decl", "Declaration")
        .when(race.isin("High", "Medium"), "Race")
        .when(race == "Low", "RaceLow")
        .when(reassign, "AliasReassigned")
        .when(captured, "AliasCaptured")
        .when(pointer, "Pointer")
        .otherwise("Use")
    )


def color_key(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for _, name, key, _ in fixed.KINDS:
        out = F.when(kind == name, key).otherwise(out)
    return out


def kind_table(spark) -> DataFrame:
    """The seven kinds with label, colour key and default colour."""
    rows = [(rank, name, name, key, color) for rank, name, key, color in fixed.KINDS]
    return spark.createDataFrame(
        rows, "priority int, kind string, label string, color_key string, color_value string"
    )


def with_kind_names(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Label and colour key of each row's kind; the table has seven rows."""
    dim = F.broadcast(
        kind_table(df.sparkSession).select(F.col("kind").alias(kind), "label", "color_key")
    )
    return df.join(dim, kind, "left").select(*df.columns, "label", "color_key")


def top_kind(df: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """The kind of highest priority per position or group."""
    pairs = [(rank, name) for rank, name, _, _ in fixed.KINDS]
    return (
        df.groupBy(*keys).agg(F.min(ranked(F.col(kind), pairs)).alias("_r"))
        .select(*keys, named(F.col("_r"), pairs).alias(kind))
    )


def hover_summary(variables: DataFrame) -> DataFrame:
    """Summary text per variable: name, 1-based line, type, uses, race warning."""
    base = F.format_string(
        fixed.SUMMARY_TEXT, F.col("name"), F.col("line") + 1,
        F.when(F.col("is_pointer"), "Pointer").otherwise("Value"), F.col("n_uses"),
    )
    warning = F.when(F.col("potential_race"), fixed.SUMMARY_RACE).otherwise("")
    return variables.withColumn("summary", F.concat(base, warning))


def base_text(name: Column, op: Column, captured: Column, race: Column) -> Column:
    """First clause of a use's text."""
    access = F.when(op == "write", "write access").otherwise("read access")
    plain = (
        F.when(op == "decl", F.format_string(fixed.DECLARATION_TEXT, name))
        .when(op == "write", F.format_string(fixed.WRITE_TEXT, name))
        .when(captured, F.format_string(fixed.CAPTURED_TEXT, name))
        .otherwise(F.format_string(fixed.USE_TEXT, name))
    )
    racing = [F.when(race == level, F.format_string(text, name, access)) for level, text in fixed.RACE_TEXTS]
    return F.coalesce(*racing, plain)


def joined_text(*clauses: Column) -> Column:
    """Clauses joined by ' | '; NULL clauses are left out."""
    return F.concat_ws(" | ", *clauses)


def split_confidence(findings: DataFrame, certain: Column) -> DataFrame:
    """Certain findings become diagnostics, the others stay notes."""
    return findings.withColumn(
        "channel", F.when(certain, "diagnostic").otherwise("note")
    )


def by_kind(
    df: DataFrame, keys: list[str], kind: str, order: list[str], item: Column, page: int = 1000
) -> DataFrame:
    """Items of each kind as ordered lists.

    A list holds at most `page` items; longer ones go on in the next page, so a group
    of any size stays whole without one row growing without bound.
    """
    ranked_rows = numbered(df, [*keys, kind], order, "_rn")
    paged = ranked_rows.withColumn("page", F.expr(f"(_rn - 1) div {page}"))
    lists = paged.groupBy(*keys, kind, "page").agg(
        F.sort_array(F.collect_list(F.struct("_rn", item.alias("_item")))).alias("_l")
    )
    return lists.select(*keys, kind, "page", F.transform("_l", lambda s: s["_item"]).alias("items"))
