"""Column expressions for addresses, keys, text and call names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usetrail.functions import fixed

LINE_SHIFT = 1 << 20


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column, read as it is printed."""
    return F.expr(
        f"unix_date(CAST({ts} AS DATE)) * 86400000000L"
        f" + (hour({ts}) * 60L + minute({ts})) * 60000000L"
        f" + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT)"
    )


def line_of(pos: Column) -> Column:
    return F.floor(pos / LINE_SHIFT).cast("long")


def col_of(pos: Column) -> Column:
    return pos % LINE_SHIFT


def span_size(start_line: Column, start_col: Column, end_line: Column, end_col: Column) -> Column:
    """Length on one line; over several lines, rows * 1000 plus both columns."""
    return F.when(start_line == end_line, end_col - start_col).otherwise(
        (end_line - start_line) * 1000 + end_col + start_col
    )


def holds_point(start: Column, end: Column, point: Column) -> Column:
    """Both ends count as inside."""
    return (start <= point) & (point <= end)


def holds_range(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (start <= inner_start) & (inner_end <= end)


def entity_key(kind, name, line, col, end_col) -> Column:
    """kind:name:line:col:endcol"""
    return F.concat_ws(":", kind, name, line, col, end_col)


def range_key(start_line, start_col, end_line, end_col) -> Column:
    """line:col:line:col"""
    return F.concat_ws(":", start_line, start_col, end_line, end_col)


def clipped(text: Column, limit: int = fixed.CLIP_CHARS) -> Column:
    """Text cut at `limit` characters, with a note of how many were cut off."""
    rest = (F.length(text) - limit).cast("string")
    note = F.concat(F.substring(text, 1, limit), F.lit("\n...[truncated "), rest, F.lit(" chars]"))
    return F.when(F.length(text) > limit, note).otherwise(text)


def lock_delta(method: Column) -> Column:
    """+1 for an acquiring method, -1 for a releasing one, NULL for all others."""
    return F.when(method.isin(fixed.ACQUIRE_CALLS), F.lit(1)).when(
        method.isin(fixed.RELEASE_CALLS), F.lit(-1)
    )


def is_mutex_method(method: Column) -> Column:
    return F.coalesce(method.isin(fixed.MUTEX_CALLS), F.lit(False))


def is_atomic_name(package: Column, method: Column) -> Column:
    return F.coalesce(
        (package == "atomic") & method.isin(fixed.ATOMIC_CALLS), F.lit(False)
    )


def is_heavy_call(callee: Column) -> Column:
    return F.coalesce(F.trim(callee).isin(fixed.HEAVY_CALLS), F.lit(False))


def retention_risk(type_kind: Column, rhs_kind: Column) -> Column:
    """Message where a field keeps a part of something larger alive, else NULL."""
    return F.when(
        type_kind.isin("Slice", "String") & (rhs_kind == "slice_expression"),
        F.lit(fixed.RETAIN_SLICE),
    ).when(
        (type_kind == "Map")
        & rhs_kind.isin("identifier", "selector_expression", "index_expression"),
        F.lit(fixed.RETAIN_MAP),
    )


def ranked(value: Column, pairs: list[tuple[int, str]]) -> Column:
    """Rank of a name in a fixed list of (rank, name)."""
    out = F.lit(None).cast("int")
    for rank, name in pairs:
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out


def named(rank: Column, pairs: list[tuple[int, str]]) -> Column:
    """Inverse of `ranked`."""
    out = F.lit(None).cast("string")
    for number, name in pairs:
        out = F.when(rank == number, F.lit(name)).otherwise(out)
    return out
