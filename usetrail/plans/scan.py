"""Running aggregates over ordered groups of any size.

A plain window sorts each group in one task, so a key that holds a third of all rows would be
one task's work. Here the rows are put into ranges of (keys, order) of about equal numbers of
rows, whatever the keys and however the positions bunch, and written once to shared storage
with the number of their range, the chunk. Each chunk of a key runs as its own window, and
what earlier chunks of the key contribute is one small row per chunk that is joined back.
Writing first makes rows and chunk totals see the same cuts, also after a lost executor. All
aggregates used here combine associatively, so results equal the plain window. The plan is
the same at every size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usetrail.session import staged

CHUNK = "_chunk"


def stacked(*frames: DataFrame, partial: bool = False) -> DataFrame:
    """Union by name whose result is always shuffled again by what follows.

    Spark 4.1 lets a union keep the partitioning of its sides. When those sides end up
    reading one reused shuffle, the promise made in planning does not hold at run time
    and groups come out in pieces (seen on 4.1.2), so that is switched off here.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=partial)
    return out


def with_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add the chunk number of each row: its range in the order of keys and `order`.

    NULLs come first, as in the windows that follow.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return staged(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def listed(rows: DataFrame, on: list[str], into: str) -> DataFrame:
    """The rows of each group as one list of structs, for groups that come out of one stored row.

    Lists of several tables join on the group alone, so rows of a document meet without a
    shuffle of each; tables that are spread by document already are not shuffled at all.
    """
    return rows.groupBy(*on).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in on])).alias(into))


def together(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Union by name of two tables, made where the groups are, for groups that come out of one stored row.

    The lists of both sides join on the group, so rows that are spread by some of `on` are not
    shuffled again, as they would be by a union. Right rows of groups without left rows drop out.
    """
    types = {f.name: f.dataType for f in (*right.schema, *left.schema)}
    names = [c for c in types if c not in on]

    def side(df: DataFrame, into: str) -> DataFrame:
        cells = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in names]
        return listed(df.select(*on, *cells), on, into)

    both = side(left, "_left").join(side(right, "_right"), on, "left")
    rows = F.when(F.col("_right").isNull(), F.col("_left")).otherwise(F.concat("_left", "_right"))
    return both.select(*on, F.inline(rows))


def matched(rows: DataFrame, extra: DataFrame, on: list[str]) -> DataFrame:
    """Left join on equal or both-NULL columns; the right side's copies of them go."""
    renamed = extra.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = reduce(and_, [rows[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on])
    return rows.join(renamed, cond, "left").drop(*[f"_on_{c}" for c in on])


@dataclass(frozen=True)
class Running:
    """One running aggregate: what to run, over which expression, own row or not."""

    kind: str
    expr: Column
    exclusive: bool = False


def total(expr, exclusive: bool = False) -> Running:
    return Running("sum", expr, exclusive)


def lowest(expr, exclusive: bool = False) -> Running:
    return Running("min", expr, exclusive)


def highest(expr, exclusive: bool = False) -> Running:
    return Running("max", expr, exclusive)


def latest(expr, exclusive: bool = False) -> Running:
    """Last non-NULL value so far (the as-of lookup)."""
    return Running("last", expr, exclusive)


def previous(expr) -> Running:
    """Value of the row directly before."""
    return Running("lag", expr)


def following(expr) -> Running:
    """Value of the row directly after."""
    return Running("lead", expr)


def _within(item: Running, order: Window, upto: Window, before: Window) -> Column:
    frame = before if item.exclusive else upto
    if item.kind == "sum":
        return F.coalesce(F.sum(item.expr).over(frame), F.lit(0))
    if item.kind == "min":
        return F.min(item.expr).over(frame)
    if item.kind == "max":
        return F.max(item.expr).over(frame)
    if item.kind == "last":
        return F.last(item.expr, ignorenulls=True).over(frame)
    step = F.lag if item.kind == "lag" else F.lead
    return step(F.struct(item.expr.alias("v"))).over(order)


def _of_chunk(item: Running, order: list[str]) -> Column:
    place = F.struct(*order)
    if item.kind == "sum":
        return F.sum(item.expr)
    if item.kind == "min":
        return F.min(item.expr)
    if item.kind == "max":
        return F.max(item.expr)
    if item.kind == "last":
        return F.max_by(item.expr, F.when(item.expr.isNotNull(), place))
    pick = F.max_by if item.kind == "lag" else F.min_by
    return pick(F.struct(item.expr.alias("v")), place)


def _carried(item: Running, value: Column, order: Window, before: Window) -> Column:
    if item.kind == "sum":
        return F.sum(value).over(before)
    if item.kind == "min":
        return F.min(value).over(before)
    if item.kind == "max":
        return F.max(value).over(before)
    if item.kind == "last":
        return F.last(value, ignorenulls=True).over(before)
    step = F.lag if item.kind == "lag" else F.lead
    return step(value).over(order)


def _joined(item: Running, here: Column, carried: Column) -> Column:
    if item.kind == "sum":
        return here + F.coalesce(carried, F.lit(0))
    if item.kind == "min":
        return F.least(here, carried)
    if item.kind == "max":
        return F.greatest(here, carried)
    if item.kind == "last":
        return F.coalesce(here, carried)
    return F.coalesce(here, carried)["v"]


def _local(keys: list[str], order: list[str], items: dict[str, Running]) -> dict[str, Column]:
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    return {n: _within(item, by, upto, before) for n, item in items.items()}


def _plain(keys: list[str], order: list[str], items: dict[str, Running]) -> dict[str, Column]:
    local = _local(keys, order, items)
    return {n: local[n]["v"] if item.kind in ("lag", "lead") else local[n] for n, item in items.items()}


def running(
    df: DataFrame, keys: list[str], order: list[str], bounded: bool = False, **items: Running
) -> DataFrame:
    """Add running aggregates over `keys`, ordered by `order`.

    NULL keys are a group like others and NULL positions come first. A frame that already
    carries chunks from `with_chunks` (same keys and order) is used as it is, so several
    calls share one written table.

    `bounded` says that every group comes out of one stored row (the words of one
    text, the tags of one page), which one task holds anyway; a plain window does then,
    and it keeps the partitioning its input has.
    """
    shared = CHUNK in df.columns
    if bounded:
        return df.select("*", *[c.alias(n) for n, c in _plain(keys, order, items).items()])
    split = df if shared else with_chunks(df, keys, order)
    local = _local([*keys, CHUNK], order, items)
    here = split.select("*", *[c.alias(f"_h_{n}") for n, c in local.items()])
    of_chunk = split.groupBy(*keys, CHUNK).agg(
        *[_of_chunk(item, order).alias(f"_s_{n}") for n, item in items.items()]
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = of_chunk.select(
        *keys,
        CHUNK,
        *[
            _carried(item, F.col(f"_s_{n}"), across, earlier).alias(f"_c_{n}")
            for n, item in items.items()
        ],
        F.count("*").over(Window.partitionBy(*keys)).alias("_chunks"),
    ).filter("_chunks > 1").drop("_chunks")
    out = matched(here, carried, [*keys, CHUNK]).select(
        *split.columns,
        *[
            _joined(item, F.col(f"_h_{n}"), F.col(f"_c_{n}")).alias(n)
            for n, item in items.items()
        ],
    )
    return out if shared else out.drop(CHUNK)


def clamped_sum(
    df: DataFrame, keys: list[str], order: list[str], delta: str,
    after: str = "depth", prior: str = "depth_before", bounded: bool = False,
) -> DataFrame:
    """Running sum that never falls below zero: d = max(0, d + delta).

    With S the plain running sum, d = S - least(0, lowest S so far). Each chunk hands
    on its total and its lowest S, so hot keys are cut as in `running`.
    """
    if bounded:
        by = Window.partitionBy(*keys).orderBy(*order)
        frame = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        low = df.withColumn("_s", F.sum(delta).over(frame)).withColumn("_m", F.min("_s").over(frame))
        low = low.withColumn("_m_prior", F.lag("_m").over(by))
        floor, floor_prior = F.least("_m", F.lit(0)), F.least("_m_prior", F.lit(0))
        return low.select(
            *df.columns, (F.col("_s") - floor).alias(after),
            (F.col("_s") - F.col(delta) - floor_prior).alias(prior),
        )
    split = with_chunks(df, keys, order)
    here = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = split.withColumn("_s", F.sum(delta).over(upto))
    lows = summed.withColumn("_m", F.min("_s").over(upto))
    of_chunk = summed.groupBy(*keys, CHUNK).agg(F.sum(delta).alias("_t"), F.min("_s").alias("_low"))
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = of_chunk.withColumn("_off", F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
    carried = offsets.select(
        *keys, CHUNK, "_off", F.min(F.col("_off") + F.col("_low")).over(earlier).alias("_g"),
        F.count("*").over(Window.partitionBy(*keys)).alias("_chunks"),
    ).filter("_chunks > 1").drop("_chunks")
    off = F.coalesce(F.col("_off"), F.lit(0))
    s_now = off + F.col("_s")
    s_prior = s_now - F.col(delta)
    low_now = F.least(F.col("_g"), off + F.col("_m"), F.lit(0))
    low_prior = F.least(F.col("_g"), off + F.col("_m_prior"), F.lit(0))
    lows = lows.withColumn("_m_prior", F.lag("_m").over(here))
    return matched(lows, carried, [*keys, CHUNK]).select(
        *df.columns,
        (s_now - low_now).alias(after),
        (s_prior - low_prior).alias(prior),
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rn", bounded: bool = False
) -> DataFrame:
    """1-based rank of each row in its group."""
    return running(df, keys, order, bounded, **{name: total(F.lit(1))})
