"""Points in intervals without a nested loop.

`containing_spans` gives the pairs, `best_containing` and `first_containing` one span per point
without making pairs, `inside_any` only whether there is one. None depends on how the
positions are spread: bins hold equal numbers of points, cells follow the spans.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.plans.scan import highest, latest, listed, running, stacked, together, total
from usetrail.session import staged

BIN = "_bin"
#: Points of one bin.
BIN_ROWS = 512


def containing_spans(
    points: DataFrame,
    spans: DataFrame,
    on: list[str],
    point: str = "pos",
    start: str = "start_pos",
    end: str = "end_pos",
    how: str = "inner",
    bounded: bool = False,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Every (point, span) pair with start <= point <= end, both ends inclusive.

    Other than `on`, the two sides must not share column names. The points of a group are
    numbered in order and cut into bins of equal numbers; a span is copied to the bins of the
    points it may hold, so a span without points is not copied at all, and a dense place makes
    more bins, not fuller ones. `bounded`: a group comes out of one stored row (as in `running`);
    its points and spans then meet as lists, so what is spread by `on` is not shuffled.
    """
    union = together if bounded else lambda a, b, _: stacked(a, b, partial=True)
    is_point = F.when(F.col("_turn") == 1, 1).otherwise(0)
    asked = points.select(
        *on, F.col(point).alias("_at"), F.lit(1).alias("_turn"), F.struct(*points.columns).alias("_point")
    )
    opened = spans.filter(F.col(start) <= F.col(end)).select(
        *on, F.col(start).alias("_at"), F.lit(0).alias("_turn"), F.struct(*spans.columns).alias("_span")
    )
    ranked = running(
        union(asked, opened, on), on, ["_at", "_turn"], bounded, _rank=total(is_point, exclusive=True)
    )
    # few rows, and dealt anew by bin: every sort of a longer stage would hold a page of memory of its own
    binned_points = ranked.filter("_turn = 1").select("_point.*", F.expr(f"_rank div {bin_rows}").alias(BIN))
    closed = ranked.filter("_turn = 0").select(
        *on, F.col(f"_span.{end}").alias("_at"), F.lit(2).alias("_turn"), "_span", F.col("_rank").alias("_from")
    )
    counted = running(
        union(asked.drop("_point"), closed, on), on, ["_at", "_turn"], bounded, _upto=total(is_point)
    )
    binned_spans = counted.filter("_turn = 2 AND _upto > _from").select(
        "_span.*", F.explode(F.expr(f"sequence(_from div {bin_rows}, (_upto - 1) div {bin_rows})")).alias(BIN)
    )
    match = F.col(f"p.{point}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    for key in [*on, BIN]:
        match = match & (F.col(f"p.{key}") == F.col(f"s.{key}"))
    joined = binned_points.alias("p").join(binned_spans.alias("s"), match, how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*[F.col(f"p.{c}") for c in points.columns])
    kept = [F.col(f"s.{c}") for c in spans.columns if c not in on]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *kept)


def best_containing(
    points: DataFrame, spans: DataFrame, on: list[str], best: Column, point: str = "pos",
    start: str = "start_pos", end: str = "end_pos", into: str = "best", growth: int = 8, bounded: bool = False,
) -> DataFrame:
    """Each point with the least `best` of the spans that hold it, both ends inclusive.

    Spans may nest, cross and be ranked by anything. A span is the union of aligned cells
    whose widths are powers of `growth` (a power of two), fewer than 2 * growth of each width;
    of all spans only the least `best` of a cell is kept. A point then asks the one cell of
    each width around it, so it meets as many rows as there are widths, not as many as there
    are spans. Points in no span give no row; repeated points stay. `bounded`: a group comes out
    of one stored row (as in `running`); its spans and points then meet as two lists.
    """
    if bounded:
        return _best_in_place(points, spans, on, best, point, start, end, into)
    bits = growth.bit_length() - 1
    spans = spans.filter(F.col(start) <= F.col(end)).select(
        *on, F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to"), best.alias(into)
    )
    # The whole cells of width growth ** k in the span are numbers lo to hi - 1; those that make
    # up whole cells of the next width (lo1 to hi1 - 1) are left to it.
    width = F.floor(F.log2(F.col("_to") - F.col("_from") + 1) / bits).cast("int") + 1

    def ends(k: Column) -> Column:
        lo = F.call_function("shiftright", F.col("_from") - 1, k * bits) + 1
        hi = F.call_function("shiftright", F.col("_to") + 1, k * bits)
        return F.struct(k.alias("k"), lo.alias("lo"), hi.alias("hi"))

    def own(x: Column, above: Column) -> Column:
        none = F.array().cast("array<bigint>")

        def listed(a: Column, b: Column) -> Column:
            return F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

        lo1, hi1 = above["lo"] * growth, above["hi"] * growth
        split = F.concat(listed(x["lo"], lo1), listed(hi1, x["hi"]))
        cells = F.when(above["lo"] >= above["hi"], listed(x["lo"], x["hi"])).otherwise(split)
        return F.transform(cells, lambda c: F.struct(x["k"].alias("_k"), c.alias("_cell")))

    levels = spans.withColumn("_ends", F.transform(F.sequence(F.lit(0), width + 1), ends))
    pairs = F.zip_with(F.expr("slice(_ends, 1, size(_ends) - 1)"), F.expr("slice(_ends, 2, size(_ends) - 1)"), own)
    cells = levels.select(*on, into, F.inline(F.flatten(pairs))).groupBy(*on, "_k", "_cell").agg(
        F.min(into).alias(into)
    )
    cells = staged(cells, "cells")  # read twice
    widths = cells.groupBy(*on).agg(F.max("_k").alias("_most"))
    repeated = points.groupBy(*points.columns).agg(F.count("*").alias("_times"))
    around = F.expr(f"transform(sequence(0, _most), k -> struct(k AS _k, shiftright({point}, k * {bits}) AS _cell))")
    asked = repeated.join(widths, on).select(*points.columns, "_times", F.inline(around))
    found = asked.join(cells, [*on, "_k", "_cell"]).groupBy(*points.columns, "_times").agg(F.min(into).alias(into))
    return found.select(*points.columns, into, F.explode(F.expr("sequence(1, _times)"))).drop("col")


def _holders(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the first of the spans, in the order given, that holds each point; -1 for none.

    Every span takes the points that no span before it took; what is taken is skipped over.
    """
    places, back = np.unique(at, return_inverse=True)
    holder, after = [-1] * len(places), list(range(len(places) + 1))

    def free(i: int) -> int:
        top = i
        while after[top] != top:
            top = after[top]
        while after[i] != top:
            after[i], i = top, after[i]
        return top

    firsts, ends = np.searchsorted(places, starts, "left").tolist(), np.searchsorted(places, ends, "right").tolist()
    for number, (first, end) in enumerate(zip(firsts, ends, strict=True)):
        i = free(first)
        while i < end:
            holder[i], after[i] = number, i + 1
            i = free(i)
    return np.array(holder, np.int32)[back]


def _numbers_of_holders(points: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for at, lo, hi in zip(points, starts, ends, strict=True):
        held = _holders(*(x.values.to_numpy(zero_copy_only=False) for x in (at, lo, hi)))
        out.append(pa.array(held, mask=held < 0))
    return pa.array(out, pa.list_(pa.int32()))


def _best_in_place(
    points: DataFrame, spans: DataFrame, on: list[str], best: Column, point: str, start: str, end: str, into: str
) -> DataFrame:
    """`best_containing` over groups that fit a task: one list of spans in the order of `best` per group."""
    ordered = listed(spans.filter(F.col(start) <= F.col(end)).select(
        *on, best.alias("_best"), F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to")
    ), on, "_spans").withColumn("_spans", F.sort_array("_spans"))
    lists = listed(points.filter(F.col(point).isNotNull()), on, "_points").join(ordered, on)
    part = lambda name, field: F.transform(name, lambda x: x[field].cast("long"))
    numbers = F.arrow_udf(_numbers_of_holders, "array<int>")(part("_points", point), part("_spans", "_from"), part("_spans", "_to"))
    pairs = F.zip_with("_points", "_n", lambda p, n: F.struct(p.alias("_p"), F.get("_spans", n)["_best"].alias(into)))
    found = lists.withColumn("_n", numbers).select(*on, F.inline(pairs))
    return found.filter(F.col(into).isNotNull()).select(*on, "_p.*", into).select(*points.columns, into)


def first_containing(
    points: DataFrame, spans: DataFrame, on: list[str], into: str, point: str = "pos",
    start: str = "start_pos", end: str = "end_pos", bounded: bool = False,
) -> DataFrame:
    """Each point with the first span that holds it, by start and then the longer one.

    A span that ends no later than one that starts before it is never first. The others end
    one after the other as they start, so the first that holds a point is the first that
    ends at or after it: two ordered scans. Points in no span give no row.
    """
    others = [c for c in spans.columns if c not in (*on, start, end)]
    whole = spans.filter(F.col(start) <= F.col(end)).withColumn("_back", -F.col(end))
    reached = running(whole, on, [start, "_back", *others], bounded, _reach=highest(F.col(end), exclusive=True))
    first = reached.filter(F.col("_reach").isNull() | (F.col(end) > F.col("_reach")))
    asked = points.select(
        *on, (-F.col(point)).alias("_at"), F.lit(1).alias("_turn"), F.struct(*points.columns).alias("_point")
    )
    ends = first.select(
        *on, F.col("_back").alias("_at"), F.lit(0).alias("_turn"), F.struct(start, end, *others).alias("_span")
    )
    scanned = running(
        stacked(asked, ends, partial=True), on, ["_at", "_turn"], bounded, _found=latest(F.col("_span"))
    )
    held = scanned.filter((F.col("_turn") == 1) & (F.col(f"_found.{start}") <= -F.col("_at")))
    return held.select("_point.*", F.col("_found").alias(into))


def inside_any(
    points: DataFrame, spans: DataFrame, on: list[str], into: str, point: str = "pos",
    start: str = "start_pos", end: str = "end_pos", bounded: bool = False,
) -> DataFrame:
    """Whether each point lies in any span, both ends inclusive.

    A point is inside if the furthest end among the spans that start no later reaches it:
    one ordered scan, whatever the density. Points keep their columns, NULLs and repeats;
    a NULL key or position is in no span.
    """
    keyed = reduce(and_, [F.col(c).isNotNull() for c in on])
    asked = points.select(
        *on, F.col(point).alias("_at"), F.lit(1).alias("_turn"), F.struct(*points.columns).alias("_point"),
    )
    starts = spans.filter(keyed & F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *on, F.col(start).alias("_at"), F.lit(0).alias("_turn"), F.col(end).alias("_end")
    )
    scanned = running(
        stacked(asked, starts, partial=True), on, ["_at", "_turn"], bounded, _reach=highest(F.col("_end"))
    )
    return scanned.filter("_turn = 1").select(
        "_point.*", F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False)).alias(into)
    )
