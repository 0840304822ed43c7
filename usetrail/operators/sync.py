"""Lock state: events, clamped depth, held locks, synchronised accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions.columns import is_atomic_name, is_mutex_method
from usetrail.plans.intervals import inside_any
from usetrail.plans.scan import clamped_sum, running, stacked, together, total


def lock_events(accesses: DataFrame) -> DataFrame:
    """Acquire and release rows as +1 / -1 with a trimmed, non-empty key."""
    delta = F.when(F.col("op") == "acquire", F.lit(1)).when(F.col("op") == "release", F.lit(-1))
    keyed = accesses.withColumn("delta", delta.cast("long")).withColumn(
        "lock_key", F.trim("lock_key")
    )
    return keyed.filter(F.col("delta").isNotNull() & (F.col("lock_key") != ""))


def drop_deferred(events: DataFrame) -> DataFrame:
    """A deferred release runs at scope end, so the lock stays held until there."""
    return events.filter(~((F.col("delta") < 0) & F.coalesce("deferred", F.lit(False))))


def lock_depth(events: DataFrame, scope: list[str], order: list[str], bounded: bool = False) -> DataFrame:
    """Depth of each lock after each event, never below zero."""
    return clamped_sum(events, [*scope, "lock_key"], order, "delta", bounded=bounded)


def held_at(
    accesses: DataFrame, events: DataFrame, scope: list[str], order: list[str], bounded: bool = False
) -> DataFrame:
    """Number of locks held at each access within its scope (context and block).

    Only the events where a lock turns held or free matter (+1 / -1); their running
    sum over the scope is the count of held locks. An event at the position of an
    access comes before it. `bounded`: a scope comes out of one stored row (as in `running`);
    scopes are no NULLs then.
    """
    depths = lock_depth(events, scope, order, bounded)
    turn = (F.col("depth") > 0).cast("long") - (F.col("depth_before") > 0).cast("long")
    turns = depths.select(*scope, *order, turn.alias("_turn")).filter("_turn <> 0")
    pos, *ties = order
    uses = accesses.withColumn("_turn", F.lit(0).cast("long")).withColumn("_is_access", F.lit(1))
    turns = turns.withColumn("_is_access", F.lit(0))
    timeline = together(uses, turns, scope) if bounded else stacked(uses, turns, partial=True)
    counted = running(
        timeline, scope, [pos, "_is_access", *ties], bounded, held_keys=total(F.col("_turn"))
    )
    return counted.filter("_is_access = 1").drop("_turn", "_is_access")


def sync_functions(bodies: DataFrame, name: str, is_sync: Column) -> DataFrame:
    """Names of functions whose body holds a synchronising call."""
    return bodies.filter(is_sync).select(F.col(name)).distinct()


def flag_calls(calls: DataFrame, names: DataFrame, callee: str, into: str = "in_sync_fn") -> DataFrame:
    """True where a call goes to a synchronising function, matched by simple name."""
    key = names.columns[0]
    found = names.select(F.col(key).alias("_name"), F.lit(True).alias("_hit"))
    joined = calls.join(found, F.col(callee) == F.col("_name"), "left")
    return joined.select(*calls.columns, F.coalesce("_hit", F.lit(False)).alias(into))


def sync_call_flag(calls: DataFrame, package: str, method: str) -> DataFrame:
    """True for mutex and atomic calls."""
    flag = is_mutex_method(F.col(method)) | is_atomic_name(F.col(package), F.col(method))
    return calls.withColumn("is_sync_call", flag)


def block_has_sync(points: DataFrame, rows: DataFrame, block: list[str], is_sync: Column) -> DataFrame:
    """True where the block of a point holds any synchronising call, at any place."""
    some = rows.groupBy(*block).agg(F.bool_or(is_sync).alias("block_sync"))
    return points.join(some, block, "left").select(
        *points.columns, F.coalesce("block_sync", F.lit(False)).alias("block_sync")
    )


def in_atomic(points: DataFrame, calls: DataFrame, on: list[str]) -> DataFrame:
    """True for points inside the interval of an atomic call."""
    return inside_any(points, calls, on, "in_atomic")


def is_synchronized(accesses: DataFrame, *flags: Column, fallback: Column | None = None) -> DataFrame:
    """Synchronised: under a synchronising call, or some lock is held.

    `fallback` (the block-level answer) serves rows whose lock state is unknown.
    """
    held = F.col("held_keys") > 0
    state = F.coalesce(held, fallback) if fallback is not None else F.coalesce(held, F.lit(False))
    for flag in flags:
        state = F.coalesce(flag, F.lit(False)) | state
    return accesses.withColumn("in_sync", state)
