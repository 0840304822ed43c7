"""Keyed state over time: expiry, hits, most recent entries, repeats, bursts.

Times are whole numbers in one unit (here microseconds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions import fixed
from usetrail.plans.scan import (
    CHUNK, following, highest, matched, previous, running, with_chunks,
)

TTL = fixed.TTL_SECONDS * 1_000_000
QUIET = fixed.DEBOUNCE_MS * 1_000


def ttl_live(touches: DataFrame, keys: list[str], pos: str, now: Column, ttl: int = TTL) -> DataFrame:
    """Entries whose last touch is at most `ttl` old; older ones are dead.

    For documents pass puts and gets (a get refreshes), for trees puts only.
    """
    last = touches.groupBy(*keys).agg(F.max(pos).alias("last_pos"))
    return last.filter(now - F.col("last_pos") <= ttl)


def refreshing_hit(
    ops: DataFrame, keys: list[str], order: list[str], is_put: Column, ttl: int = TTL
) -> DataFrame:
    """Hit flag of every get where a get refreshes its entry.

    A get hits iff the key was put and no get since that put came more than `ttl`
    after the operation before it. A failed get does not insert, so once a gap was too
    long every get misses until the next put.
    """
    marked = ops.withColumn("_put", is_put)
    split = with_chunks(marked, keys, order)
    gaps = running(split, keys, order, _prev=previous(F.col(order[0])))
    late = ~F.col("_put") & (F.col(order[0]) - F.col("_prev") > ttl)
    at = F.struct(*order)
    state = running(
        gaps.withColumn("_late", late), keys, order,
        _last_put=highest(F.when(F.col("_put"), at)),
        _last_late=highest(F.when(F.col("_late"), at)),
    )
    fresh = F.col("_last_put").isNotNull() & F.coalesce(
        F.col("_last_put") > F.col("_last_late"), F.lit(True)
    )
    return state.filter(~F.col("_put")).select(*ops.columns, fresh.alias("hit"))


def _greedy(pos: np.ndarray, expiry: int, ttl: int) -> tuple[np.ndarray, int]:
    """Inserting requests of one sorted run, given when the entry before it expires."""
    miss = np.zeros(len(pos), dtype=bool)
    at = int(np.searchsorted(pos, expiry, side="right"))
    while at < len(pos):
        miss[at] = True
        expiry = int(pos[at]) + ttl
        at = int(np.searchsorted(pos, expiry, side="right"))
    return miss, expiry


NEVER = -(1 << 62)


def _plain(values) -> tuple:
    """A key whose missing parts compare equal."""
    return tuple(None if pd.isna(v) else v for v in values)


def _walk(keys: list[str], order: list[str], ttl: int):
    """Flag inserts in rows sorted by key and position; only the last expiry is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, expiry = None, NEVER
        by = [*keys, CHUNK]
        for batch in batches:
            if not len(batch):
                continue
            pos = batch[order[0]].to_numpy()
            codes = np.stack([pd.factorize(batch[c])[0] for c in by], axis=1)
            starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]).any(axis=1)))
            hit = np.zeros(len(batch), dtype=bool)
            for start, end in zip(starts, [*starts[1:], len(batch)]):
                key = _plain(batch[by].iloc[start])
                if start or key != last:
                    expiry = int(batch["_carry"].iloc[start])
                last = key
                miss, expiry = _greedy(pos[start:end], expiry, ttl)
                hit[start:end] = ~miss
            out = batch.drop(columns=["_carry"])
            out["hit"] = hit
            yield out

    return run


def _steps_of_chunk(keys: list[str], order: list[str], ttl: int):
    """What a chunk does to the expiry handed to it, as a step function.

    An insert made before the chunk matters only through its expiry e. Every e from
    just below row i - 1 up to just below row i makes row i the first insert; the
    chain from there is fixed. Neighbouring starts with the same end are one step:
    `upto` is the first e (exclusive) that the step no longer covers.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(group[order[0]].to_numpy())
        nxt = np.searchsorted(pos, pos + ttl, side="right")
        # follow the chain of inserts to its last one by doubling
        jump = np.where(nxt < len(pos), nxt, np.arange(len(pos)))
        while not np.array_equal(jump[jump], jump):
            jump = jump[jump]
        end = pos[jump]
        # no expiry from before can reach past the first `ttl` of the chunk
        reach = int(np.searchsorted(pos, pos[0] + ttl, side="right"))
        starts, ends = pos[: reach + 1], end[: reach + 1]
        last = np.append(ends[1:] != ends[:-1], True)
        head = {k: group[k].iloc[0] for k in [*keys, CHUNK]}
        return pd.DataFrame({**head, "upto": starts[last], "expiry": ends[last] + ttl})

    return run


def _fold(keys: list[str]):
    """Hand the expiry from chunk to chunk; rows are steps, sorted by chunk and `upto`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, chunk, expiry, incoming, done = None, None, NEVER, NEVER, False
        for batch in batches:
            rows = []
            for *key, number, upto, after in batch[[*keys, CHUNK, "upto", "expiry"]].itertuples(
                index=False
            ):
                key = _plain(key)
                if key != current:
                    current, chunk, expiry = key, None, NEVER
                if number != chunk:
                    chunk, incoming, done = number, expiry, False
                    rows.append((*key, number, incoming))
                if not done and incoming < upto:
                    expiry, done = after, True
            yield pd.DataFrame(rows, columns=[*keys, CHUNK, "_carry"])

    return run


def asof_hit(requests: DataFrame, keys: list[str], order: list[str], ttl: int = TTL) -> DataFrame:
    """Hit flag of every request where a hit does not refresh.

    A miss inserts the entry and later requests hit until `ttl` after that insert, so
    inserts are greedy steps of more than `ttl`. The walk along one key needs only
    the last expiry. Where a key spans several chunks, each chunk is first reduced to its
    step function, these are folded per key, and the chunks then walk side by side from
    the expiry handed to them.
    """
    split = with_chunks(requests, keys, order)
    types = {f.name: f.dataType.simpleString() for f in split.schema.fields}
    key_ddl = ", ".join(f"`{k}` {types[k]}" for k in [*keys, CHUNK])
    bounds = split.groupBy(*keys).agg(F.min(CHUNK).alias("_a"), F.max(CHUNK).alias("_b")).filter("_a < _b")
    cut = matched(split.select(*keys, CHUNK, order[0]), bounds, keys).filter("_b IS NOT NULL")
    steps = cut.drop("_a", "_b").groupBy(*keys, CHUNK).applyInPandas(
        _steps_of_chunk(keys, order, ttl), f"{key_ddl}, upto bigint, expiry bigint"
    )
    carry = (
        steps.repartition(*keys).sortWithinPartitions(*keys, CHUNK, "upto")
        .mapInPandas(_fold(keys), f"{key_ddl}, _carry bigint")
    )
    ready = matched(split, carry, [*keys, CHUNK]).withColumn("_carry", F.coalesce("_carry", F.lit(NEVER)))
    return _walked(ready, keys, order, ttl, types)


def _walked(ready: DataFrame, keys: list[str], order: list[str], ttl: int, types: dict) -> DataFrame:
    ddl = ", ".join(f"`{c}` {t}" for c, t in types.items())
    rows = ready.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, *order)
    return rows.mapInPandas(_walk(keys, order, ttl), f"{ddl}, hit boolean").drop(CHUNK)


def keep_recent(entries: DataFrame, order: list[str], n: int = fixed.MAX_DOCUMENTS) -> DataFrame:
    """The n most recent entries."""
    return entries.orderBy(*[F.desc(c) for c in order]).limit(n)


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the row directly before."""
    marked = running(df.withColumn("_v", value), keys, order, _prev=previous(F.col("_v")))
    return marked.filter(~F.col("_v").eqNullSafe(F.col("_prev"))).select(*df.columns)


def debounce(
    df: DataFrame, keys: list[str], order: list[str], delay: int = QUIET, value: Column | None = None
) -> DataFrame:
    """The last row of each burst, fired after `delay` of quiet.

    With `value`, rows that repeat the one before are dropped first and do not restart
    the timer. Both steps go by the same ranges, written once.
    """
    base = with_chunks(df, keys, order)
    if value is not None:
        base = drop_repeats(base, keys, order, value)
    seen = running(base, keys, order, _next=following(F.col(order[0])))
    gap = F.col("_next") - F.col(order[0])
    return seen.filter(F.col("_next").isNull() | (gap >= delay)).select(
        *df.columns, (F.col(order[0]) + delay).alias("fires_at")
    )
