"""Streams of document versions, accesses and positions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from usetrail.operators.cache import keep_recent
from usetrail.operators.rules import severity
from usetrail.plans.scan import stacked


#: Groups that the keys of a stream are dealt to.
BUCKETS = 4096


def table_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, ts: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream; only files of `name` are taken.

    Event time must be a TIMESTAMP, so a zone-free column is cast.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    src = reader.parquet(folder)
    return src.withColumn(ts, F.col(ts).cast("timestamp")) if ts else src


def stream_latest(src: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Latest version per key, re-sent when it changes (update or complete mode)."""
    return src.groupBy(*keys).agg(F.max(F.struct(*order, *cols)).alias("_v")).select(
        *keys, *[F.col(f"_v.{c}").alias(c) for c in [*order, *cols]]
    )


def stream_counts(src: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key, re-sent on every change (update mode)."""
    return src.groupBy(*keys).agg(F.count("*").alias("n"))


def stream_expired(src: DataFrame, keys: list[str], ts: str, ttl: str, late: str) -> DataFrame:
    """Entries whose last touch is older than the TTL at the watermark (append mode).

    A session with the TTL as gap is the life of one entry; the watermark drops it
    from the state once it is over.
    """
    lives = src.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, ttl).alias("w"))
    return lives.agg(F.count("*").alias("touches"), F.max(ts).alias("last_ts")).select(
        *keys, "touches", "last_ts", F.col("w.end").alias("expires_at")
    )


def stream_findings(src: DataFrame) -> DataFrame:
    """Findings that need one row only: unguarded accesses in concurrent sections.

    `in_sync` is what the row itself tells (an atomic access); rules that look at other
    rows run per micro-batch through `per_batch`.
    """
    rated = src.filter(F.col("op").isin("read", "write")).withColumn(
        "severity", severity(F.col("is_atomic"), F.col("concurrent"), F.col("op") == "write")
    )
    return rated.filter(F.col("concurrent") & (F.col("severity") == "High"))


def stream_debounce(
    src: DataFrame, key: str, ts: str, value: str, delay_ms: int, late: str
) -> DataFrame:
    """Last change of each burst, fired after `delay_ms` of quiet; repeats are dropped.

    Rows wait in the state of their key until the watermark has passed them and are then
    applied in the order of time (ties by value), so rows that come late but within `late`
    count where they belong. Rows older than the watermark are dropped, as streams do.
    State per key: the last change, whether it still waits to fire, and the rows of the
    last `late` of time.
    """
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    out = f"`{key}` {fields[key]}, `{value}` {fields[value]}, pos bigint, fires_at bigint"
    state = f"value {fields[value]}, pos bigint, waiting boolean, ahead array<bigint>, changes array<{fields[value]}>"
    delay = delay_ms * 1000
    columns = [key, value, "pos", "fires_at"]

    def step(
        ids: tuple, batches: Iterator[pd.DataFrame], group: GroupState
    ) -> Iterator[pd.DataFrame]:
        last, pos, waiting, ahead, changes = group.get if group.exists else (None, None, False, [], [])
        rows = list(zip(ahead, changes))
        if not group.hasTimedOut:
            for batch in batches:
                rows += zip(batch["pos"].tolist(), batch[value].tolist())
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        passed = group.getCurrentWatermarkMs() * 1000
        ready = sum(at < passed for at, _ in rows)
        fired = []
        for at, new in rows[:ready]:
            if waiting and at - pos >= delay:
                fired.append((ids[0], last, pos, pos + delay))
                waiting = False
            if pos is None or new != last:
                last, pos, waiting = new, at, True
        rows = rows[ready:]
        if waiting and pos + delay < passed:
            fired.append((ids[0], last, pos, pos + delay))
            waiting = False
        group.update((last, pos, waiting, [at for at, _ in rows], [new for _, new in rows]))
        due = [at // 1000 + 1 for at, _ in rows[:1]]
        if waiting:
            due.append((pos + delay) // 1000 + 1)
        if due:
            group.setTimeoutTimestamp(max(min(due), group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(fired, columns=columns)

    return (
        src.withWatermark(ts, late).withColumn("pos", F.unix_micros(ts))
        .groupBy(key)
        .applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _in_order(
    src: DataFrame, key: str, ts: str, late: str, seq: str, value: str, own: dict[str, str], start: tuple,
    result: str, apply, rank=lambda row: row[:2], buckets: int = BUCKETS,
) -> DataFrame:
    """Run `apply(state, pos, seq, value)` over the rows of every key in the order of time and `seq`.

    It gives the next state and what to send with the row, or None for nothing. `rank` orders
    the rows (pos, seq, value) otherwise; it must begin with the time. Rows wait in
    the state of their key until the watermark has passed them; rows older than that are
    dropped, as streams do. The state is what `own` names (starting as `start`) and the
    rows of the last `late` of time; a key that is back at `start` is forgotten.

    A call per key costs far more than a row, so the keys are dealt to `buckets` groups whose
    state holds those of all their keys. A bucket is written anew in every batch that has one
    of its keys: with very many live keys and small batches, take more.
    """
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    parts = {"_keys": "string", **own, "_of": "string", "_at": "bigint", "_seq": fields[seq], "_value": fields[value]}
    state = ", ".join(f"{n} array<{t}>" for n, t in parts.items())
    out = f"_key string, `{seq}` {fields[seq]}, pos bigint, {result}"
    shown = result.split(" ")[0]
    columns = ["_key", seq, "pos", shown]

    def step(ids: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        cells = group.get if group.exists else [[] for _ in parts]
        held = {k: tuple(x) for k, *x in zip(*cells[: len(own) + 1], strict=True)}
        rows = list(zip(*cells[len(own) + 1 :], strict=True))
        if not group.hasTimedOut:
            for batch in batches:
                rows += zip(*(batch[c].tolist() for c in ("_key", "pos", seq, value)), strict=True)
        rows.sort(key=lambda row: rank(row[1:]))
        passed = group.getCurrentWatermarkMs() * 1000
        ready = sum(row[1] < passed for row in rows)
        sent = []
        for of, *row in rows[:ready]:
            now, told = apply(held.pop(of, start), *row)
            if tuple(now) != start:
                held[of] = now
            if told is not None:
                sent.append((of, row[1], row[0], told))
        rows = rows[ready:]
        group.update((
            list(held), *([x[i] for x in held.values()] for i in range(len(own))), *([row[i] for row in rows] for i in range(4)),
        ))
        if rows:
            group.setTimeoutTimestamp(max(rows[0][1] // 1000 + 1, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(sent, columns=columns)

    done = (
        src.withWatermark(ts, late)
        .select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), F.col(key).cast("string").alias("_key"),
                F.unix_micros(ts).alias("pos"), ts, seq, value)
        .groupBy("_bucket").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)
    )
    return done.select(F.col("_key").cast(fields[key]).alias(key), seq, "pos", shown)


def stream_hits(src: DataFrame, key: str, ts: str, seq: str, is_put: str, ttl: int, late: str) -> DataFrame:
    """Hit flag of every get of a cache where a get refreshes its entry (`cache.refreshing_hit`)."""

    def apply(state, pos, _, put):
        live, last = state
        if put:
            return (True, pos), None
        live = bool(live) and pos - last <= ttl
        return (live, pos), live

    return _in_order(src, key, ts, late, seq, is_put, {"live": "boolean", "last": "bigint"}, (False, None), "hit boolean", apply)


def stream_repeats(src: DataFrame, key: str, ts: str, seq: str, value: str, late: str) -> DataFrame:
    """Rows whose value differs from that of the row before (`cache.drop_repeats`), as `changed`."""
    kind = src.schema[value].dataType.simpleString()

    def apply(state, pos, _, new):
        any_, last = state
        return (True, new), (None if any_ and new == last else new)

    return _in_order(src, key, ts, late, seq, value, {"any_row": "boolean", "last": kind}, (False, None), f"changed {kind}", apply)


def stream_held(
    src: DataFrame, scope: list[str], ts: str, seq: str, lock: str, delta: str, shown: list[str], late: str
) -> DataFrame:
    """Uses with the number of locks held at them (`sync.held_at`), per scope.

    Rows with a lock and a delta of +1 or -1 are lock events, all others uses; an event at the
    time of a use comes before it. The depth of a lock never falls below zero. `shown` columns
    of a use come along. State: the locks held in the scope, and the rows of the last `late`.
    """
    fields = src.schema
    event = F.col(lock).isNotNull() & F.col(delta).isNotNull()
    facts = F.to_json(F.struct(
        F.when(event, F.col(lock)).alias("_lock"), F.when(event, F.col(delta)).alias("_delta"),
        F.when(~event, F.struct(*scope, *shown)).alias("_use"),
    ))
    rows = src.select(F.to_json(F.struct(*scope)).alias("_scope"), ts, seq, facts.alias("_facts"))

    def apply(state, pos, _, facts):
        row = json.loads(facts)
        if "_use" in row:
            return state, json.dumps({**row["_use"], "_held": len(state[0])})
        depths = dict(zip(*state, strict=True))
        depth = max(0, depths.pop(row["_lock"], 0) + row["_delta"])
        if depth:
            depths[row["_lock"]] = depth
        return (list(depths), list(depths.values())), None

    def events_first(row):
        return row[0], '"_use":' in row[2], row[1]

    held = _in_order(
        rows, "_scope", ts, late, seq, "_facts", {"locks": "array<string>", "depths": "array<bigint>"}, ([], []),
        "use string", apply, events_first,
    )
    kind = T.StructType([*(fields[c] for c in [*scope, *shown]), T.StructField("_held", T.LongType())])
    use = F.from_json("use", kind)
    return held.select(
        *[use[c].alias(c) for c in [*scope, *shown]], F.timestamp_micros("pos").alias(ts), "pos", seq,
        use["_held"].alias("held_keys"),
    )


def stream_group_findings(
    src: DataFrame, ts: str, seq: str, rules: dict[int, tuple[list[str], str, bool]], late: str
) -> DataFrame:
    """Findings that need several rows of a group, each sent once, as soon as the rows show it.

    `rules` gives per rule number the columns of its group, a flag and whether order counts. A
    group has a finding if it holds rows with and without the flag; where order counts, if
    a row without comes before the first one with. It stands on the group's first row without the
    flag (`found`); `pos` is the time of the row that completed it. NULL flags count as false.
    One state per rule and group: that row, whether the flag was seen, whether it was sent.
    """
    asked = [
        F.struct(
            F.lit(rule).alias("rule_id"), F.to_json(F.struct(*group)).alias("group"),
            (F.coalesce(F.col(flag), F.lit(False)).cast("int") + F.lit(2 * ordered)).alias("bits"),
        )
        for rule, (group, flag, ordered) in rules.items()
    ]
    rows = src.select(ts, seq, F.explode(F.array(*asked)).alias("_a")).select(
        F.concat_ws(" ", "_a.rule_id", "_a.group").alias("_key"), ts, seq, "_a.bits"
    )

    def apply(state, pos, number, bits):
        first, flagged, over = state
        if over:
            return state, None
        if bits & 1:
            flagged = True
        elif first is None:
            first = number
        if bits & 2:  # once the flag is there, later rows do not come before it
            return (first, flagged, bool(flagged)), first if flagged else None
        done = flagged and first is not None
        return (first, flagged, done), first if done else None

    kind = src.schema[seq].dataType.simpleString()
    own = {"first": kind, "flagged": "boolean", "over": "boolean"}
    sent = _in_order(rows, "_key", ts, late, seq, "bits", own, (None, False, False), f"found {kind}", apply)
    parts = F.split("_key", " ", 2)
    return sent.select(parts[0].cast("int").alias("rule_id"), parts[1].alias("group"), "found", "pos")


def keep_recent_batch(path: str, keys: list[str], order: list[str], n: int):
    """foreachBatch writer of the n most recent entries so far (`cache.keep_recent`).

    Each micro-batch writes a new version of the list, made of the version before it and its
    own rows: whatever is not among the n of the list can only come back by a later touch,
    which comes in a batch of its own. A repeated batch writes its version again.
    """

    def rule(batch: DataFrame, number: int) -> DataFrame:
        rows = batch.select(*keys, *order)
        if number:
            rows = stacked(rows, batch.sparkSession.read.schema(rows.schema).parquet(f"{path}/batch={number - 1}"))
        last = rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in order])
        return keep_recent(last, [*order, *keys], n)

    def write(batch: DataFrame, number: int) -> None:
        rule(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stream_recent(src: DataFrame, path: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Work off what is there now and give the n most recent entries after it."""
    writer = src.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(keep_recent_batch(f"{path}/table", keys, order, n)).start()
    query.awaitTermination()
    kept = T.StructType([src.schema[c] for c in [*keys, *order]])
    versions = src.sparkSession.read.schema(kept.add("batch", T.LongType())).parquet(f"{path}/table")
    return versions.join(versions.agg(F.max("batch").alias("batch")), "batch").drop("batch")


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Work off what is there now, write it to a table and read that back.

    Append streams use the file sink. Others write each micro-batch to a folder of its
    own number, so a repeated batch replaces itself; `batch` tells the order.
    """
    spark = df.sparkSession
    writer = df.writeStream.option("checkpointLocation", f"{path}/_checkpoint")
    writer = writer.trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/table").start()
    else:
        query = writer.foreachBatch(per_batch(f"{path}/table")).start()
    query.awaitTermination()
    return spark.read.schema(_read_schema(df, mode)).parquet(f"{path}/table")


def per_batch(path: str, rule=None):
    """foreachBatch writer; `rule` maps the micro-batch to what is written."""

    def write(batch: DataFrame, number: int) -> None:
        out = rule(batch) if rule else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _read_schema(df: DataFrame, mode: str) -> T.StructType:
    schema = T.StructType(list(df.schema.fields))
    return schema if mode == "append" else schema.add("batch", T.LongType())


def last_of_batches(written: DataFrame, keys: list[str]) -> DataFrame:
    """Final state of an update-mode table: the row of each key's last batch."""
    rest = [c for c in written.columns if c not in keys and c != "batch"]
    newest = written.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
