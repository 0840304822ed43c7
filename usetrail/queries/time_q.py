"""Keyed state over time, in batch and as streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from usetrail.operators import cache
from usetrail.queries.graph_q import GREEDY_SQL, HOUR, TTL
from usetrail.queries.registry import query
from usetrail.queries.rules_q import HELD_SQL
from usetrail.session import scratch_dir
from usetrail.sources import views as v
from usetrail.streaming import streams

ORDER = ["pos", "seq"]


def accesses(spark, sf_dir, ops=None):
    return v.access_view(v.table(spark, sf_dir, "events"), ops)


@query(f"""
WITH {v.ACCESS_SQL}
SELECT entity, max(pos) AS last_pos FROM v_access GROUP BY entity
HAVING (SELECT max(pos) FROM v_access) - max(pos) <= {TTL}
""")
def ttl_live(spark, sf_dir):
    rows = accesses(spark, sf_dir).select("entity", "pos")
    now = rows.agg(F.max("pos")).scalar()
    return cache.ttl_live(rows, ["entity"], "pos", now, TTL)


@query(f"""
WITH {v.ACCESS_SQL},
o AS (SELECT entity, pos, seq, op = 'write' AS put FROM v_access WHERE op IN ('read', 'write')),
g AS (SELECT *, sum(CASE WHEN put THEN 1 ELSE 0 END) OVER w AS epoch,
             pos - lag(pos) OVER w AS gap FROM o WINDOW w AS (PARTITION BY entity ORDER BY pos, seq)),
h AS (SELECT *, min(CASE WHEN put OR gap <= {TTL} THEN 1 ELSE 0 END) OVER (
        PARTITION BY entity, epoch ORDER BY pos, seq) AS fresh FROM g)
SELECT seq, entity, epoch > 0 AND fresh = 1 AS hit FROM h WHERE NOT put
""")
def refreshing_hit(spark, sf_dir):
    ops = accesses(spark, sf_dir, ["read", "write"]).select("entity", "pos", "seq", "op")
    hits = cache.refreshing_hit(ops, ["entity"], ORDER, F.col("op") == "write", TTL)
    return hits.select("seq", "entity", "hit")


@query(f"WITH RECURSIVE {v.ACCESS_SQL}, {GREEDY_SQL} SELECT seq, entity, hit FROM v_hits")
def asof_hit(spark, sf_dir):
    requests = accesses(spark, sf_dir).select("entity", "pos", "seq")
    return cache.asof_hit(requests, ["entity"], ORDER, TTL).select("seq", "entity", "hit")


@query("""
SELECT user_id, max(epoch_us(ts)) AS pos FROM events GROUP BY user_id
ORDER BY pos DESC, user_id DESC LIMIT 50
""")
def keep_recent(spark, sf_dir):
    last = accesses(spark, sf_dir).groupBy(F.col("ctx").alias("user_id")).agg(F.max("pos").alias("pos"))
    return cache.keep_recent(last, ["pos", "user_id"], 50)


REPEAT_SQL = """
v_prev AS (SELECT *, lag(op) OVER (PARTITION BY ctx ORDER BY pos, seq) AS prev FROM v_access),
v_moves AS (SELECT * FROM v_prev WHERE prev IS NULL OR prev <> op),
v_next AS (SELECT *, lead(pos) OVER (PARTITION BY ctx ORDER BY pos, seq) AS next FROM v_moves)
"""


@query(f"WITH {v.ACCESS_SQL}, {REPEAT_SQL} SELECT seq, ctx, op FROM v_moves")
def drop_repeats(spark, sf_dir):
    rows = accesses(spark, sf_dir).select("seq", "ctx", "pos", "op")
    return cache.drop_repeats(rows, ["ctx"], ORDER, F.col("op")).select("seq", "ctx", "op")


@query(f"""
WITH {v.ACCESS_SQL}, {REPEAT_SQL}
SELECT seq, ctx, op, pos + {TTL} AS fires_at FROM v_next WHERE next IS NULL OR next - pos >= {TTL}
""")
def debounce(spark, sf_dir):
    rows = accesses(spark, sf_dir).select("seq", "ctx", "pos", "op")
    return cache.debounce(rows, ["ctx"], ORDER, TTL, F.col("op")).select(
        "seq", "ctx", "op", "fires_at"
    )


# --- the same as streams -------------------------------------------------------
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark, sf_dir):
    return streams.table_stream(spark, sf_dir, "events", EVENTS, "ts")


@query("""
SELECT user_id, pos, event_id, event_type FROM (
  SELECT user_id, epoch_us(ts) AS pos, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def stream_latest(spark, sf_dir):
    src = event_stream(spark, sf_dir).withColumn("pos", v.micros("ts"))
    latest = streams.stream_latest(src, ["user_id"], ["pos", "event_id"], ["event_type"])
    written = streams.run_to_table(latest, scratch_dir(spark, "latest"), "update")
    return streams.last_of_batches(written, ["user_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, sf_dir):
    counts = streams.stream_counts(event_stream(spark, sf_dir), ["event_type"])
    written = streams.run_to_table(counts, scratch_dir(spark, "counts"), "update")
    return streams.last_of_batches(written, ["event_type"])


# the watermark ends at the last event less one hour, in whole milliseconds
WATERMARK = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)"


@query(f"""
WITH g AS (
  SELECT user_id, epoch_us(ts) AS pos, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= {TTL}
    THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS life FROM g)
SELECT user_id, count(*) AS touches, max(pos) AS last_pos, max(pos) + {TTL} AS expires_at
FROM s GROUP BY user_id, life HAVING max(pos) + {TTL} <= {WATERMARK}
""")
def stream_expired(spark, sf_dir):
    dead = streams.stream_expired(event_stream(spark, sf_dir), ["user_id"], "ts", "6 hours", "1 hour")
    written = streams.run_to_table(dead, scratch_dir(spark, "expired"))
    return written.select(
        "user_id", "touches", F.unix_micros("last_ts").alias("last_pos"),
        F.unix_micros("expires_at").alias("expires_at"),
    )


@query(f"""
WITH {v.ACCESS_SQL}, {REPEAT_SQL}
SELECT ctx, op, pos, pos + {TTL} AS fires_at FROM v_next
WHERE (next IS NULL OR next - pos >= {TTL}) AND pos + {TTL} < {WATERMARK}
""")
def stream_debounce(spark, sf_dir):
    src = event_stream(spark, sf_dir)
    rows = src.select(
        F.col("user_id").alias("ctx"), "ts", v.op_of(F.col("event_type")).alias("op")
    )
    fired = streams.stream_debounce(rows, "ctx", "ts", "op", 6 * HOUR // 1000, "1 hour")
    return streams.run_to_table(fired, scratch_dir(spark, "debounce"))


@query(f"""
WITH {v.ACCESS_SQL}
SELECT seq, entity, ctx, 'High' AS severity FROM v_access
WHERE op IN ('read', 'write') AND concurrent AND NOT is_atomic
""")
def stream_findings(spark, sf_dir):
    rows = v.access_view(event_stream(spark, sf_dir), ["read", "write"])
    found = streams.stream_findings(rows).select("seq", "entity", "ctx", "severity")
    return streams.run_to_table(found, scratch_dir(spark, "stream-findings"))



@query(f"""
WITH {v.ACCESS_SQL},
o AS (SELECT entity, pos, seq, op = 'write' AS put FROM v_access WHERE op IN ('read', 'write')),
g AS (SELECT *, sum(CASE WHEN put THEN 1 ELSE 0 END) OVER w AS epoch,
             pos - lag(pos) OVER w AS gap FROM o WINDOW w AS (PARTITION BY entity ORDER BY pos, seq)),
h AS (SELECT *, min(CASE WHEN put OR gap <= {TTL} THEN 1 ELSE 0 END) OVER (
        PARTITION BY entity, epoch ORDER BY pos, seq) AS fresh FROM g)
SELECT seq, entity, epoch > 0 AND fresh = 1 AS hit FROM h
WHERE NOT put AND pos < (SELECT max(pos) // 1000 * 1000 - 3600000000 FROM o)
""")
def stream_hits(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(
        F.get_json_object("props", "$.k").cast("int").alias("entity"), "ts", F.col("event_id").alias("seq"),
        v.op_of(F.col("event_type")).alias("op"),
    ).filter(F.col("entity").isNotNull() & F.col("op").isin("read", "write"))
    asked = rows.select("entity", "ts", "seq", (F.col("op") == "write").alias("put"))
    hits = streams.stream_hits(asked, "entity", "ts", "seq", "put", TTL, "1 hour")
    return streams.run_to_table(hits, scratch_dir(spark, "stream-hits")).select("seq", "entity", "hit")


@query(f"""
WITH {v.ACCESS_SQL}, {REPEAT_SQL}
SELECT seq, ctx, op FROM v_moves WHERE pos < {WATERMARK}
""")
def stream_repeats(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("ctx"), "ts", F.col("event_id").alias("seq"), v.op_of(F.col("event_type")).alias("op")
    )
    moves = streams.stream_repeats(rows, "ctx", "ts", "seq", "op", "1 hour")
    written = streams.run_to_table(moves, scratch_dir(spark, "stream-repeats"))
    return written.select("seq", "ctx", F.col("changed").alias("op"))


@query("""
SELECT user_id, max(epoch_us(ts)) AS pos FROM events GROUP BY user_id
ORDER BY pos DESC, user_id DESC LIMIT 50
""")
def stream_recent(spark, sf_dir):
    src = event_stream(spark, sf_dir).select("user_id", v.micros("ts").alias("pos"))
    return streams.stream_recent(src, scratch_dir(spark, "stream-recent"), ["user_id"], ["pos"], 50)


def held_stream(spark, sf_dir):
    """Uses of the event stream with their lock state, written by a stream of their own."""
    src = event_stream(spark, sf_dir)
    rows = v.access_view(src, ["read", "write", "acquire", "release"]).withColumn("ts", F.timestamp_micros("pos"))
    delta = F.when(F.col("op") == "acquire", 1).when((F.col("op") == "release") & ~F.col("deferred"), -1)
    # a deferred release is no event and no use
    rows = rows.withColumn("delta", delta).filter(F.col("delta").isNotNull() | F.col("op").isin("read", "write"))
    shown = ["entity", "op", "is_atomic", "is_field"]
    return streams.stream_held(rows, ["ctx", "day"], "ts", "seq", "lock_key", "delta", shown, "1 hour")


SEEN_SQL = "v_seen AS (SELECT max(pos) // 1000 * 1000 - 3600000000 AS upto FROM v_access WHERE op <> 'decl' AND NOT deferred)"


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}, {SEEN_SQL}
SELECT seq, ctx, day, held_keys FROM v_assessed, v_seen WHERE pos < upto
""")
def stream_held(spark, sf_dir):
    held = streams.run_to_table(held_stream(spark, sf_dir), scratch_dir(spark, "stream-held"))
    return held.select("seq", "ctx", "day", "held_keys")


def _once_sql(rule: int, group: str, names: str, flag: str, ordered: bool) -> str:
    """The first row without the flag of every group that has both, and when the later of them came."""
    early = "AND min(pos) FILTER (WHERE NOT flag) < min(pos) FILTER (WHERE flag)" if ordered else ""
    return f"""
SELECT {rule} AS rule_id, {names} AS "group", arg_min(seq, pos) FILTER (WHERE NOT flag) AS found,
  greatest(min(pos) FILTER (WHERE flag), min(pos) FILTER (WHERE NOT flag)) AS pos
FROM (SELECT *, {flag} AS flag FROM v_uses) GROUP BY {group}
HAVING bool_or(flag) AND NOT bool_and(flag) {early}"""


GROUP_NAME = """'{"entity":' || entity || ',"day":"' || day || '"}'"""
CTX_NAME = """'{"entity":' || entity || ',"ctx":' || ctx || '}'"""


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}, {SEEN_SQL},
v_first AS (SELECT * FROM v_assessed, v_seen WHERE pos < upto AND is_field),
v_uses AS (SELECT * FROM v_first WHERE pos < (SELECT max(pos) // 1000 * 1000 - 3600000000 FROM v_first))
{_once_sql(2, 'entity, day', GROUP_NAME, 'is_atomic', False)}
UNION ALL {_once_sql(3, 'entity, day', GROUP_NAME, 'in_sync', False)}
UNION ALL {_once_sql(7, 'entity, ctx', CTX_NAME, "op = 'write'", True)}
""")
def stream_group_findings(spark, sf_dir):
    # two streams: locks go by context, findings by entity
    folder = scratch_dir(spark, "stream-group-findings")
    held = streams.run_to_table(held_stream(spark, sf_dir), f"{folder}/held")
    src = spark.readStream.schema(held.schema).parquet(f"{folder}/held/table").filter("is_field")
    uses = src.withColumn("in_sync", F.col("is_atomic") | (F.col("held_keys") > 0)).withColumn("writes", F.col("op") == "write")
    rules = {
        2: (["entity", "day"], "is_atomic", False), 3: (["entity", "day"], "in_sync", False),
        7: (["entity", "ctx"], "writes", True),
    }
    found = streams.stream_group_findings(uses, "ts", "seq", rules, "1 hour")
    return streams.run_to_table(found, f"{folder}/found")
