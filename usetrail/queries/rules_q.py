"""Lock state, severity and hazard rules."""

from pyspark.sql import functions as F

from usetrail.functions.columns import lock_delta
from usetrail.operators import rules, structure, sync
from usetrail.plans import hazards
from usetrail.plans.scan import following, running
from usetrail.queries.registry import query
from usetrail.sources import views as v

SCOPE = ["ctx", "day"]  # a lock ends with its block, here the day
GROUP = ["entity", "day"]
ORDER = ["pos", "seq"]


USES, LOCKS = ["read", "write"], ["acquire", "release"]


def accesses(spark, sf_dir, ops=None):
    return v.access_view(v.table(spark, sf_dir, "events"), ops)


def assessed(spark, sf_dir):
    return hazards.assessed(accesses(spark, sf_dir, USES + LOCKS), SCOPE)


def captured_rows(spark, sf_dir):
    """Accesses with the capture flag; entities that are no field stand for globals."""
    return hazards.with_capture(accesses(spark, sf_dir), ["entity"], ~F.col("is_field"))


def marked_accesses(spark, sf_dir):
    return hazards.flagged(captured_rows(spark, sf_dir), SCOPE, GROUP, ["entity", "ctx"])


def depth_sql(scope: str, deferred: str) -> str:
    """Clamped depth by its closed form over the plain running sum."""
    return f"""
v_ev AS (
  SELECT *, CAST(CASE op WHEN 'acquire' THEN 1 ELSE -1 END AS BIGINT) AS delta FROM v_access
  WHERE op IN ('acquire', 'release') {deferred}),
v_sum AS (SELECT *, sum(delta) OVER (PARTITION BY {scope}, lock_key ORDER BY pos, seq) AS s FROM v_ev),
v_depth AS (
  SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY {scope}, lock_key ORDER BY pos, seq))
              AS BIGINT) AS depth
  FROM v_sum)
"""


# a lock is held at an access if the last depth of its key before it is above zero
HELD_SQL = depth_sql("ctx, day", "AND NOT deferred") + """,
v_until AS (
  SELECT ctx, day, lock_key, pos, depth,
         lead(pos) OVER (PARTITION BY ctx, day, lock_key ORDER BY pos, seq) AS until FROM v_depth),
v_held AS (
  SELECT a.seq, count(u.lock_key) AS held_keys FROM v_access a LEFT JOIN v_until u
  ON u.ctx = a.ctx AND u.day = a.day AND u.depth > 0 AND u.pos <= a.pos
     AND (u.until IS NULL OR a.pos < u.until)
  WHERE a.op IN ('read', 'write') GROUP BY a.seq),
v_assessed AS (
  SELECT a.*, h.held_keys, (a.is_atomic OR h.held_keys > 0) AS in_sync,
         CASE WHEN a.is_atomic OR h.held_keys > 0 THEN 'Low'
              WHEN a.concurrent OR a.op = 'write' THEN 'High' ELSE 'Medium' END AS severity
  FROM v_access a JOIN v_held h ON h.seq = a.seq)
"""
RISK_SQL = """CASE WHEN type_kind IN ('Slice', 'String') AND rhs_kind = 'slice_expression'
    THEN 'Retention risk: sub-slice/sub-string may keep large backing memory'
  WHEN type_kind = 'Map' AND rhs_kind IN ('identifier', 'selector_expression', 'index_expression')
    THEN 'Retention risk: map reference can keep large object graph alive' END"""
CAPTURE_SQL = """
v_capture AS (
  SELECT seq, coalesce(concurrent AND is_field AND ctx <> last_value(CASE WHEN op = 'decl' THEN ctx END IGNORE NULLS)
    OVER (PARTITION BY entity ORDER BY pos, seq ROWS UNBOUNDED PRECEDING), false) AS captured FROM v_access)
"""
FLAGS_SQL = HELD_SQL + f""",
{CAPTURE_SQL},
v_group AS (
  SELECT v_assessed.*, c.captured, {RISK_SQL} AS risk, count(*) OVER g AS n,
         count(*) FILTER (WHERE op = 'write') OVER g AS w,
         count(*) FILTER (WHERE is_atomic) OVER g AS a, count(*) FILTER (WHERE in_sync) OVER g AS s,
         min(CASE WHEN op = 'write' THEN pos END) OVER (PARTITION BY entity, ctx) AS fw
  FROM v_assessed JOIN v_capture c ON c.seq = v_assessed.seq WINDOW g AS (PARTITION BY entity, day)),
v_flags AS (
  SELECT *, concurrent AND NOT captured AS race,
    concurrent AND NOT captured AND severity = 'High' AS r1,
    is_field AND a > 0 AND a < n AS mixed_group,
    is_field AND a > 0 AND a < n AND NOT is_atomic AS r2,
    is_field AND s > 0 AND s < n AND NOT in_sync AS r3,
    is_field AND in_sync AND callee = 'copy' AS r4,
    is_field AND risk IS NOT NULL AS r5,
    is_field AND n >= 2 AND w = n AS r6,
    is_field AND NOT (n >= 2 AND w = n) AND op = 'read' AND coalesce(pos < fw, false) AS r7,
    NOT is_field AND NOT is_pointer AND op = 'read' AND copied AS r8
  FROM v_group)
"""


def _rule(i: int, taken: list[int]) -> str:
    free = " ".join(f"AND f.seq NOT IN (SELECT seq FROM e{j})" for j in taken)
    return f"""
e{i} AS (SELECT entity, day, {i} AS rule_id, arg_min(f.seq, f.pos) AS seq FROM v_flags f
  WHERE r{i} AND NOT r1 {free} GROUP BY entity, day)"""


# one rule after the other, each on the first use that is still free
EMIT_SQL = ",".join(_rule(i, list(range(2, i))) for i in range(2, 9)) + """,
v_emit AS (
  SELECT entity, day, 1 AS rule_id, seq FROM v_flags WHERE r1
  """ + " ".join(f"UNION ALL SELECT entity, day, rule_id, seq FROM e{i}" for i in range(2, 9)) + ")"

FINDINGS_SQL = EMIT_SQL + """,
v_findings AS (
  SELECT f.entity, f.day, f.seq, f.ctx, e.rule_id, f.op, f.risk, 'k' || f.entity AS name
  FROM v_emit e JOIN v_flags f ON f.seq = e.seq)
"""
TEXT_SQL = EMIT_SQL + """,
v_places AS (
  SELECT entity, day, min(CASE WHEN rule_id = 3 THEN seq END) AS s3,
    min(CASE WHEN rule_id = 4 THEN seq END) AS s4, min(CASE WHEN rule_id = 5 THEN seq END) AS s5,
    min(CASE WHEN rule_id = 8 THEN seq END) AS s8 FROM v_emit GROUP BY ALL),
v_at AS (
  SELECT f.*, p.s3, p.s4, (SELECT pos FROM v_access WHERE seq = p.s5) AS p5,
         (SELECT pos FROM v_access WHERE seq = p.s8) AS p8, 'k' || f.entity AS name
  FROM v_flags f LEFT JOIN v_places p ON p.entity = f.entity AND p.day = f.day),
v_text AS (
  SELECT seq, entity, concat_ws(' | ',
    CASE WHEN race AND severity = 'High' THEN 'Use of `' || name || '` in goroutine - HIGH PRIORITY data race ('
           || CASE WHEN op = 'write' THEN 'write' ELSE 'read' END || ' access)'
         WHEN race AND severity = 'Low' THEN 'Use of `' || name || '` in goroutine - LOW PRIORITY (sync detected, '
           || CASE WHEN op = 'write' THEN 'write' ELSE 'read' END || ' access)'
         WHEN op = 'write' THEN 'Reassignment of `' || name || '`'
         WHEN captured THEN 'Captured `' || name || '` in closure/goroutine' ELSE 'Use of `' || name || '`' END,
    CASE WHEN mixed_group THEN 'mixed atomic/non-atomic access detected for field `' || name || '`' END,
    CASE WHEN seq = s3 THEN 'lock coverage violation for field `' || name || '`' END,
    CASE WHEN seq = s4 THEN 'heavy call under lock while touching `' || name || '`' END,
    CASE WHEN is_field AND concurrent AND NOT in_sync
         THEN 'captured field access in goroutine without active lock' END,
    CASE WHEN r5 AND (p5 IS NULL OR pos <= p5) THEN risk END,
    CASE WHEN r6 THEN 'field appears write-only in current file scope' END,
    CASE WHEN r7 THEN 'read-before-write pattern detected in current file scope' END,
    CASE WHEN r8 AND (p8 IS NULL OR pos <= p8) THEN 'potential large struct copy by value' END
  ) AS hover_text FROM v_at)
"""


# --- lock state --------------------------------------------------------------
@query(f"""
WITH {v.ACCESS_SQL}
SELECT seq, ctx, lock_key, CAST(CASE op WHEN 'acquire' THEN 1 ELSE -1 END AS BIGINT) AS delta
FROM v_access WHERE op IN ('acquire', 'release')
""")
def lock_events(spark, sf_dir):
    return sync.lock_events(accesses(spark, sf_dir, LOCKS)).select("seq", "ctx", "lock_key", "delta")


@query(f"WITH {v.ACCESS_SQL}, {depth_sql('ctx', '')} SELECT seq, ctx, lock_key, depth FROM v_depth")
def lock_depth(spark, sf_dir):
    events = sync.lock_events(accesses(spark, sf_dir, LOCKS))
    return sync.lock_depth(events, ["ctx"], ORDER).select("seq", "ctx", "lock_key", "depth")


@query(f"WITH {v.ACCESS_SQL}, {HELD_SQL} SELECT seq, ctx, day, held_keys FROM v_assessed")
def held_at(spark, sf_dir):
    return assessed(spark, sf_dir).select("seq", "ctx", "day", "held_keys")


@query(f"""
WITH {v.ACCESS_SQL}, {depth_sql('ctx', 'AND NOT deferred')}
SELECT seq, ctx, lock_key, delta, depth FROM v_depth
""")
def drop_deferred(spark, sf_dir):
    events = sync.drop_deferred(sync.lock_events(accesses(spark, sf_dir, LOCKS)))
    return sync.lock_depth(events, ["ctx"], ORDER).select("seq", "ctx", "lock_key", "delta", "depth")


@query(f"""
WITH {v.ACCESS_SQL}
SELECT seq, ctx, ctx IN (SELECT ctx FROM v_access WHERE op = 'acquire') AS in_sync_fn
FROM v_access WHERE op = 'write'
""")
def sync_functions(spark, sf_dir):
    rows = accesses(spark, sf_dir).select("seq", "ctx", "op")
    names = sync.sync_functions(rows, "ctx", F.col("op") == "acquire")
    calls = rows.filter("op = 'write'").select("seq", "ctx")
    return sync.flag_calls(calls, names, "ctx")


@query("""
SELECT event_type, event_type IN ('click', 'error', 'signup') AS is_sync_call,
       CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 END AS delta, count(*) AS n
FROM events GROUP BY event_type
""")
def sync_call_flag(spark, sf_dir):
    kind = F.col("event_type")
    method = F.when(kind == "click", "Lock").when(kind == "error", "Unlock").when(
        kind == "signup", "AddInt64").otherwise("Print")
    package = F.when(kind == "signup", "atomic").otherwise("mu")
    rows = v.table(spark, sf_dir, "events").select(
        kind, method.alias("method"), package.alias("package")
    )
    flagged = sync.sync_call_flag(rows, "package", "method")
    return flagged.withColumn("delta", lock_delta(F.col("method"))).groupBy(
        "event_type", "is_sync_call", "delta"
    ).agg(F.count("*").alias("n"))


@query(f"""
WITH {v.ACCESS_SQL}
SELECT a.seq, a.ctx, a.day, EXISTS (SELECT 1 FROM v_access c WHERE c.ctx = a.ctx AND c.day = a.day
  AND c.op = 'acquire') AS block_sync
FROM v_access a WHERE a.op IN ('read', 'write')
""")
def block_has_sync(spark, sf_dir):
    rows = accesses(spark, sf_dir).select("seq", "ctx", "day", "op")
    uses = hazards.uses_of(rows).select("seq", "ctx", "day")
    return sync.block_has_sync(uses, rows, SCOPE, F.col("op") == "acquire")


UNTIL_SQL = "n AS (SELECT *, lead(pos) OVER (PARTITION BY ctx ORDER BY pos, seq) AS until FROM v_access)"


def calls_of(rows, which):
    """Intervals from an event to the same user's next one."""
    ended = running(rows, ["ctx"], ORDER, _until=following(F.col("pos")))
    return ended.filter(which).select(
        "ctx", F.col("pos").alias("start_pos"), F.coalesce("_until", "pos").alias("end_pos")
    )


@query(f"""
WITH {v.ACCESS_SQL}, {UNTIL_SQL}
SELECT a.seq, a.entity, EXISTS (SELECT 1 FROM n WHERE n.is_atomic AND n.ctx = a.ctx
  AND a.pos BETWEEN n.pos AND coalesce(n.until, n.pos)) AS in_atomic
FROM v_access a WHERE a.op IN ('read', 'write')
""")
def in_atomic(spark, sf_dir):
    # an atomic call runs from its event to the user's next one
    rows = accesses(spark, sf_dir).select("seq", "entity", "ctx", "pos", "op", "is_atomic")
    points = hazards.uses_of(rows).select("seq", "entity", "ctx", "pos")
    return sync.in_atomic(points, calls_of(rows, F.col("is_atomic")), ["ctx"]).select("seq", "entity", "in_atomic")


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL},
b AS (SELECT ctx, day, bool_or(op = 'acquire') AS block_sync FROM v_access GROUP BY ALL)
SELECT a.seq, a.entity, a.is_atomic OR CASE WHEN a.entity % 3 = 0 THEN b.block_sync ELSE a.held_keys > 0 END AS in_sync
FROM v_assessed a JOIN b ON b.ctx = a.ctx AND b.day = a.day
""")
def is_synchronized_block(spark, sf_dir):
    # for every third entity the caller is unknown: its block answers
    held = assessed(spark, sf_dir).drop("in_sync")
    known = held.withColumn("held_keys", F.when(F.col("entity") % 3 != 0, F.col("held_keys")))
    rows = accesses(spark, sf_dir).select("ctx", "day", "op")
    blocks = sync.block_has_sync(known, rows, SCOPE, F.col("op") == "acquire")
    return sync.is_synchronized(blocks, F.col("is_atomic"), fallback=F.col("block_sync")).select(
        "seq", "entity", "in_sync"
    )


@query(f"WITH {v.ACCESS_SQL}, {HELD_SQL} SELECT seq, entity, in_sync FROM v_assessed")
def is_synchronized(spark, sf_dir):
    return assessed(spark, sf_dir).select("seq", "entity", "in_sync")


# --- severity and rules --------------------------------------------------------
@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}
SELECT entity, severity, count(*) AS n FROM v_assessed GROUP BY ALL
""")
def severity_counts(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("entity", "severity").agg(F.count("*").alias("n"))


@query(f"""
WITH {v.ACCESS_SQL}, {UNTIL_SQL}
SELECT a.seq, a.ctx, EXISTS (SELECT 1 FROM n WHERE n.op = 'acquire' AND n.ctx = a.ctx
  AND a.pos BETWEEN n.pos AND coalesce(n.until, n.pos)) AS concurrent
FROM v_access a WHERE a.op IN ('read', 'write')
""")
def in_concurrent(spark, sf_dir):
    # a section runs from an acquire to the user's next event
    rows = accesses(spark, sf_dir).select("seq", "ctx", "pos", "op")
    points = hazards.uses_of(rows).select("seq", "ctx", "pos")
    return rules.in_concurrent(points, calls_of(rows, F.col("op") == "acquire"), ["ctx"]).select(
        "seq", "ctx", "concurrent"
    )


RACE_SQL = CAPTURE_SQL + """,
v_cand AS (
  SELECT s.* FROM v_assessed s JOIN v_capture c ON c.seq = s.seq WHERE s.concurrent AND NOT c.captured)
"""


def race_candidates(spark, sf_dir):
    return rules.race_findings(hazards.assessed(captured_rows(spark, sf_dir), SCOPE))


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}, {RACE_SQL}
SELECT seq, entity, severity, CASE WHEN op = 'write' THEN 'write access' ELSE 'read access' END AS access
FROM v_cand
""")
def race_findings(spark, sf_dir):
    return race_candidates(spark, sf_dir).select("seq", "entity", "severity", "access")


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}, {RACE_SQL}
SELECT entity, true AS potential_race, count(*) AS n_candidates, arg_max(severity, pos) AS race_severity
FROM v_cand GROUP BY entity
""")
def race_rollup(spark, sf_dir):
    return rules.race_rollup(race_candidates(spark, sf_dir), ["entity"], ORDER)


@query(f"""
WITH {v.ACCESS_SQL}
SELECT entity, day, count(*) FILTER (WHERE is_atomic) AS n_true,
       count(*) FILTER (WHERE NOT is_atomic) AS n_false
FROM v_access WHERE op IN ('read', 'write') GROUP BY ALL HAVING bool_or(is_atomic) AND NOT bool_and(is_atomic)
""")
def mixed_atomic(spark, sf_dir):
    return rules.mixed_atomic(accesses(spark, sf_dir, USES), GROUP)


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}
SELECT entity, day, count(*) FILTER (WHERE in_sync) AS n_true,
       count(*) FILTER (WHERE NOT in_sync) AS n_false
FROM v_assessed GROUP BY ALL HAVING bool_or(in_sync) AND NOT bool_and(in_sync)
""")
def lock_coverage(spark, sf_dir):
    return rules.lock_coverage(assessed(spark, sf_dir), GROUP)


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}
SELECT seq, entity, day, value FROM v_assessed WHERE in_sync AND callee = 'copy'
""")
def heavy_under_lock(spark, sf_dir):
    return rules.heavy_under_lock(assessed(spark, sf_dir)).select("seq", "entity", "day", "value")


@query("""
SELECT l_partkey, type_kind, rhs_kind, risk, count(*) AS n FROM (
  SELECT *, CASE WHEN type_kind <> 'Map' AND rhs_kind = 'slice_expression'
      THEN 'Retention risk: sub-slice/sub-string may keep large backing memory'
    WHEN type_kind = 'Map' AND rhs_kind = 'identifier'
      THEN 'Retention risk: map reference can keep large object graph alive' END AS risk
  FROM (SELECT l_partkey, CASE p_type WHEN 'SMALL' THEN 'String' WHEN 'MEDIUM' THEN 'Slice'
          WHEN 'LARGE' THEN 'Map' ELSE 'Other' END AS type_kind,
        CASE l_returnflag WHEN 'R' THEN 'slice_expression' WHEN 'A' THEN 'identifier'
          ELSE 'call_expression' END AS rhs_kind
        FROM lineitem JOIN part ON p_partkey = l_partkey))
WHERE risk IS NOT NULL AND type_kind <> 'Other' GROUP BY ALL
""")
def retention(spark, sf_dir):
    kind = F.col("p_type")
    parts = v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.when(kind == "SMALL", "String").when(kind == "MEDIUM", "Slice")
        .when(kind == "LARGE", "Map").otherwise("Other").alias("type_kind"),
    )
    flag = F.col("l_returnflag")
    lines = v.table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.when(flag == "R", "slice_expression").when(flag == "A", "identifier")
        .otherwise("call_expression").alias("rhs_kind"),
    )
    found = rules.retention(lines.join(parts, "l_partkey"))
    return found.groupBy("l_partkey", "type_kind", "rhs_kind", "risk").agg(F.count("*").alias("n"))


@query(f"""
WITH {v.ACCESS_SQL},
w AS (SELECT *, min(CASE WHEN op = 'write' THEN pos END) OVER (PARTITION BY entity, ctx) AS fw
      FROM v_access WHERE op IN ('read', 'write'))
SELECT seq, entity, ctx FROM w WHERE op = 'read' AND pos < fw
""")
def read_before_write(spark, sf_dir):
    uses = accesses(spark, sf_dir, USES).select("seq", "entity", "ctx", "pos", "op")
    return rules.read_before_write(uses, ["entity", "ctx"], ORDER).select("seq", "entity", "ctx")


@query(f"""
WITH {v.ACCESS_SQL}
SELECT entity, day, count(*) AS n_uses, count(*) AS n_writes FROM v_access
WHERE op IN ('read', 'write') GROUP BY ALL HAVING count(*) >= 2 AND bool_and(op = 'write')
""")
def write_only(spark, sf_dir):
    return rules.write_only(accesses(spark, sf_dir, USES), GROUP)


@query("""
SELECT 'line:' || l_orderkey || ':' || l_linenumber AS node_id,
       o_orderstatus = 'F' AND c_mktsegment <> 'AUTOMOBILE' AS hit
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
""")
def value_copy(spark, sf_dir):
    return structure.under(
        v.tree_view(spark, sf_dir),
        lambda a: (a["kind"] == "order") & (a["attr"] == "F"),
        lambda a: (a["kind"] == "customer") & (a["attr"] == "AUTOMOBILE"),
        v.TREE_DEPTH, stop=["nation"], extra=["attr"], start=F.col("kind") == "line",
        leaves=v.TREE_LEAVES,
    ).select("node_id", "hit")


@query(f"""
WITH {v.TAGS_SQL}, {v.SPANS_SQL}
SELECT t.page_id, t.pos, coalesce(arg_max(s.kind, s.start_pos) = 'nav', false) AS is_field
FROM v_tags t LEFT JOIN v_spans s ON s.page_id = t.page_id AND s.kind IN ('nav', 'article')
  AND t.pos BETWEEN s.start_pos AND s.end_pos
WHERE t.is_open AND t.tag = 'a' GROUP BY ALL
""")
def is_field_decl(spark, sf_dir):
    tokens = v.tag_tokens(v.table(spark, sf_dir, "pages"))
    links = tokens.filter("is_open AND tag = 'a'").select("page_id", "pos")
    return rules.is_field_decl(
        links, structure.pair_spans(tokens).filter("end_pos IS NOT NULL"), ["page_id"], ["nav"], ["article"], bounded=True
    )


@query(f"""
WITH {v.ACCESS_SQL}, {HELD_SQL}
SELECT seq, entity, ctx FROM v_assessed WHERE concurrent AND NOT in_sync
""")
def unlocked_concurrent(spark, sf_dir):
    return rules.unlocked_concurrent(assessed(spark, sf_dir)).select("seq", "entity", "ctx")


RULE_NAME_SQL = """CASE rule_id WHEN 1 THEN 'field-race-high' WHEN 2 THEN 'field-mixed-atomic'
  WHEN 3 THEN 'field-lock-coverage' WHEN 4 THEN 'field-heavy-under-lock' WHEN 5 THEN 'field-retention'
  WHEN 6 THEN 'field-write-only' WHEN 7 THEN 'field-read-before-write' ELSE 'struct-large-copy' END"""
LEVEL_SQL = "CASE WHEN rule_id IN (1, 2, 3, 7) THEN 'Warning' ELSE 'Information' END"


@query(f"""
WITH {v.ACCESS_SQL}, {FLAGS_SQL}, {FINDINGS_SQL}
SELECT entity, day, seq, ctx, {RULE_NAME_SQL} AS rule, {LEVEL_SQL} AS severity,
  CASE rule_id
    WHEN 1 THEN 'Potential data race on `' || name || '` in goroutine ('
      || CASE WHEN op = 'write' THEN 'write' ELSE 'read' END || ' access)'
    WHEN 2 THEN 'Field `' || name || '` is accessed both atomically and non-atomically'
    WHEN 3 THEN 'Field `' || name || '` has mixed synchronized/unsynchronized access'
    WHEN 4 THEN 'Heavy operation under lock for field `' || name || '` may hurt throughput'
    WHEN 5 THEN risk || ': `' || name || '`'
    WHEN 6 THEN 'Field `' || name || '` appears write-only'
    WHEN 7 THEN 'Field `' || name || '` is read before first write in this execution context'
    ELSE 'Potential large struct copy by value for `' || name || '`' END AS message
FROM v_findings
""")
def emit_findings(spark, sf_dir):
    name = F.concat(F.lit("k"), F.col("entity"))
    return hazards.findings(marked_accesses(spark, sf_dir), GROUP, name).drop("pos")


@query(f"""
WITH {v.ACCESS_SQL}, {FLAGS_SQL}, {FINDINGS_SQL}
SELECT {LEVEL_SQL} AS severity, CASE WHEN rule_id IN (1, 2, 3, 7) THEN 2 ELSE 3 END AS rank,
       count(*) AS n FROM v_findings GROUP BY ALL
""")
def severity_ranks(spark, sf_dir):
    found = hazards.findings(marked_accesses(spark, sf_dir), GROUP, F.lit("k"))
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(rules.severity_table(spark)), "severity")
