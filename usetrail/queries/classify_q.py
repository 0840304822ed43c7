"""Kinds, labels and texts of uses."""

from pyspark.sql import functions as F

from usetrail.operators import classify as cl
from usetrail.plans import hazards
from usetrail.plans.scan import running, total
from usetrail.queries.registry import query
from usetrail.queries.rules_q import FLAGS_SQL, GROUP, TEXT_SQL, captured_rows, marked_accesses
from usetrail.sources import views as v

OWN = ["entity"]
ORDER = ["pos", "seq"]


def accesses(spark, sf_dir):
    return v.access_view(v.table(spark, sf_dir, "events"))


@query(f"""
WITH {v.ACCESS_SQL},
r AS (SELECT *, count(*) FILTER (WHERE op IN ('decl', 'write')) OVER (PARTITION BY entity
        ORDER BY pos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_access)
SELECT seq, entity, op, op = 'write' OR (op = 'decl' AND before > 0) AS reassign
FROM r WHERE op IN ('decl', 'read', 'write')
""")
def reassigned(spark, sf_dir):
    rows = accesses(spark, sf_dir).select("entity", "pos", "seq", "op")
    defines = F.when(F.col("op").isin("decl", "write"), 1).otherwise(0)
    seen = running(rows, OWN, ORDER, _before=total(defines, exclusive=True))
    is_decl = F.col("op") == "decl"
    flag = cl.reassign_flag(
        F.when(is_decl, "short_var_declaration").when(F.col("op") == "write", "assignment_statement"),
        F.when(F.col("op") != "read", "left"),
        F.when(is_decl, ":=").otherwise("="), is_decl & (F.col("_before") == 0), F.lit(True),
    )
    uses = seen.filter(F.col("op").isin("decl", "read", "write"))
    return uses.select("seq", "entity", "op", flag.alias("reassign"))


CAPTURED_SQL = """
v_asof AS (
  SELECT *, last_value(CASE WHEN op = 'decl' THEN ctx END IGNORE NULLS) OVER (
    PARTITION BY entity ORDER BY pos, seq ROWS UNBOUNDED PRECEDING) AS decl_ctx FROM v_access),
v_captured AS (
  SELECT *, coalesce(concurrent AND decl_ctx <> ctx AND is_field, false) AS captured
  FROM v_asof WHERE op IN ('read', 'write'))
"""


def captured_accesses(spark, sf_dir):
    return hazards.uses_of(captured_rows(spark, sf_dir))


@query(f"WITH {v.ACCESS_SQL}, {CAPTURED_SQL} SELECT seq, entity, ctx, captured FROM v_captured")
def captured(spark, sf_dir):
    return captured_accesses(spark, sf_dir).select("seq", "entity", "ctx", "captured")


@query(f"""
WITH {v.ACCESS_SQL}, {FLAGS_SQL},
k AS (SELECT entity, CASE WHEN race AND severity <> 'Low' THEN 'Race' WHEN race THEN 'RaceLow'
        WHEN op = 'write' THEN 'AliasReassigned' WHEN captured THEN 'AliasCaptured' WHEN is_pointer THEN 'Pointer' ELSE 'Use' END AS kind
      FROM v_flags UNION ALL SELECT entity, 'Declaration' FROM v_access WHERE op = 'decl')
SELECT entity, kind, count(*) AS n FROM k GROUP BY ALL
""")
def lifecycle_kinds(spark, sf_dir):
    return decorations(spark, sf_dir).groupBy("entity", "kind").agg(F.count("*").alias("n"))


def decorations(spark, sf_dir):
    decls = accesses(spark, sf_dir).filter("op = 'decl'")
    return hazards.decorated(marked_accesses(spark, sf_dir), decls)


@query(f"""
WITH {v.ACCESS_SQL}
SELECT op, CASE op WHEN 'decl' THEN 'Declaration' WHEN 'write' THEN 'AliasReassigned'
           WHEN 'read' THEN 'Use' END AS label,
       CASE op WHEN 'decl' THEN 'declarationColor' WHEN 'write' THEN 'aliasReassignedColor'
           WHEN 'read' THEN 'useColor' END AS color_key, count(*) AS n
FROM v_access GROUP BY op
""")
def kind_names(spark, sf_dir):
    kind = F.when(F.col("op") == "decl", "Declaration").when(
        F.col("op") == "write", "AliasReassigned"
    ).when(F.col("op") == "read", "Use")
    rows = accesses(spark, sf_dir).select("op", kind.alias("kind")).groupBy("op", "kind").agg(
        F.count("*").alias("n")
    )
    return cl.with_kind_names(rows).select("op", "label", "color_key", "n")


@query(f"""
WITH {v.ACCESS_SQL}, {FLAGS_SQL},
k AS (SELECT entity, day, CASE WHEN race AND severity <> 'Low' THEN 1 WHEN race THEN 2
        WHEN op = 'write' THEN 3 WHEN captured THEN 4 WHEN is_pointer THEN 5 ELSE 6 END AS p
      FROM v_flags UNION ALL SELECT entity, day, 7 FROM v_access WHERE op = 'decl')
SELECT entity, day, ['Race', 'RaceLow', 'AliasReassigned', 'AliasCaptured', 'Pointer', 'Use',
  'Declaration'][min(p)] AS kind FROM k GROUP BY entity, day
""")
def top_kind(spark, sf_dir):
    return cl.top_kind(decorations(spark, sf_dir), ["entity", "day"])


@query(f"""
WITH {v.ACCESS_SQL}, {FLAGS_SQL},
d AS (SELECT entity, min(pos) AS first_pos, bool_or(is_atomic) AS ptr,
             count(*) FILTER (WHERE op IN ('read', 'write')) AS n FROM v_access GROUP BY entity),
r AS (SELECT entity, bool_or(race) AS race FROM v_flags GROUP BY entity)
SELECT d.entity, '**Variable**: `k' || d.entity || '`' || chr(10) || chr(10) || '**Declared at**: line '
  || (first_pos // 3600000000 + 1) || chr(10) || '**Type**: '
  || CASE WHEN ptr THEN 'Pointer' ELSE 'Value' END || chr(10) || '**Uses**: ' || n || chr(10)
  || CASE WHEN race THEN '**Warning**: Potential data race detected!' || chr(10) ELSE '' END AS summary
FROM d LEFT JOIN r ON r.entity = d.entity
""")
def hover_summary(spark, sf_dir):
    # the hour in which an entity first shows stands for its line
    rows = accesses(spark, sf_dir)
    variables = rows.groupBy("entity").agg(
        F.min("pos").alias("_first"), F.bool_or("is_atomic").alias("is_pointer"),
        F.count_if(F.col("op").isin("read", "write")).alias("n_uses"),
    )
    races = marked_accesses(spark, sf_dir).groupBy("entity").agg(
        F.bool_or("race").alias("potential_race")
    )
    named = variables.join(races, "entity", "left").select(
        "entity", F.concat(F.lit("k"), F.col("entity")).alias("name"),
        F.expr("_first div 3600000000").alias("line"), "is_pointer", "n_uses", "potential_race",
    )
    return cl.hover_summary(named).select("entity", "summary")


@query(f"WITH {v.ACCESS_SQL}, {FLAGS_SQL}, {TEXT_SQL} SELECT seq, entity, hover_text FROM v_text")
def hover_text(spark, sf_dir):
    name = F.concat(F.lit("k"), F.col("entity"))
    return hazards.use_texts(marked_accesses(spark, sf_dir), GROUP, name).select(
        "seq", "entity", "hover_text"
    )


@query(f"""
WITH {v.ACCESS_SQL}, {FLAGS_SQL}
SELECT entity, CASE WHEN severity = 'High' THEN 'diagnostic' ELSE 'note' END AS channel,
       count(*) AS n FROM v_flags WHERE race GROUP BY ALL
""")
def split_confidence(spark, sf_dir):
    found = marked_accesses(spark, sf_dir).filter("race")
    split = cl.split_confidence(found, F.col("severity") == "High")
    return split.groupBy("entity", "channel").agg(F.count("*").alias("n"))


@query(f"""
WITH {v.ACCESS_SQL},
n AS (SELECT entity, op, seq, row_number() OVER (PARTITION BY entity, op ORDER BY pos, seq) AS rn
      FROM v_access)
SELECT entity, op, (rn - 1) // 1000 AS page,
       array_to_string(list(seq ORDER BY rn), ',') AS items FROM n GROUP BY ALL
""")
def by_kind(spark, sf_dir):
    lists = cl.by_kind(accesses(spark, sf_dir), OWN, "op", ORDER, F.col("seq"))
    return lists.withColumn("items", F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))))
