"""Sources, sinks and stored text."""

from pyspark.sql import functions as F

from usetrail.functions.columns import clipped, micros
from usetrail.operators import classify
from usetrail.plans.scan import numbered
from usetrail.queries.registry import query
from usetrail.session import scratch_dir
from usetrail.sources import corpus, sinks
from usetrail.sources.views import ACCESS_SQL, access_view, table


@query("""
SELECT lang, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
FROM documents GROUP BY lang
""")
def scan_corpus(spark, sf_dir):
    docs = corpus.scan_corpus(spark, f"{sf_dir}/documents.parquet", "parquet")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes")
    )


@query("""
SELECT c_custkey, coalesce(nullif(u.c_name, ''), c.c_name) AS c_name, c_nationkey
FROM customer c LEFT JOIN (
  SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END AS c_name FROM supplier) u
ON u.s_suppkey = c.c_custkey
""")
def overlay(spark, sf_dir):
    unsaved = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"),
        F.when(F.col("s_acctbal") < 0, "").otherwise(F.col("s_name")).alias("c_name"),
    )
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return corpus.overlay(base, unsaved, "c_custkey", "c_name")


@query("""
SELECT user_id, pos, event_id, event_type FROM (
  SELECT user_id, epoch_us(ts) AS pos, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1
""")
def latest_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", micros("ts").alias("pos"), "event_id", "event_type"
    )
    return corpus.latest_by_key(events, ["user_id"], ["pos", "event_id"])


@query("""
SELECT CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k,
       count(*) AS n
FROM events GROUP BY 1
""")
def decode(spark, sf_dir):
    # error events carry a broken payload
    payload = F.when(F.col("event_type") == "error", F.concat(F.lit("oops"), F.col("props")))
    events = table(spark, sf_dir, "events").select(payload.otherwise(F.col("props")).alias("body"))
    rows = corpus.decode(events, "body", "k INT")
    return rows.groupBy(F.col("decoded.k").alias("k")).agg(F.count("*").alias("n"))


@query(f"""
WITH {ACCESS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY pos, seq) AS i FROM v_access
      WHERE op IN ('decl', 'read', 'write')),
p AS (SELECT *, CASE WHEN op = 'decl' THEN 'Declaration' WHEN op = 'write' THEN 'AliasReassigned'
      WHEN is_pointer THEN 'Pointer' ELSE 'Use' END AS kind FROM n)
SELECT seq, CAST(to_json(struct_pack(
  name := CASE WHEN op = 'decl' THEN 'k' || entity || '_decl'
               ELSE 'k' || entity || '_use_' || i END,
  file := day, pos := struct_pack(line := entity, col := seq),
  expected := struct_pack(var := 'k' || entity,
    kind := CASE WHEN op = 'decl' THEN 'decl' ELSE 'use' END, pointer := is_pointer,
    reassign := op = 'write', captured := false, decoration := kind,
    color_key := CASE kind WHEN 'Declaration' THEN 'declarationColor'
      WHEN 'AliasReassigned' THEN 'aliasReassignedColor' WHEN 'Pointer' THEN 'pointerColor'
      ELSE 'useColor' END))) AS VARCHAR) AS json
FROM p
""")
def to_lifecycle_json(spark, sf_dir):
    rows = access_view(table(spark, sf_dir, "events")).filter(
        F.col("op").isin("decl", "read", "write")
    )
    no = F.lit(False)
    kinds = numbered(rows, ["entity"], ["pos", "seq"], "i").select(
        "*", F.concat(F.lit("k"), F.col("entity")).alias("var"),
        F.col("is_pointer").alias("pointer"), (F.col("op") == "write").alias("reassign"),
        no.alias("captured"),
        classify.lifecycle_kind(
            F.col("op"), F.col("is_pointer"), F.col("op") == "write", no, F.lit(None)
        ).alias("kind"),
    )
    name = F.when(F.col("op") == "decl", F.concat("var", F.lit("_decl"))).otherwise(
        F.concat("var", F.lit("_use_"), F.col("i"))
    )
    points = sinks.lifecycle_records(kinds, name, F.col("day"), F.col("entity"), F.col("seq"))
    return sinks.to_lifecycle_json(points).select("seq", "json")


@query(f"""
WITH {ACCESS_SQL}
SELECT op, CASE op WHEN 'decl' THEN 'green' WHEN 'read' THEN 'yellow' WHEN 'write' THEN 'purple'
           ELSE '' END AS color_value, count(*) AS n
FROM v_access GROUP BY ALL
""")
def with_colors(spark, sf_dir):
    rows = access_view(table(spark, sf_dir, "events")).select(
        "op",
        F.when(F.col("op") == "decl", "declarationColor").when(F.col("op") == "read", "useColor")
        .when(F.col("op") == "write", "aliasReassignedColor").alias("color_key"),
    )
    return sinks.with_colors(rows, "color_key").groupBy("op", "color_value").agg(
        F.count("*").alias("n")
    )


@query("""
SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) ||
  '...[truncated ' || (length(text) - 200) || ' chars]' ELSE text END AS clipped
FROM documents
""")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", clipped(F.col("text"), 200).alias("clipped")
    )


@query(f"""
WITH {ACCESS_SQL},
again AS (SELECT DISTINCT entity FROM v_access
          WHERE day = (SELECT max(day) FROM v_access) AND op = 'decl')
SELECT entity AS doc_id, 'field-heavy-under-lock' AS rule, 'Information' AS severity, pos, seq
FROM v_access WHERE op = 'write' AND callee = 'copy'
AND (entity NOT IN (SELECT entity FROM again) OR day = (SELECT max(day) FROM v_access))
""")
def write_findings(spark, sf_dir):
    rows = access_view(table(spark, sf_dir, "events"))
    last_day = rows.agg(F.max("day").alias("d")).scalar()
    found = rows.filter("op = 'write' AND callee = 'copy'").select(
        F.col("entity").alias("doc_id"), F.lit("field-heavy-under-lock").alias("rule"),
        F.lit("Information").alias("severity"), "pos", "seq", "day",
    )
    path = scratch_dir(spark, "findings")
    sinks.write_findings(
        found.drop("day"), rows.select(F.col("entity").alias("doc_id")), path, 1
    )
    # entities declared anew on the last day are analysed again, for that day alone
    again = rows.filter((F.col("day") == last_day) & (F.col("op") == "decl")).select(
        F.col("entity").alias("doc_id")
    ).distinct()
    fresh = found.filter(F.col("day") == last_day).join(again, "doc_id", "left_semi").drop("day")
    sinks.write_findings(fresh, again, path, 2)
    return sinks.read_findings(spark, path)
