"""Counts and the entity graph."""

from pyspark.sql import functions as F

from usetrail.operators import cache, counts, graph
from usetrail.plans.scan import stacked
from usetrail.queries.registry import query
from usetrail.sources import views as v

HOUR = 3_600_000_000
TTL = 6 * HOUR


def accesses(spark, sf_dir):
    return v.access_view(v.table(spark, sf_dir, "events"))


@query(f"""
WITH {v.TAGS_SQL}
SELECT page_id, count(*) FILTER (WHERE tag IN ('a', 'li')) AS variables,
       count(*) FILTER (WHERE tag = 'div') AS functions, count(*) FILTER (WHERE tag = 'ul') AS channels,
       count(*) FILTER (WHERE tag = 'nav') AS goroutines
FROM v_tags WHERE is_open GROUP BY page_id
""")
def count_entities(spark, sf_dir):
    tag = F.col("tag")
    classes = {
        "variables": tag.isin("a", "li"), "functions": tag == "div", "channels": tag == "ul",
        "goroutines": tag == "nav",
    }
    opens = v.tag_tokens(v.table(spark, sf_dir, "pages")).filter("is_open")
    return counts.count_entities(opens, "page_id", classes)


@query(f"""
WITH {v.ACCESS_SQL}
SELECT day, count(*) FILTER (WHERE op = 'decl') AS variables,
       count(*) FILTER (WHERE op = 'write') AS functions,
       count(*) FILTER (WHERE op = 'acquire') AS channels,
       count(*) FILTER (WHERE op = 'release') AS goroutines
FROM v_access WHERE day = (SELECT max(day) FROM v_access) GROUP BY day
""")
def status(spark, sf_dir):
    op = F.col("op")
    classes = {
        "variables": op == "decl", "functions": op == "write", "channels": op == "acquire",
        "goroutines": op == "release",
    }
    return counts.status(counts.count_entities(accesses(spark, sf_dir), "day", classes), "day")


# a request inserts when it comes more than the TTL after the insert before it
GREEDY_SQL = f"""
v_req AS (SELECT entity, pos, seq, day, op FROM v_access),
v_ins AS (
  SELECT entity, min(pos) AS pos FROM v_req GROUP BY entity
  UNION ALL
  SELECT i.entity, (SELECT min(r.pos) FROM v_req r WHERE r.entity = i.entity AND r.pos > i.pos + {TTL})
  FROM v_ins i WHERE i.pos IS NOT NULL),
v_hits AS (
  SELECT r.*, NOT EXISTS (SELECT 1 FROM v_ins i WHERE i.entity = r.entity AND i.pos = r.pos) AS hit
  FROM v_req r)
"""


@query(f"""
WITH RECURSIVE {v.ACCESS_SQL}, {GREEDY_SQL}
SELECT seq, entity, hit AS cache_hit, CASE WHEN NOT hit THEN length(day) END AS parse_ms,
       CAST(length(op) AS BIGINT) AS code_len FROM v_hits
""")
def parse_info(spark, sf_dir):
    requests = accesses(spark, sf_dir).select("entity", "pos", "seq", "day", "op")
    rated = cache.asof_hit(requests, ["entity"], ["pos", "seq"], TTL).withColumnRenamed(
        "hit", "cache_hit"
    )
    info = counts.parse_info(rated, F.col("op"), F.length("day").cast("long"))
    return info.select("seq", "entity", "cache_hit", "parse_ms", "code_len")


# --- graph -------------------------------------------------------------------
TREE_KINDS = {
    "nation": ("Channel", "chan", "channel"), "customer": ("Function", "fn", None),
    "order": ("Variable", "var", None), "line": ("Goroutine", "go", "goroutine"),
}


def tree_nodes(spark, sf_dir):
    rows = v.tree_view(spark, sf_dir).select(
        "kind", F.col("attr").alias("name"), F.col("ordinal").alias("line"),
        F.lit(0).alias("col"), F.col("ordinal").alias("end_line"),
        F.length("attr").alias("end_col"),
    )
    return graph.graph_nodes(rows, TREE_KINDS)


@query(f"""
WITH {v.TREE_SQL},
n AS (SELECT CASE kind WHEN 'nation' THEN 'Channel' WHEN 'customer' THEN 'Function'
               WHEN 'order' THEN 'Variable' ELSE 'Goroutine' END AS entity_type,
             CASE kind WHEN 'nation' THEN 'channel' WHEN 'line' THEN 'goroutine' ELSE attr END AS label,
             CASE kind WHEN 'nation' THEN 'chan' WHEN 'customer' THEN 'fn' WHEN 'order' THEN 'var'
               ELSE 'go' END AS p, ordinal, length(attr) AS e
      FROM v_tree WHERE kind <> 'region'),
i AS (SELECT *, p || ':' || label || ':' || ordinal || ':0:' || e AS id FROM n)
SELECT entity_type, label, count(*) AS n, count(DISTINCT id) AS n_ids, min(id) AS first_id,
       max(ordinal) AS last_line FROM i GROUP BY ALL
""")
def graph_nodes(spark, sf_dir):
    return tree_nodes(spark, sf_dir).groupBy("entity_type", "label").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.min("id").alias("first_id"),
        F.max("range.start.line").cast("long").alias("last_line"),
    )


def access_links(spark, sf_dir):
    rows = accesses(spark, sf_dir).filter(F.col("op").isin("decl", "read", "write")).select(
        "entity", "pos", "seq", "op", F.concat(F.lit("k"), F.col("entity")).alias("name"),
        F.col("entity").alias("line"), F.col("seq").alias("col"), F.col("entity").alias("end_line"),
        (F.col("seq") + 1).alias("end_col"),
    )
    return graph.use_links(
        rows, ["entity"], ["pos", "seq"], F.col("op") == "decl", F.col("name")
    )


@query(f"""
WITH {v.ACCESS_SQL},
l AS (SELECT *, last_value(CASE WHEN op = 'decl' THEN seq END IGNORE NULLS) OVER (
        PARTITION BY entity ORDER BY pos, seq ROWS UNBOUNDED PRECEDING) AS d
      FROM v_access WHERE op IN ('decl', 'read', 'write'))
SELECT 'var:k' || entity || ':' || entity || ':' || d || ':' || (d + 1) AS from_id,
       'use:k' || entity || ':' || entity || ':' || seq || ':' || (seq + 1) AS to_id,
       'Use' AS edge_type
FROM l WHERE op <> 'decl' AND d IS NOT NULL
""")
def use_edges(spark, sf_dir):
    return graph.use_edges(access_links(spark, sf_dir))


@query("""
SELECT 'fn:' || c_name || ':' || c_custkey || ':0:' || length(c_name) AS to_id, 'Call' AS edge_type,
       count(*) AS n, min('callsite:' || c_name || ':' || o_orderkey || ':0:1') AS first_from
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL
""")
def call_edges(spark, sf_dir):
    return order_calls(spark, sf_dir).groupBy("to_id", "edge_type").agg(
        F.count("*").alias("n"), F.min("from_id").alias("first_from")
    )


def order_calls(spark, sf_dir):
    orders = v.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("line"),
        F.lit(0).alias("col"), F.lit(1).alias("end_col"),
    )
    owners = v.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.lit(0).alias("to_col"), F.length("c_name").alias("to_end"),
    )
    sites = orders.join(owners, "c_custkey")
    return graph.call_edges(sites, F.col("c_name"), ("c_custkey", "to_col", "to_end"))


def lock_sites(spark, sf_dir):
    return accesses(spark, sf_dir).filter(F.col("op").isin("acquire", "release")).select(
        F.col("entity").alias("line"), F.col("seq").alias("col"), (F.col("seq") + 1).alias("end_col")
    )


@query(f"""
WITH {v.ACCESS_SQL}
SELECT 'callsite:sync:' || entity || ':' || seq || ':' || (seq + 1) AS from_id,
       'sync:sync:' || entity || ':' || seq || ':' || (seq + 1) AS to_id, 'Sync' AS edge_type
FROM v_access WHERE op IN ('acquire', 'release')
""")
def sync_edges(spark, sf_dir):
    return graph.sync_edges(lock_sites(spark, sf_dir))


def turn_edges(spark, sf_dir):
    turns = v.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("line"), F.col("turn").alias("col"),
        (F.col("turn") + 1).alias("end_col"), "role",
    )
    name = F.concat(F.lit("c"), F.col("line"))
    sends = graph.send_edges(turns.filter("role = 'user'"), name)
    receives = graph.receive_edges(turns.filter("role = 'assistant'"), name)
    return sends, receives


@query("""
SELECT CASE role WHEN 'user' THEN 'send' ELSE 'recv' END || ':c' || a AS from_id, 'chan:c' || a AS to_id,
       CASE role WHEN 'user' THEN 'Send' ELSE 'Receive' END AS edge_type
FROM (SELECT role, conv_id || ':' || conv_id || ':' || turn || ':' || (turn + 1) AS a FROM conversations)
WHERE role IN ('user', 'assistant')
""")
def channel_edges(spark, sf_dir):
    return stacked(*turn_edges(spark, sf_dir))


def spawn_sites(spark, sf_dir):
    first = accesses(spark, sf_dir).filter("concurrent").groupBy("ctx").agg(
        F.min(F.struct("pos", "seq")).alias("_f")
    )
    return first.select(
        F.col("ctx").alias("line"), F.col("_f.seq").alias("col"), (F.col("_f.seq") + 1).alias("end_col")
    )


@query(f"""
WITH {v.ACCESS_SQL},
f AS (SELECT ctx, arg_min(seq, pos) AS seq FROM v_access WHERE concurrent GROUP BY ctx)
SELECT 'spawnsite:go:' || ctx || ':' || seq || ':' || (seq + 1) AS from_id,
       'go:goroutine:' || ctx || ':' || seq || ':' || (seq + 1) AS to_id, 'Spawn' AS edge_type FROM f
""")
def spawn_edges(spark, sf_dir):
    return graph.spawn_edges(spawn_sites(spark, sf_dir))


@query(f"""
WITH {v.ACCESS_SQL},
l AS (SELECT op, last_value(CASE WHEN op = 'decl' THEN seq END IGNORE NULLS) OVER (
        PARTITION BY entity ORDER BY pos, seq ROWS UNBOUNDED PRECEDING) AS d
      FROM v_access WHERE op IN ('decl', 'read', 'write'))
SELECT 'node' AS part, t AS type, n FROM (
  SELECT 'Variable' AS t, (SELECT count(*) FROM orders) + (SELECT count(*) FROM l WHERE op <> 'decl'
    AND d IS NOT NULL) AS n
  UNION ALL SELECT 'Function', count(*) FROM customer UNION ALL SELECT 'Channel', count(*) FROM nation
  UNION ALL SELECT 'Goroutine', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
UNION ALL SELECT 'edge', t, n FROM (
  SELECT 'Use' AS t, count(*) AS n FROM l WHERE op <> 'decl' AND d IS NOT NULL
  UNION ALL SELECT 'Call', count(*) FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'Sync', count(*) FROM v_access WHERE op IN ('acquire', 'release')
  UNION ALL SELECT 'Spawn', count(DISTINCT ctx) FROM v_access WHERE concurrent
  UNION ALL SELECT 'Send', count(*) FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'Receive', count(*) FROM conversations WHERE role = 'assistant')
""")
def build_graph(spark, sf_dir):
    links = access_links(spark, sf_dir)
    nodes, edges = graph.build_graph(
        [tree_nodes(spark, sf_dir), graph.use_nodes(links, F.col("name"))],
        [graph.use_edges(links), order_calls(spark, sf_dir), graph.sync_edges(lock_sites(spark, sf_dir)),
         graph.spawn_edges(spawn_sites(spark, sf_dir)), *turn_edges(spark, sf_dir)],
    )
    return stacked(
        nodes.groupBy(F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
        .withColumn("part", F.lit("node")),
        edges.groupBy(F.col("edge_type").alias("type")).agg(F.count("*").alias("n"))
        .withColumn("part", F.lit("edge")),
    )


@query("""
SELECT 'doc:' || doc_id AS from_id, 'label:' || doc_id AS to_id, 'Use' AS edge_type, 'to' AS "end"
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def dangling_edges(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select("doc_id")
    labels = v.table(spark, sf_dir, "labels").select("doc_id")
    nodes = stacked(
        docs.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("id")),
        labels.select(F.concat(F.lit("label:"), F.col("doc_id")).alias("id")),
    )
    edges = docs.select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("from_id"),
        F.concat(F.lit("label:"), F.col("doc_id")).alias("to_id"), F.lit("Use").alias("edge_type"),
    )
    return graph.dangling_edges(nodes, edges)


@query("""
SELECT 'node' AS part, event_type AS type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL
UNION ALL SELECT 'edge', role, count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY ALL
""")
def bad_types(spark, sf_dir):
    # views stand for variables, user and assistant turns for sends and receives
    kind, role = F.col("event_type"), F.col("role")
    nodes = v.table(spark, sf_dir, "events").select(F.when(kind == "view", "Variable").otherwise(kind).alias("entity_type"))
    edges = v.table(spark, sf_dir, "conversations").select(
        F.when(role == "user", "Send").when(role == "assistant", "Receive").otherwise(role).alias("edge_type")
    )
    return graph.bad_types(nodes, edges).groupBy("part", "type").agg(F.count("*").alias("n"))
