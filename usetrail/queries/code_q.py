"""Pages read as programs: nodes, classes, counts, accesses, findings and the graph of them."""

from pyspark.sql import functions as F

from usetrail.functions.columns import LINE_SHIFT
from usetrail.operators import graph
from usetrail.operators import structure as st
from usetrail.operators.counts import code_classes, count_entities
from usetrail.plans import code_facts, resolve
from usetrail.plans.scan import stacked
from usetrail.queries.registry import query
from usetrail.session import in_place, parts_of, staged
from usetrail.sources import views as v
from usetrail.sources.nodes import NODES_SQL, page_nodes, with_kinds

L = LINE_SHIFT


def nodes_of(spark, sf_dir):
    return page_nodes(v.table(spark, sf_dir, "pages").select("page_id", "html"))


def over_nodes(spark, sf_dir, make):
    """What `make` gives for the written nodes: nodes and all that is made of them stay where their page is."""
    with in_place(spark, parts_of(v.table(spark, sf_dir, "pages"), "html")):
        nodes = staged(nodes_of(spark, sf_dir), "nodes", "doc_id")
        return staged(make(nodes).withColumnRenamed("doc_id", "page_id"), "made", "page_id")


@query(f"""
WITH {NODES_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY start_pos, depth) - 1 AS node_id FROM v_code)
SELECT n.page_id, n.node_id, p.node_id AS parent_id, n.kind, n.field, n.start_pos, n.end_pos, n.depth, n.name AS text,
       CAST(row_number() OVER (PARTITION BY n.page_id, n.up ORDER BY n.start_pos) - 1 AS INT) AS ordinal
FROM n LEFT JOIN n p ON p.page_id = n.page_id AND p.start_pos = n.up AND p.depth = n.depth - 1
""")
def code_nodes(spark, sf_dir):
    return nodes_of(spark, sf_dir).withColumnRenamed("doc_id", "page_id")


def _class_sql(kind, parent, field):
    return f"""CASE WHEN {kind} = 'identifier' THEN CASE WHEN {parent} = 'var_spec' THEN 'VariableDeclaration'
    WHEN {parent} = 'function_declaration' THEN 'FunctionName' WHEN {parent} = 'call_expression' THEN 'FunctionCall'
    ELSE 'VariableUse' END WHEN {kind} = 'function_declaration' THEN 'FunctionDeclaration'
    WHEN {kind} = 'go_statement' THEN 'GoroutineStatement' WHEN {kind} = 'channel_type' THEN 'ChannelType' ELSE 'Unknown' END"""


@query(f"""
WITH {NODES_SQL}
SELECT page_id, kind, field, parent_field, {_class_sql('kind', 'parent_kind', 'field')} AS context_type,
       CASE WHEN parent_kind IS NOT NULL THEN {_class_sql('parent_kind', 'grand_kind', 'parent_field')} END AS parent_context,
       count(*) AS n FROM v_code GROUP BY ALL
""")
def classify_nodes(spark, sf_dir):
    """Class of every node and of its parent, from kinds and fields."""
    classed = st.classify_context(with_kinds(nodes_of(spark, sf_dir)))
    return classed.groupBy(
        F.col("doc_id").alias("page_id"), "kind", "field", "parent_field", "context_type", "parent_context"
    ).agg(F.count("*").alias("n"))


@query(f"""
WITH {NODES_SQL}
SELECT page_id, count(*) FILTER (kind = 'identifier' AND (parent_kind = 'var_spec' AND field = 'name'
         OR grand_kind IN ('var_spec', 'short_var_declaration') AND parent_kind = 'expression_list' AND parent_field = 'left')) AS variables,
       count(*) FILTER (kind = 'function_declaration') AS functions, count(*) FILTER (kind = 'channel_type') AS channels,
       count(*) FILTER (kind = 'go_statement') AS goroutines
FROM v_code GROUP BY page_id
""")
def count_code_entities(spark, sf_dir):
    nodes = with_kinds(nodes_of(spark, sf_dir)).withColumnRenamed("parent_field", "list_field")
    return count_entities(nodes.withColumnRenamed("doc_id", "page_id"), "page_id", code_classes())


ACCESSES_SQL = f"""
v_names AS (
  SELECT c.page_id, c.name, c.start_pos AS pos, c.depth,
         CASE WHEN c.parent_kind = 'var_spec' AND c.field = 'name' AND c.grand_kind = 'source_file' THEN 'top'
              WHEN c.parent_kind = 'var_spec' AND c.field = 'name' THEN 'spec'
              WHEN c.grand_kind = 'short_var_declaration' AND c.parent_field = 'left' THEN 'short' END AS declared,
         c.grand_kind = 'assignment_statement' AND c.parent_field = 'left' AS assigned,
         c.parent_kind = 'argument_list' OR c.parent_kind = 'expression_list'
           AND c.grand_kind IN ('assignment_statement', 'short_var_declaration') AS copied,
         coalesce(s.k = 3, false) AS concurrent, coalesce(s.k = 5 AND (s.m // 7) % 2 = 1, false) AS is_pointer,
         s.base + 15 + 4 * s.m AS stmt_end
  FROM v_code c LEFT JOIN v_said s ON s.page_id = c.page_id AND s.base = c.start_pos // {L} * {L} WHERE c.kind = 'identifier'),
v_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, name, declared = 'top' ORDER BY pos) AS rn
  FROM v_names WHERE declared IS NOT NULL),
v_decls AS (
  SELECT page_id, name, pos AS entity, declared = 'top' AS is_global, is_pointer,
         CASE WHEN declared = 'short' THEN stmt_end ELSE pos + 1 END AS seen
  FROM v_ranked WHERE declared <> 'short' OR rn = 1),
v_uses AS (
  SELECT page_id, name, pos, CASE WHEN assigned THEN 'write' ELSE 'read' END AS op, concurrent, copied
  FROM v_names WHERE declared IS NULL
  UNION ALL SELECT page_id, name, pos, 'write', concurrent, copied FROM v_ranked WHERE declared = 'short' AND rn > 1),
v_found AS (
  SELECT u.page_id, u.name, u.pos, u.op, u.concurrent, u.copied, arg_max(d, (NOT d.is_global, d.seen)) AS d
  FROM v_uses u JOIN v_decls d ON d.page_id = u.page_id AND d.name = u.name AND d.seen <= u.pos GROUP BY ALL),
v_accesses AS (
  SELECT page_id, d.entity AS entity, name, pos, op, d.is_global AS is_global, d.is_pointer AS is_pointer, concurrent, copied
  FROM v_found)
"""


@query(f"WITH {NODES_SQL}, {ACCESSES_SQL} SELECT * FROM v_accesses")
def code_accesses(spark, sf_dir):
    """Every use of a variable with its declaration and what surrounds it."""
    return over_nodes(spark, sf_dir, lambda nodes: code_facts.code_accesses(nodes).select(
        "doc_id", "entity", "name", "pos", "op", "is_global", "is_pointer", "concurrent", "copied"
    ))


@query(f"""
WITH {NODES_SQL}, {ACCESSES_SQL}
SELECT page_id, op, CASE WHEN concurrent OR op = 'write' THEN 'High' ELSE 'Medium' END AS severity,
       concurrent AND is_global AS race, NOT is_pointer AND op = 'read' AND copied AS value_copy,
       count(*) AS n, min(pos) AS first_pos
FROM v_accesses GROUP BY ALL
""")
def code_findings(spark, sf_dir):
    """Severity and rule hits of every use in the programs."""
    return over_nodes(spark, sf_dir, lambda nodes: code_facts.code_findings(nodes).groupBy(
        "doc_id", "op", "severity", "race", F.col("r8").alias("value_copy")
    ).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")))


@query(f"""
WITH {NODES_SQL}, {ACCESSES_SQL},
c AS (SELECT page_id, entity, count(DISTINCT pos) AS n FROM v_accesses GROUP BY ALL),
a AS (SELECT page_id, pos, name, entity FROM v_accesses UNION ALL SELECT page_id, entity, name, entity FROM v_decls)
SELECT a.page_id, a.pos, a.name, a.entity AS decl_id, coalesce(c.n, 0) AS n_uses
FROM a LEFT JOIN c ON c.page_id = a.page_id AND c.entity = a.entity
""")
def symbol_at_node(spark, sf_dir):
    """The symbol under the start of every node, looked up by position."""
    return over_nodes(spark, sf_dir, lambda nodes: resolve.code_symbol_at(
        nodes.select("doc_id", F.col("start_pos").alias("pos")).distinct(), nodes))


def _id(prefix, name, col, end, at="base"):
    return f"'{prefix}:' || {name} || ':' || ({at} // {L})::BIGINT || ':' || {col} || ':' || ({end})"


@query(f"""
WITH {NODES_SQL},
n AS (SELECT page_id, name, parent_kind, field, start_pos, parent_kind = 'var_spec' AS declares FROM v_code WHERE kind = 'identifier'),
l AS (SELECT *, last_value(CASE WHEN declares THEN start_pos END IGNORE NULLS) OVER (
        PARTITION BY page_id, name ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS d FROM n),
u AS (SELECT * FROM l WHERE NOT declares AND d IS NOT NULL),
t AS (
  SELECT page_id, 'node' AS part, 'Variable' AS type, {_id('var', 'name', f'start_pos % {L}', f'start_pos % {L} + 1', 'start_pos')} AS a, '' AS b FROM n WHERE declares
  UNION ALL SELECT page_id, 'node', 'Variable', {_id('use', 'name', f'start_pos % {L}', f'start_pos % {L} + 1', 'start_pos')}, '' FROM u
  UNION ALL SELECT page_id, 'node', 'Function', {_id('fn', 'name', '1', '2', 'start_pos')}, '' FROM n WHERE parent_kind = 'function_declaration'
  UNION ALL SELECT page_id, 'node', 'Goroutine', {_id('go', "'goroutine'", '1', '15 + 4 * m')}, '' FROM v_said WHERE k = 3
  UNION ALL SELECT page_id, 'node', 'Channel', {_id('chan', "'channel'", '11', '12')}, '' FROM v_said WHERE k = 5 AND (m // 7) % 2 = 1
  UNION ALL SELECT page_id, 'edge', 'Use', {_id('var', 'name', f'd % {L}', f'd % {L} + 1', 'd')}, {_id('use', 'name', f'start_pos % {L}', f'start_pos % {L} + 1', 'start_pos')} FROM u
  UNION ALL SELECT page_id, 'edge', 'Call', CASE k WHEN 0 THEN {_id('callsite', 'w[1]', '1', '15 + 4 * m')} ELSE {_id('callsite', 'w[1]', '2', '14 + 4 * m')} END,
         {_id('fn', 'w[1]', '10', '11')} FROM v_said WHERE k IN (0, 3)
  UNION ALL SELECT page_id, 'edge', 'Send', {_id('send', 'w[1]', '1', '15 + 4 * m')}, {_id('chan', 'w[1]', '10', '11')} FROM v_said WHERE k = 4
  UNION ALL SELECT page_id, 'edge', 'Receive', {_id('recv', 'w[1]', '1', '15 + 4 * m')}, {_id('chan', 'w[1]', '10', '11')} FROM v_said WHERE k = 6
  UNION ALL SELECT page_id, 'edge', 'Spawn', {_id('spawnsite', "'go'", '1', '15 + 4 * m')}, {_id('go', "'goroutine'", '1', '15 + 4 * m')} FROM v_said WHERE k = 3)
SELECT page_id, part, type, count(*) AS n, min(a) AS first_a, max(a) AS last_a, min(b) AS first_b, max(b) AS last_b FROM t GROUP BY ALL
""")
def code_graph(spark, sf_dir):
    """Nodes and edges of every program by type, with the first and the last id."""
    def counted(program):
        nodes, edges = graph.code_graph(program, code_facts.call_sites(program).filter("is_sync_call"))
        rows = stacked(
            nodes.select("doc_id", F.lit("node").alias("part"), F.col("entity_type").alias("type"), F.col("id").alias("a"), F.lit("").alias("b")),
            edges.select("doc_id", F.lit("edge").alias("part"), F.col("edge_type").alias("type"), F.col("from_id").alias("a"), F.col("to_id").alias("b")),
        )
        return rows.groupBy("doc_id", "part", "type").agg(
            F.count("*").alias("n"), F.min("a").alias("first_a"), F.max("a").alias("last_a"),
            F.min("b").alias("first_b"), F.max("b").alias("last_b"),
        )

    return over_nodes(spark, sf_dir, counted)
