"""Syntax-node tables: from nested spans to numbered nodes, and pages read as programs.

Canonical columns: doc_id, node_id, parent_id, field, ordinal, kind, start_pos, end_pos
(exclusive), depth, text. `node_id` is the place in pre-order, so a parent comes before its
children and a subtree is a range of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions.columns import LINE_SHIFT
from usetrail.plans.scan import latest, running, total
from usetrail.session import spread

DOC = ["doc_id"]


def node_table(spans: DataFrame, bounded: bool = True) -> DataFrame:
    """Number nested spans (doc_id, kind, field, start_pos, end_pos, depth, text) and link them.

    Two ordered scans and no join: the number is the count of spans before, the parent the
    latest earlier span one level up. `bounded`: a document's spans come out of one row.
    """
    numbered = running(spans, DOC, ["start_pos", "depth"], bounded, node_id=total(F.lit(1), exclusive=True))
    sides = F.array(
        F.struct(F.col("depth").alias("_level"), F.lit(True).alias("_own")),
        F.struct((F.col("depth") - 1).alias("_level"), F.lit(False).alias("_own")),
    )
    entries = numbered.select("*", F.inline(sides))
    linked = running(
        entries, [*DOC, "_level"], ["node_id"], bounded, parent_id=latest(F.when(F.col("_own"), F.col("node_id")))
    ).filter(~F.col("_own"))
    placed = running(linked, [*DOC, "parent_id"], ["node_id"], bounded, ordinal=total(F.lit(1), exclusive=True))
    return placed.select(
        "doc_id", "node_id", "parent_id", "field", F.col("ordinal").cast("int").alias("ordinal"), "kind",
        "start_pos", "end_pos", "depth", "text",
    )


def with_kinds(nodes: DataFrame, levels: int = 2, bounded: bool = True) -> DataFrame:
    """Add kind and field of the ancestors up to `levels` (parent_kind, parent_field, grand_kind, ..).

    Every node stands under its own id and asks under its parent's: a scan per level, no join.
    """
    out, above = nodes.withColumn("_above", F.col("parent_id")), F.struct(F.col("parent_id").alias("up"), "kind", "field")
    for name in ("parent", "grand", "great")[:levels]:
        sides = F.array(
            F.struct(F.col("node_id").alias("_key"), F.lit(0).alias("_turn")),
            F.struct(F.col("_above").alias("_key"), F.lit(1).alias("_turn")),
        )
        own = (F.col("_turn") == 0) & F.col("doc_id").isNotNull()
        found = running(out.select("*", F.inline(sides)), [*DOC, "_key"], ["_turn"], bounded, _up=latest(F.when(own, above)))
        out = found.filter("_turn = 1").select(
            *out.drop("_above").columns, F.col("_up.kind").alias(f"{name}_kind"), F.col("_up.field").alias(f"{name}_field"),
            F.col("_up.up").alias("_above"),
        )
    return out.drop("_above")


OPEN_TAG = "<([a-zA-Z][a-zA-Z0-9]*)[^>]*>([^<]*)"
#: What a statement is, by its number of words modulo 7.
STATEMENTS = [
    "call_expression", "short_var_declaration", "assignment_statement", "go_statement", "send_statement",
    "var_spec", "unary_expression",
]
SPAN = (
    "array<struct<kind:string,field:string,start_pos:bigint,end_pos:bigint,depth:int,text:string>>"
)


def _node(kind, field, start, end, depth, text=None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        lit(kind).cast("string").alias("kind"), lit(field).cast("string").alias("field"),
        lit(start).cast("long").alias("start_pos"), lit(end).cast("long").alias("end_pos"),
        lit(depth).cast("int").alias("depth"), lit(text).cast("string").alias("text"),
    )


def page_programs(pages: DataFrame) -> DataFrame:
    """Spans of pages (page_id, html) read as programs, one document a page.

    Every link is a package-level variable, the heading names a function, and every paragraph
    with words is a statement of its block: its first word is called, declared, assigned, sent
    to or received from, the other words are arguments or values. What it is follows from its
    number of words. Lines: links 1, heading 2, statements from 3 on.
    """
    found = spread(pages.select("page_id", "html"), "page_id", "html").select(
        F.col("page_id").alias("doc_id"),
        F.arrays_zip(
            F.expr(f"regexp_extract_all(html, '{OPEN_TAG}', 1)").alias("tag"),
            F.transform(F.expr(f"regexp_extract_all(html, '{OPEN_TAG}', 2)"),
                        lambda t: F.filter(F.split(t, " "), lambda w: w != "")).alias("words"),
        ).alias("tags"),
    )

    def of(*names: str) -> Column:
        return F.filter("tags", lambda t: t["tag"].isin(*names) & (F.size(t["words"]) > 0))

    page = found.select("doc_id", of("a").alias("links"), of("h1").alias("heads"), of("p", "b").alias("said"))
    line = lambda n: n * F.lit(LINE_SHIFT).cast("long")
    end = line(F.size("said") + 3)
    whole = F.array(
        _node("source_file", None, 0, end, 0),
        _node("function_declaration", None, line(F.lit(2)), end - 1, 1),
        _node("block", "body", line(F.lit(2)) + 10, end - 2, 2),
    )
    name = F.when(F.size("heads") > 0, F.array(
        _node("identifier", "name", line(F.lit(2)) + 1, line(F.lit(2)) + 2, 2, F.get(F.get("heads", F.lit(0))["words"], F.lit(0)))
    )).otherwise(F.array().cast(SPAN))

    def link(t: Column, i: Column) -> Column:
        at = line(F.lit(1)) + 20 * i
        return F.array(
            _node("var_spec", None, at, at + 10, 1),
            _node("identifier", "name", at + 2, at + 3, 2, F.get(t["words"], F.lit(0))),
        )

    # the top of the page is the first part, every statement one more: all stay where the page is
    top = F.struct(F.concat(whole, name, F.flatten(F.transform("links", link))).alias("top"), F.array().cast("array<string>").alias("words"))
    others = F.transform("said", lambda t: F.struct(F.lit(None).cast(SPAN).alias("top"), t["words"].alias("words")))
    said = page.select("doc_id", F.posexplode(F.concat(F.array(top), others)).alias("j", "t")).select(
        "doc_id", F.col("t.top").alias("top"), line(F.col("j") + 2).alias("at"), F.col("t.words").alias("words"),
        F.size("t.words").alias("m"),
    ).withColumn("k", F.col("m") % len(STATEMENTS))
    at, m, k = F.col("at"), F.col("m"), F.col("k")
    after = at + 10 + 4 * m
    spawn = (k == 3).cast("int")
    listed = k.isin(1, 2)
    kind = F.get(F.array(*[F.lit(s) for s in STATEMENTS]), k)
    first = F.get("words", F.lit(0))

    def some(cond: Column, *nodes: Column) -> Column:
        return F.when(cond, F.array(*nodes)).otherwise(F.array().cast(SPAN))

    field = F.when(k.isin(0, 3), "function").when(k == 4, "channel").when(k == 5, "name").when(k == 6, "operand")
    rest = F.when(k.isin(0, 3), "arguments").when(listed, "right").when(k.isin(4, 5), "value")
    rows = F.concat(
        F.array(
            _node(kind, None, at + 1, after + 5, 3),
            _node("identifier", field, at + 10, at + 11, 4 + (listed | (k == 3)).cast("int"), first),
        ),
        some(k == 3, _node("call_expression", None, at + 2, after + 4, 4)),
        some(listed, _node("expression_list", "left", at + 9, at + 12, 4)),
        some(k == 6, _node("<-", "operator", at + 8, at + 9, 4, "<-")),
        some((k == 5) & (F.expr(f"m div {len(STATEMENTS)}") % 2 == 1), _node("channel_type", "type", at + 11, at + 12, 4)),
        some(m > 1, _node(F.when(k.isin(0, 3), "argument_list").otherwise("expression_list"), rest, at + 13, after + 3, 4 + spawn)),
        F.transform(
            F.slice("words", 2, F.greatest(m - 1, F.lit(0))),
            lambda w, i: _node("identifier", None, at + 14 + 4 * i, at + 15 + 4 * i, 5 + spawn, w),
        ),
    )
    return said.select("doc_id", F.inline(F.when(F.col("top").isNotNull(), F.col("top")).otherwise(rows)))


def page_nodes(pages: DataFrame) -> DataFrame:
    return node_table(page_programs(pages))


_LINE = LINE_SHIFT
#: Nodes of the same programs with what stands above them, by construction.
NODES_SQL = f"""
v_open AS (
  SELECT page_id, i, regexp_extract_all(html, '{OPEN_TAG}', 1)[i] AS tag,
         list_filter(string_split(regexp_extract_all(html, '{OPEN_TAG}', 2)[i], ' '), lambda w: w <> '') AS w
  FROM (SELECT page_id, html, unnest(range(1, len(regexp_extract_all(html, '{OPEN_TAG}', 1)) + 1)) AS i FROM pages)),
v_said AS (
  SELECT *, len(w) AS m, len(w) % 7 AS k, ['{"', '".join(STATEMENTS)}'][len(w) % 7 + 1] AS stmt,
         ((row_number() OVER (PARTITION BY page_id ORDER BY i)) + 2)::BIGINT * {_LINE} AS base
  FROM v_open WHERE tag IN ('p', 'b') AND len(w) > 0),
v_links AS (
  SELECT *, {_LINE} + 20 * ((row_number() OVER (PARTITION BY page_id ORDER BY i)) - 1) AS base
  FROM v_open WHERE tag = 'a' AND len(w) > 0),
v_ends AS (
  SELECT p.page_id, (count(s.page_id) + 3) * {_LINE} AS e FROM pages p LEFT JOIN v_said s ON s.page_id = p.page_id GROUP BY p.page_id),
v_rest AS (
  SELECT page_id, base, m, k, stmt, w[x] AS word, base + 10 + 4 * (x - 1) AS pos
  FROM (SELECT *, unnest(range(2, m + 1)) AS x FROM v_said)),
v_code AS (
  SELECT page_id, 'source_file' AS kind, NULL AS field, NULL AS parent_kind, NULL AS grand_kind, NULL AS parent_field,
         0::BIGINT AS start_pos, e::BIGINT AS end_pos, 0 AS depth, NULL AS name, NULL::BIGINT AS up FROM v_ends
  UNION ALL SELECT page_id, 'function_declaration', NULL, 'source_file', NULL, NULL, 2 * {_LINE}, e - 1, 1, NULL, 0 FROM v_ends
  UNION ALL SELECT page_id, 'block', 'body', 'function_declaration', 'source_file', NULL, 2 * {_LINE} + 10, e - 2, 2, NULL, 2 * {_LINE} FROM v_ends
  UNION ALL SELECT page_id, 'identifier', 'name', 'function_declaration', 'source_file', NULL, 2 * {_LINE} + 1, 2 * {_LINE} + 2, 2,
         arg_min(w[1], i), 2 * {_LINE} FROM v_open WHERE tag = 'h1' AND len(w) > 0 GROUP BY page_id
  UNION ALL SELECT page_id, 'var_spec', NULL, 'source_file', NULL, NULL, base, base + 10, 1, NULL, 0 FROM v_links
  UNION ALL SELECT page_id, 'identifier', 'name', 'var_spec', 'source_file', NULL, base + 2, base + 3, 2, w[1], base FROM v_links
  UNION ALL SELECT page_id, stmt, NULL, 'block', 'function_declaration', 'body', base + 1, base + 15 + 4 * m, 3, NULL, 2 * {_LINE} + 10 FROM v_said
  UNION ALL SELECT page_id, 'call_expression', NULL, 'go_statement', 'block', NULL, base + 2, base + 14 + 4 * m, 4, NULL, base + 1 FROM v_said WHERE k = 3
  UNION ALL SELECT page_id, 'expression_list', 'left', stmt, 'block', NULL, base + 9, base + 12, 4, NULL, base + 1 FROM v_said WHERE k IN (1, 2)
  UNION ALL SELECT page_id, '<-', 'operator', stmt, 'block', NULL, base + 8, base + 9, 4, '<-', base + 1 FROM v_said WHERE k = 6
  UNION ALL SELECT page_id, 'channel_type', 'type', stmt, 'block', NULL, base + 11, base + 12, 4, NULL, base + 1 FROM v_said WHERE k = 5 AND (m // 7) % 2 = 1
  UNION ALL SELECT page_id, 'identifier', CASE WHEN k IN (0, 3) THEN 'function' WHEN k = 4 THEN 'channel' WHEN k = 5 THEN 'name' WHEN k = 6 THEN 'operand' END,
         CASE WHEN k IN (1, 2) THEN 'expression_list' WHEN k = 3 THEN 'call_expression' ELSE stmt END,
         CASE WHEN k IN (1, 2, 3) THEN stmt ELSE 'block' END, CASE WHEN k IN (1, 2) THEN 'left' END,
         base + 10, base + 11, CASE WHEN k IN (1, 2, 3) THEN 5 ELSE 4 END, w[1],
         base + CASE WHEN k IN (1, 2) THEN 9 WHEN k = 3 THEN 2 ELSE 1 END FROM v_said
  UNION ALL SELECT page_id, CASE WHEN k IN (0, 3) THEN 'argument_list' ELSE 'expression_list' END,
         CASE WHEN k IN (0, 3) THEN 'arguments' WHEN k IN (1, 2) THEN 'right' WHEN k IN (4, 5) THEN 'value' END,
         CASE WHEN k = 3 THEN 'call_expression' ELSE stmt END, CASE WHEN k = 3 THEN stmt ELSE 'block' END, NULL,
         base + 13, base + 13 + 4 * m, CASE WHEN k = 3 THEN 5 ELSE 4 END, NULL, base + CASE WHEN k = 3 THEN 2 ELSE 1 END FROM v_said WHERE m > 1
  UNION ALL SELECT page_id, 'identifier', NULL, CASE WHEN k IN (0, 3) THEN 'argument_list' ELSE 'expression_list' END,
         CASE WHEN k = 3 THEN 'call_expression' ELSE stmt END,
         CASE WHEN k IN (0, 3) THEN 'arguments' WHEN k IN (1, 2) THEN 'right' WHEN k IN (4, 5) THEN 'value' END,
         pos, pos + 1, CASE WHEN k = 3 THEN 6 ELSE 5 END, word, base + 13 FROM v_rest)
"""
