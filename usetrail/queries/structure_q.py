"""Intervals and trees."""

from pyspark.sql import functions as F

from usetrail.functions.columns import LINE_SHIFT, entity_key, range_key, span_size
from usetrail.operators import structure as st
from usetrail.plans.scan import matched, stacked
from usetrail.queries.registry import query
from usetrail.sources import views as v


def tag_spans(spark, sf_dir):
    """Closed spans of tags with depth, plus one root span per page."""
    pages = v.table(spark, sf_dir, "pages")
    tokens = v.tag_tokens(pages)
    depth = st.nesting(tokens).select("page_id", F.col("pos").alias("start_pos"), "depth")
    spans = st.pair_spans(tokens).filter("end_pos IS NOT NULL").join(
        depth, ["page_id", "start_pos"]
    )
    roots = v.tag_tokens(pages).groupBy("page_id").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos")
    )
    return stacked(
        spans.withColumn("is_root", F.lit(False)),
        roots.select(
            "page_id", F.lit("page").alias("kind"), "start_pos", "end_pos",
            F.lit(0).cast("long").alias("depth"), F.lit(True).alias("is_root"),
        ),
    )


@query(f"""
WITH {v.WORDS_SQL}
SELECT doc_id, line, count(*) AS n_words, max(col) AS last_col,
       CAST(sum(length(word)) AS BIGINT) AS n_chars
FROM v_words GROUP BY ALL
""")
def line_col_tokens(spark, sf_dir):
    words = st.line_col_tokens(v.table(spark, sf_dir, "documents"))
    return words.groupBy("doc_id", "line").agg(
        F.count("*").alias("n_words"), F.max("col").alias("last_col"),
        F.sum(F.length("word")).alias("n_chars"),
    )


@query(f"WITH {v.TAGS_SQL}, {v.SPANS_SQL} SELECT * FROM v_spans")
def pair_spans(spark, sf_dir):
    return st.pair_spans(v.tag_tokens(v.table(spark, sf_dir, "pages")))


# the parent is the innermost closed span around an open tag
DEPTH_SQL = """
v_parent AS (
  SELECT o.page_id, o.start_pos AS pos, o.kind AS tag, max(p.start_pos) AS parent_pos,
         arg_max(p.kind, p.start_pos) AS parent_tag
  FROM v_spans o LEFT JOIN v_spans p ON p.page_id = o.page_id
    AND p.start_pos < o.start_pos AND p.end_pos > o.start_pos
  GROUP BY ALL)
"""


def tag_parents(spark, sf_dir):
    tokens = v.tag_tokens(v.table(spark, sf_dir, "pages"))
    return st.parents(st.nesting(tokens)).select(
        "page_id", "pos", "tag", "parent_pos", "parent_tag"
    )


@query(f"WITH {v.TAGS_SQL}, {v.SPANS_SQL}, {DEPTH_SQL} SELECT * FROM v_parent")
def parents(spark, sf_dir):
    return tag_parents(spark, sf_dir)


@query(f"""
WITH RECURSIVE {v.TREE_SQL}, {v.CLOSURE_SQL}
SELECT ancestor, distance, count(*) AS n FROM v_up GROUP BY ALL
""")
def ancestors(spark, sf_dir):
    pairs = st.ancestors(v.tree_view(spark, sf_dir), v.TREE_DEPTH, leaves=v.TREE_LEAVES)
    return pairs.groupBy("ancestor", "distance").agg(F.count("*").alias("n"))


@query("""
SELECT 'order:' || o_orderkey AS node_id, 'nation:' || c_nationkey AS nearest
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def nearest_ancestor(spark, sf_dir):
    return st.nearest_ancestor(
        v.tree_view(spark, sf_dir), ["nation"], v.TREE_DEPTH, start=F.col("kind") == "order",
        leaves=v.TREE_LEAVES,
    ).select("node_id", "nearest")


@query(f"""
WITH {v.TAGS_SQL}, {v.SPANS_SQL}
SELECT page_id, pos, start_pos, end_pos, kind FROM (
  SELECT t.page_id, t.pos, s.start_pos, s.end_pos, s.kind,
         row_number() OVER (PARTITION BY t.page_id, t.pos ORDER BY s.start_pos) AS rn
  FROM v_tags t JOIN v_spans s ON s.page_id = t.page_id AND t.pos BETWEEN s.start_pos AND s.end_pos
  WHERE t.is_open AND t.tag = 'a' AND s.kind IN ('ul', 'nav')) WHERE rn = 1
""")
def outermost_enclosing(spark, sf_dir):
    tokens = v.tag_tokens(v.table(spark, sf_dir, "pages"))
    links = tokens.filter("is_open AND tag = 'a'").select("page_id", "pos")
    return st.outermost_enclosing(links, st.pair_spans(tokens), ["ul", "nav"], ["page_id"], True)


@query(f"""
WITH {v.TAGS_SQL}, {v.SPANS_SQL},
s AS (SELECT page_id, kind, start_pos, end_pos, false AS is_root FROM v_spans
      WHERE end_pos IS NOT NULL
      UNION ALL SELECT page_id, 'page', min(pos), max(pos), true FROM v_tags GROUP BY page_id)
SELECT page_id, pos, kind, start_pos, end_pos, size FROM (
  SELECT t.page_id, t.pos, s.kind, s.start_pos, s.end_pos, s.end_pos - s.start_pos AS size,
         row_number() OVER (PARTITION BY t.page_id, t.pos
           ORDER BY s.end_pos - s.start_pos, s.is_root DESC, s.start_pos) AS rn
  FROM v_tags t JOIN s ON s.page_id = t.page_id AND t.pos BETWEEN s.start_pos AND s.end_pos)
WHERE rn = 1
""")
def locate(spark, sf_dir):
    points = v.tag_tokens(v.table(spark, sf_dir, "pages")).select("page_id", "pos")
    return st.locate(points, tag_spans(spark, sf_dir), ["page_id"], bounded=True).drop("depth")


#: Runs of so many lines, and the document: (kind, lines, depth).
LINE_RUNS = [("line", 1, 3), ("pair", 2, 2), ("block", 8, 1)]


def line_runs(words):
    """Spans of lines with their size as `span_size` counts it."""
    lines = words.groupBy("doc_id", "line").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    ends = [F.min(F.struct("line", "a")).alias("f"), F.max(F.struct("line", "b")).alias("l")]
    runs = [
        lines.groupBy("doc_id", F.expr(f"line div {n}")).agg(*ends).select(
            "doc_id", F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), F.lit(False).alias("is_root"), "f", "l"
        )
        for kind, n, depth in LINE_RUNS
    ]
    whole = lines.groupBy("doc_id").agg(*ends).select(
        "doc_id", F.lit("doc").alias("kind"), F.lit(0).alias("depth"), F.lit(True).alias("is_root"), "f", "l"
    )
    place = lambda line, col: F.col(line).cast("long") * LINE_SHIFT + F.col(col)
    return stacked(*runs, whole).select(
        "doc_id", "kind", "depth", "is_root", place("f.line", "f.a").alias("start_pos"), place("l.line", "l.b").alias("end_pos"),
        span_size(F.col("f.line"), F.col("f.a"), F.col("l.line"), F.col("l.b")).alias("lines_size"),
    )


@query(f"""
WITH {v.WORDS_SQL},
b AS (SELECT doc_id, line, min(col) AS a, max(col) AS b FROM v_words GROUP BY ALL),
r AS (
  {" UNION ALL ".join(f"SELECT doc_id, {n} AS n, line // {n} AS nr, '{k}' AS kind, {d} AS depth, min((line, a)) AS f, max((line, b)) AS l FROM b GROUP BY doc_id, line // {n}" for k, n, d in LINE_RUNS)}
  UNION ALL SELECT doc_id, 1 << 30, 0, 'doc', 0, min((line, a)), max((line, b)) FROM b GROUP BY doc_id),
s AS (
  SELECT doc_id, n, nr, kind, depth, f[1]::BIGINT * {LINE_SHIFT} + f[2] AS start_pos, l[1]::BIGINT * {LINE_SHIFT} + l[2] AS end_pos,
         CASE WHEN f[1] = l[1] THEN l[2] - f[2] ELSE (l[1] - f[1]) * 1000 + l[2] + f[2] END AS size FROM r),
w AS (SELECT doc_id, pos, line, unnest([1, 2, 8, 1 << 30]) AS n FROM v_words)
SELECT doc_id, pos, b.kind, b.start_pos, b.end_pos, b.size FROM (
  SELECT w.doc_id, w.pos, arg_min(s, (s.size, s.start_pos, s.depth)) AS b
  FROM w JOIN s ON s.doc_id = w.doc_id AND s.n = w.n AND s.nr = w.line // w.n GROUP BY ALL)
""")
def locate_by_lines(spark, sf_dir):
    """Smallest run of lines around every word, by the size that counts lines."""
    words = v.word_view(v.table(spark, sf_dir, "documents"))
    found = st.locate(words.select("doc_id", "pos"), line_runs(words), ["doc_id"], size=F.col("lines_size"), bounded=True)
    return found.drop("depth")


@query(f"""
WITH {v.WORDS_SQL},
s AS (SELECT doc_id, line AS start_line, min(col) AS start_col, line AS end_line,
             max(col) AS end_col FROM v_words GROUP BY doc_id, line
      UNION ALL
      SELECT doc_id, min(line), arg_min(col, pos), max(line), arg_max(col, pos)
      FROM v_words GROUP BY doc_id)
SELECT *, CASE WHEN start_line = end_line THEN end_col - start_col
  ELSE (end_line - start_line) * 1000 + end_col + start_col END AS size FROM s
""")
def span_sizes(spark, sf_dir):
    words = v.word_view(v.table(spark, sf_dir, "documents"))
    lines = words.groupBy("doc_id", "line").agg(
        F.min("col").alias("start_col"), F.max("col").alias("end_col")
    )
    whole = lines.groupBy("doc_id").agg(
        F.min(F.struct("line", "start_col")).alias("a"), F.max(F.struct("line", "end_col")).alias("b")
    )
    spans = stacked(
        lines.select(
            "doc_id", F.col("line").alias("start_line"), "start_col",
            F.col("line").alias("end_line"), "end_col",
        ),
        whole.select(
            "doc_id", F.col("a.line").alias("start_line"), F.col("a.start_col"),
            F.col("b.line").alias("end_line"), F.col("b.end_col"),
        ),
    )
    size = span_size(*[F.col(c) for c in ("start_line", "start_col", "end_line", "end_col")])
    return spans.withColumn("size", size)


@query(f"""
WITH {v.TAGS_SQL}, {v.SPANS_SQL}
SELECT i.page_id, i.kind, i.start_pos, i.end_pos, o.kind AS outer_kind,
       o.start_pos AS outer_start, o.end_pos AS outer_end
FROM v_spans i JOIN v_spans o ON i.page_id = o.page_id
  AND o.start_pos <= i.start_pos AND i.end_pos <= o.end_pos
WHERE i.kind = 'a' AND o.kind = 'ul'
""")
def contained(spark, sf_dir):
    spans = st.pair_spans(v.tag_tokens(v.table(spark, sf_dir, "pages")))
    return st.contained(spans.filter("kind = 'a'"), spans.filter("kind = 'ul'"), ["page_id"], True)


@query("""
SELECT DISTINCT 'customer:' || o_custkey AS node_id FROM orders JOIN (
  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber
  HAVING max(l_returnflag) = 'R') ON l_orderkey = o_orderkey
""")
def has_descendant(spark, sf_dir):
    returned = (F.col("kind") == "line") & (F.col("attr") == "R")
    return st.has_descendant(
        v.tree_view(spark, sf_dir), returned, v.TREE_DEPTH, "customer", leaves=v.TREE_LEAVES
    )


@query("""
SELECT 'nation:' || c_nationkey AS node_id, 'order:' || min(o_orderkey) AS first_id
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderpriority = '1-URGENT' GROUP BY c_nationkey
""")
def first_descendant(spark, sf_dir):
    urgent = F.col("note") == "1-URGENT"
    return st.first_descendant(
        v.tree_view(spark, sf_dir), urgent, v.TREE_DEPTH, "nation", leaves=v.TREE_LEAVES
    )


@query("""
WITH n AS (
  SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1
    AS ordinal FROM conversations),
u AS (SELECT * FROM n WHERE role = 'user'), a AS (SELECT * FROM n WHERE role = 'assistant'),
s AS (SELECT conv_id, min(text) AS text FROM n WHERE role = 'system' GROUP BY conv_id)
SELECT u.conv_id, u.ordinal, u.text AS left_value,
       coalesce(a.text, f.text, s.text) AS right_value
FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.ordinal = u.ordinal
LEFT JOIN a f ON f.conv_id = u.conv_id AND f.ordinal = 0
LEFT JOIN s ON s.conv_id = u.conv_id
""")
def zip_ordinal(spark, sf_dir):
    turns = v.table(spark, sf_dir, "conversations")
    listed = st.ordinals(turns, ["conv_id", "role"], ["turn"])
    whole = turns.filter("role = 'system'").groupBy("conv_id").agg(F.min("text").alias("text"))
    return st.zip_ordinal(
        listed.filter("role = 'user'"), listed.filter("role = 'assistant'"), ["conv_id"],
        "text", "text", whole,
    )


# the page's tags stand for the node kinds the class rules speak of
TAG_KIND = {
    "a": "identifier", "li": "var_spec", "div": "call_expression", "nav": "go_statement",
    "article": "function_declaration", "footer": "assignment_statement",
    "ul": "selector_expression", "h1": "field_identifier", "title": "type_identifier",
}


def _kind_of(tag: str):
    out = F.col(tag)
    for name, kind in TAG_KIND.items():
        out = F.when(F.col(tag) == name, kind).otherwise(out)
    return out


@query(f"""
WITH {v.TAGS_SQL}, {v.SPANS_SQL}, {DEPTH_SQL},
g AS (SELECT c.page_id, c.pos, c.tag, c.parent_tag FROM v_parent c)
SELECT page_id, pos,
  CASE WHEN tag = 'a' AND parent_tag IS NULL THEN 'Unknown'
       WHEN tag = 'a' THEN CASE parent_tag WHEN 'li' THEN 'VariableDeclaration'
         WHEN 'h1' THEN 'StructField' WHEN 'article' THEN 'FunctionName'
         WHEN 'div' THEN 'FunctionCall' WHEN 'ul' THEN 'ObjectAccess'
         WHEN 'nav' THEN 'GoroutineContext' WHEN 'footer' THEN 'Assignment'
         ELSE 'VariableUse' END
       WHEN tag = 'h1' THEN 'FieldAccess' WHEN tag = 'title' THEN 'TypeReference'
       WHEN tag = 'article' THEN 'FunctionDeclaration'
       WHEN tag = 'nav' THEN 'GoroutineStatement' ELSE 'Unknown' END AS context_type,
  'Node: ' || CASE tag WHEN 'a' THEN 'identifier' WHEN 'li' THEN 'var_spec'
    WHEN 'div' THEN 'call_expression' WHEN 'nav' THEN 'go_statement'
    WHEN 'article' THEN 'function_declaration' WHEN 'footer' THEN 'assignment_statement'
    WHEN 'ul' THEN 'selector_expression' WHEN 'h1' THEN 'field_identifier'
    WHEN 'title' THEN 'type_identifier' ELSE tag END || ' at 0:' || pos AS details
FROM g
""")
def classify_context(spark, sf_dir):
    rows = tag_parents(spark, sf_dir)
    none = F.lit(None).cast("string")
    nodes = rows.select(
        "page_id", "pos", _kind_of("tag").alias("kind"), _kind_of("parent_tag").alias("parent_kind"),
        none.alias("field"), none.alias("grand_kind"), none.alias("parent_field"),
    )
    details = st.context_details(F.col("kind"), F.lit(0), F.col("pos"))
    return st.classify_context(nodes).select(
        "page_id", "pos", "context_type", details.alias("details")
    )


@query(f"""
WITH {v.WORDS_SQL},
k AS (SELECT doc_id, 'use:' || word || ':' || line || ':' || col || ':' || (col + 1) AS k1,
             line || ':' || col || ':' || line || ':' || (col + 1) AS k2 FROM v_words)
SELECT doc_id, count(DISTINCT k1) AS n_keys, min(k1) AS first_key, max(k1) AS last_key,
       count(DISTINCT k2) AS n_ranges, max(k2) AS last_range FROM k GROUP BY doc_id
""")
def make_keys(spark, sf_dir):
    words = v.word_view(v.table(spark, sf_dir, "documents"))
    end = F.col("col") + 1
    keys = words.select(
        "doc_id", entity_key(F.lit("use"), F.col("word"), F.col("line"), F.col("col"), end).alias("k1"),
        range_key(F.col("line"), F.col("col"), F.col("line"), end).alias("k2"),
    )
    # one kind of key at a time: two distinct counts at once copy every key and shuffle the copies
    first = keys.groupBy("doc_id").agg(
        F.countDistinct("k1").alias("n_keys"), F.min("k1").alias("first_key"), F.max("k1").alias("last_key")
    )
    last = keys.groupBy("doc_id").agg(F.countDistinct("k2").alias("n_ranges"), F.max("k2").alias("last_range"))
    return matched(first, last, ["doc_id"])
