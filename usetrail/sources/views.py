"""Occurrence views over the test tables, and their SQL twins for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usetrail.functions.columns import LINE_SHIFT, micros
from usetrail.plans.scan import stacked
from usetrail.session import spread

TAG_PATTERN = "</?[a-zA-Z][a-zA-Z0-9]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What an event of each type does to its entity.
OPS = {"signup": "decl", "view": "read", "purchase": "write", "click": "acquire", "error": "release"}


def op_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for event_type, op in OPS.items():
        out = F.when(kind == event_type, op).otherwise(out)
    return out


def access_view(events: DataFrame, ops: list[str] | None = None) -> DataFrame:
    """Events as accesses of an entity (the key in `props`) by a user.

    `ops` keeps these only, by a filter on the stored type, which reaches the scan.
    """
    kind = F.col("event_type")
    if ops is not None:
        events = events.filter(kind.isin([t for t, op in OPS.items() if op in ops]))
    entity = F.get_json_object("props", "$.k").cast("int")
    is_lock = kind.isin("click", "error")
    op = op_of(kind)
    facts = events.select(
        entity.alias("entity"), F.col("user_id").alias("ctx"), micros("ts").alias("pos"),
        F.col("event_id").alias("seq"), F.col("ts").cast("date").cast("string").alias("day"),
        op.alias("op"), "value", is_lock.alias("_lock"),
    ).filter(F.col("entity").isNotNull())
    # how each use is written: what calls it, what it is assigned from, its type
    return facts.select(
        "entity", "ctx", "pos", "seq", "day", "op", "value",
        F.when(F.col("_lock"), (F.col("entity") % 3).cast("string")).alias("lock_key"),
        ((F.col("entity") % 5 == 0) & (F.col("seq") % 2 == 0)).alias("is_atomic"),
        (F.col("ctx") % 2 == 1).alias("concurrent"),
        ((F.col("op") == "release") & (F.col("value") < 1)).alias("deferred"),
        F.when(F.col("value") > 100, "copy").otherwise("len").alias("callee"),
        (F.col("entity") % 7 != 0).alias("is_field"),
        (F.col("entity") % 14 == 0).alias("is_pointer"),
        ((F.col("op") == "read") & (F.col("value") < 40)).alias("copied"),
        F.when(F.col("entity") % 4 == 0, "Slice").when(F.col("entity") % 4 == 1, "String")
        .when(F.col("entity") % 4 == 2, "Map").otherwise("Other").alias("type_kind"),
        F.when((F.col("op") == "write") & (F.col("value") < 30), "slice_expression")
        .when((F.col("op") == "write") & (F.col("value") < 60), "identifier")
        .when(F.col("op") == "write", "call_expression").alias("rhs_kind"),
    )


ACCESS_SQL = """
v_facts AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INT) AS entity, user_id AS ctx,
         epoch_us(ts) AS pos, event_id AS seq, strftime(ts, '%Y-%m-%d') AS day,
         CASE event_type WHEN 'signup' THEN 'decl' WHEN 'view' THEN 'read'
              WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'acquire'
              WHEN 'error' THEN 'release' END AS op,
         value, event_type IN ('click', 'error') AS is_lock
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
v_access AS (
  SELECT entity, ctx, pos, seq, day, op, value,
         CASE WHEN is_lock THEN CAST(entity % 3 AS VARCHAR) END AS lock_key,
         (entity % 5 = 0 AND seq % 2 = 0) AS is_atomic,
         (ctx % 2 = 1) AS concurrent,
         (op = 'release' AND value < 1) AS deferred,
         CASE WHEN value > 100 THEN 'copy' ELSE 'len' END AS callee,
         (entity % 7 <> 0) AS is_field, (entity % 14 = 0) AS is_pointer,
         (op = 'read' AND value < 40) AS copied,
         CASE entity % 4 WHEN 0 THEN 'Slice' WHEN 1 THEN 'String' WHEN 2 THEN 'Map'
              ELSE 'Other' END AS type_kind,
         CASE WHEN op = 'write' AND value < 30 THEN 'slice_expression'
              WHEN op = 'write' AND value < 60 THEN 'identifier'
              WHEN op = 'write' THEN 'call_expression' END AS rhs_kind
  FROM v_facts)
"""


def tree_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer > orders > lines as one node table."""

    def level(name, kind, key, parent_kind, parent, attr, note=None):
        src = table(spark, sf_dir, name) if isinstance(name, str) else name
        up = F.concat(F.lit(f"{parent_kind}:"), F.col(parent)) if parent else F.lit(None)
        return src.select(
            F.concat_ws(":", F.lit(kind), *[F.col(k) for k in key]).alias("node_id"),
            up.cast("string").alias("parent_id"), F.lit(kind).alias("kind"),
            F.col(key[-1]).cast("long").alias("ordinal"), F.col(attr).alias("attr"),
            (F.col(note) if note else F.lit(None)).cast("string").alias("note"),
        )

    lines = (
        table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_returnflag").alias("flag"))
    )
    return stacked(
        level("region", "region", ["r_regionkey"], None, None, "r_name"),
        level("nation", "nation", ["n_nationkey"], "region", "n_regionkey", "n_name"),
        level("customer", "customer", ["c_custkey"], "nation", "c_nationkey", "c_mktsegment"),
        level("orders", "order", ["o_orderkey"], "customer", "o_custkey", "o_orderstatus",
              "o_orderpriority"),
        level(lines, "line", ["l_orderkey", "l_linenumber"], "order", "l_orderkey", "flag"),
    )


TREE_DEPTH = 4  # steps from a line to its region, fixed by the schema
TREE_LEAVES = ["line"]

TREE_SQL = """
v_tree AS (
  SELECT 'region:' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id,
         'region' AS kind, CAST(r_regionkey AS BIGINT) AS ordinal, r_name AS attr,
         CAST(NULL AS VARCHAR) AS note FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'nation',
         CAST(n_nationkey AS BIGINT), n_name, NULL FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'customer',
         c_custkey, c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'order',
         o_orderkey, o_orderstatus, o_orderpriority FROM orders
  UNION ALL SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'order:' || l_orderkey,
         'line', CAST(l_linenumber AS BIGINT), max(l_returnflag), NULL
         FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
# every (node, ancestor, distance)
CLOSURE_SQL = """
v_up AS (
  SELECT node_id, parent_id AS ancestor, 1 AS distance FROM v_tree WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT u.node_id, t.parent_id, u.distance + 1 FROM v_up u JOIN v_tree t
  ON t.node_id = u.ancestor WHERE t.parent_id IS NOT NULL)
"""


def tag_tokens(pages: DataFrame) -> DataFrame:
    """Every tag of every page, in order: (page_id, pos, tag, is_open).

    Pages are spread by key before they are cut up, so all work per page that follows
    finds its tags in place and moves no tokens.
    """
    found = F.expr(f"regexp_extract_all(html, '{TAG_PATTERN}', 0)")
    tokens = spread(pages.select("page_id", "html"), "page_id", "html").select("page_id", F.posexplode(found).alias("pos", "token"))
    return tokens.select(
        "page_id", F.col("pos").cast("long").alias("pos"),
        F.regexp_replace("token", "[</]", "").alias("tag"),
        (~F.col("token").startswith("</")).alias("is_open"),
    )


TAGS_SQL = f"""
v_tag_lists AS (
  SELECT page_id, regexp_extract_all(html, '{TAG_PATTERN}', 0) AS l FROM pages),
v_tag_rows AS (
  SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS token
  FROM v_tag_lists),
v_tags AS (
  SELECT page_id, pos, regexp_replace(token, '[</]', '', 'g') AS tag,
         NOT starts_with(token, '</') AS is_open FROM v_tag_rows)
"""
# spans by a stack walk: each open is closed by the first later close at which the
# count of same-tag opens and closes after it balances
SPANS_SQL = """
v_spans AS (
  SELECT o.page_id, o.tag AS kind, o.pos AS start_pos, min(w.pos) AS end_pos
  FROM (SELECT * FROM v_tags WHERE is_open) o
  LEFT JOIN (
    SELECT page_id, start_pos, pos FROM (
      SELECT a.page_id, a.pos AS start_pos, b.pos, b.is_open,
             sum(CASE WHEN b.is_open THEN 1 ELSE -1 END)
               OVER (PARTITION BY a.page_id, a.pos ORDER BY b.pos) AS bal
      FROM v_tags a JOIN v_tags b ON a.page_id = b.page_id AND a.tag = b.tag AND b.pos >= a.pos
      WHERE a.is_open)
    WHERE bal = 0) w
  ON w.page_id = o.page_id AND w.start_pos = o.pos
  GROUP BY ALL)
"""


def line_view(documents: DataFrame) -> DataFrame:
    """Every line of the texts with its 0-based number.

    The texts are spread by document before they are cut up: what is shuffled is one
    row per text, and later windows and aggregates per document move no words.
    """
    return spread(documents.select("doc_id", "text"), "doc_id", "text").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "line_text")
    )


def words_in(lines: DataFrame) -> DataFrame:
    """Every word of the lines with its 0-based line and place in the line."""
    words = lines.select(
        "doc_id", "line", F.posexplode(F.split("line_text", " ", -1)).alias("col", "word")
    ).filter(F.col("word") != "")
    return words.select(
        "doc_id", "line", "col", "word",
        (F.col("line").cast("long") * LINE_SHIFT + F.col("col")).alias("pos"),
    )


def last_words_in(lines: DataFrame) -> DataFrame:
    """Where the last word of each line stands (doc_id, line, pos); the words are not cut out for it."""
    text = F.rtrim("line_text")
    # as many places as spaces before the last word
    col = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return lines.filter(text != "").select(
        "doc_id", "line", (F.col("line").cast("long") * LINE_SHIFT + col).alias("pos"))


def word_view(documents: DataFrame) -> DataFrame:
    """Every word with its 0-based line and place in the line."""
    return words_in(line_view(documents))


WORDS_SQL = f"""
v_doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
v_lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line, unnest(l) AS line_text
  FROM v_doc_lines),
v_line_words AS (SELECT doc_id, line, string_split(line_text, ' ') AS w FROM v_lines),
v_all_words AS (
  SELECT doc_id, line, CAST(generate_subscripts(w, 1) - 1 AS INT) AS col, unnest(w) AS word
  FROM v_line_words),
v_words AS (
  SELECT doc_id, line, col, word, CAST(line AS BIGINT) * {LINE_SHIFT} + col AS pos
  FROM v_all_words WHERE word <> '')
"""
