"""Declarations, uses and resolution."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from usetrail.functions.columns import LINE_SHIFT, col_of, line_of
from usetrail.operators import symbols as sy
from usetrail.plans.resolve import symbol_at as symbols_at
from usetrail.plans.scan import lowest, running, stacked
from usetrail.queries.registry import query
from usetrail.sources import views as v


def words_of(spark, sf_dir):
    return v.word_view(v.table(spark, sf_dir, "documents"))


def lines_of(spark, sf_dir):
    return v.line_view(v.table(spark, sf_dir, "documents"))


def word_scopes(lines):
    """Each document and each of its lines as a scope, if it has words."""
    ends = v.last_words_in(lines).select("doc_id", F.explode(F.array(F.col("line") + 1, F.lit(0))).alias("scope_id"), "pos")
    scope = F.col("scope_id")
    return ends.groupBy("doc_id", "scope_id").agg(F.max("pos").alias("end_pos")).select(
        "doc_id", F.when(scope > 0, "line").otherwise("doc").alias("kind"), "scope_id",
        F.when(scope > 0, 1).otherwise(0).alias("depth"),
        F.when(scope > 0, (scope - 1).cast("long") * LINE_SHIFT).otherwise(F.lit(0)).alias("start_pos"), "end_pos",
    )


def word_timeline(words):
    """Words as scope entries: a word is declared where it first stands.

    Every word is a use in its line and in its document, and a declaration in each of
    the two where it comes first; visible once its statement, here the word, is over.
    All four entries come out of one pass over the words, sorted once: both firsts are minima over
    the same window, of all rows of the word and of those of its line.
    """
    by = Window.partitionBy("doc_id", "word").orderBy("line")
    here, whole = by.rangeBetween(0, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = words.withColumns({"in_line": F.min("pos").over(here), "in_doc": F.min("pos").over(whole)})
    # 0 and 1 are uses, 2 and 3 declarations, of the line and of the document
    entry, pos = F.col("_entry"), F.col("pos")
    is_use, in_line = entry < 2, entry % 2 == 0
    rows = first.withColumn("_entry", F.explode(F.array(*map(F.lit, range(4))))).filter(
        is_use | (pos == F.when(in_line, F.col("in_line")).otherwise(F.col("in_doc"))))
    return rows.select(
        "doc_id", F.col("word").alias("name"),
        F.when(in_line, F.col("line") + 1).otherwise(0).cast("long").alias("scope_id"),
        F.when(in_line, 1).otherwise(0).alias("depth"), F.when(is_use, 1).otherwise(0).alias("is_use"),
        pos.alias("at"), F.when(is_use, pos).otherwise(pos + 1).alias("pos"), F.when(~is_use, pos).alias("decl"),
    )


@query(f"""
WITH {v.WORDS_SQL},
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, word ORDER BY pos) AS rn FROM v_words)
SELECT doc_id, CASE WHEN col = 0 THEN 'parameter_declaration' ELSE 'short_var_declaration' END AS kind,
       count(*) AS n, max(pos) AS last_pos
FROM c WHERE col = 0 OR rn = 1 GROUP BY ALL
""")
def extract_decls(spark, sf_dir):
    # the first word of a line stands for a parameter, all others for `:=`
    kind = F.when(F.col("col") == 0, "parameter_declaration").otherwise("short_var_declaration")
    rows = words_of(spark, sf_dir).select(
        "doc_id", "line", F.col("word").alias("name"), "pos", kind.alias("kind"),
        F.lit(False).alias("declares"),
    )
    found = sy.extract_decls(rows, ["doc_id", "line"], bounded=True)
    return found.groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.max("pos").alias("last_pos")
    )


RESOLVED_SQL = """
v_first AS (
  SELECT *, min(pos) OVER (PARTITION BY doc_id, line, word) AS in_line,
         min(pos) OVER (PARTITION BY doc_id, word) AS in_doc FROM v_words),
v_resolved AS (
  SELECT doc_id, word, pos, CASE WHEN in_line < pos THEN in_line WHEN in_doc < pos THEN in_doc END
    AS decl_id FROM v_first)
"""


@query(f"""
WITH {v.WORDS_SQL}, {RESOLVED_SQL}
SELECT doc_id, CAST(decl_id // {LINE_SHIFT} = pos // {LINE_SHIFT} AS BOOLEAN) AS same_line,
       count(*) AS n, CAST(sum(decl_id // {LINE_SHIFT}) AS BIGINT) AS decl_lines,
       CAST(sum(decl_id % {LINE_SHIFT}) AS BIGINT) AS decl_cols
FROM v_resolved WHERE decl_id IS NOT NULL GROUP BY ALL
""")
def resolve_timeline(spark, sf_dir):
    words = words_of(spark, sf_dir)
    return _by_line(sy.resolve_timeline(word_timeline(words), ["doc_id"], bounded=True))


@query(f"""
WITH {v.WORDS_SQL}, {RESOLVED_SQL}
SELECT doc_id, CAST(decl_id // {LINE_SHIFT} = pos // {LINE_SHIFT} AS BOOLEAN) AS same_line,
       count(*) AS n, CAST(sum(decl_id // {LINE_SHIFT}) AS BIGINT) AS decl_lines,
       CAST(sum(decl_id % {LINE_SHIFT}) AS BIGINT) AS decl_cols
FROM v_resolved WHERE decl_id IS NOT NULL GROUP BY ALL
""")
def resolve_scoped(spark, sf_dir):
    """The same answers from three tables: uses, declarations and scopes."""
    lines = lines_of(spark, sf_dir)
    words = v.words_in(lines)
    uses = words.select("doc_id", F.col("word").alias("name"), "pos")
    entries = word_timeline(words)
    decls = entries.filter("decl IS NOT NULL").select(
        "doc_id", "name", F.col("decl").alias("decl_id"), "scope_id", F.col("pos").alias("visible_from")
    )
    scopes = word_scopes(lines).select(
        "doc_id", F.col("scope_id").cast("long").alias("scope_id"), "depth", "start_pos", "end_pos"
    )
    return _by_line(sy.resolve_scoped(uses, decls, scopes, ["doc_id"], bounded=True))


def _by_line(found):
    line = line_of(F.col("decl_id"))
    return found.groupBy("doc_id", (line == line_of(F.col("pos"))).alias("same_line")).agg(
        F.count("*").alias("n"), F.sum(line).alias("decl_lines"),
        F.sum(col_of(F.col("decl_id"))).alias("decl_cols"),
    )


@query(f"""
WITH {v.ACCESS_SQL}
SELECT seq, entity, last_value(CASE WHEN op = 'decl' THEN seq END IGNORE NULLS) OVER (
  PARTITION BY entity ORDER BY pos, seq ROWS UNBOUNDED PRECEDING) AS decl_id FROM v_access
""")
def resolve_asof(spark, sf_dir):
    rows = v.access_view(v.table(spark, sf_dir, "events")).select("entity", "pos", "seq", "op")
    return sy.resolve_asof(
        rows, ["entity"], ["pos", "seq"], F.col("op") == "decl", F.col("seq")
    ).select("seq", "entity", "decl_id")


@query(f"""
WITH {v.WORDS_SQL},
c AS (SELECT doc_id, word, count(*) - 1 AS n FROM v_words GROUP BY ALL)
SELECT doc_id, count(*) AS n_decls, CAST(sum(n) AS BIGINT) AS n_uses, max(n) AS most_uses
FROM c GROUP BY doc_id
""")
def count_uses(spark, sf_dir):
    words = words_of(spark, sf_dir)
    resolved = running(words, ["doc_id", "word"], ["pos"], True, decl_id=lowest(F.col("pos")))
    return sy.count_uses(resolved, ["doc_id", "word"]).groupBy("doc_id").agg(
        F.count("*").alias("n_decls"), F.sum("n_uses").alias("n_uses"),
        F.max("n_uses").alias("most_uses"),
    )


@query(f"""
WITH {v.WORDS_SQL}, {RESOLVED_SQL}
SELECT doc_id, count(*) AS n, max(pos) AS last_pos
FROM v_resolved WHERE decl_id IS NOT NULL GROUP BY doc_id
""")
def collect_uses(spark, sf_dir):
    words = words_of(spark, sf_dir)
    found = sy.resolve_timeline(word_timeline(words), ["doc_id"], bounded=True)
    return sy.collect_uses(found, ["doc_id"]).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max("pos").alias("last_pos")
    )


@query("""
SELECT l_partkey AS name, min(decl_id) AS decl_id, count(*) AS n_uses,
       count(*) FILTER (WHERE l_orderkey <> decl_id) AS n_elsewhere
FROM lineitem JOIN (
  SELECT l_partkey AS k, arg_min(o_orderkey, (epoch_us(o_orderdate), o_orderkey)) AS decl_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON k = l_partkey
GROUP BY l_partkey
""")
def resolve_by_name(spark, sf_dir):
    lines = v.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), "l_orderkey")
    orders = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    decls = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = sy.resolve_by_name(lines, decls, ["name"], ["o_orderdate"], "o_orderkey")
    return found.groupBy("name").agg(
        F.min("decl_id").alias("decl_id"), F.count("*").alias("n_uses"),
        F.count_if(F.col("l_orderkey") != F.col("decl_id")).alias("n_elsewhere"),
    )


@query(f"""
WITH {v.ACCESS_SQL}
SELECT seq, entity, ctx, op FROM v_access a WHERE op IN ('read', 'write') AND NOT EXISTS (
  SELECT 1 FROM v_access c WHERE c.entity = a.entity AND c.ctx = a.ctx
  AND c.op IN ('acquire', 'release'))
""")
def drop_callee_symbols(spark, sf_dir):
    rows = v.access_view(v.table(spark, sf_dir, "events")).select("seq", "entity", "ctx", "op")
    calls = rows.filter(F.col("op").isin("acquire", "release"))
    uses = rows.filter(F.col("op").isin("read", "write"))
    return sy.drop_callee_symbols(uses, calls, ["entity", "ctx"])


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('signup', 'error')")
def drop_symbol_kinds(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sy.drop_symbol_kinds(events, "event_type", ["signup", "error"])


@query("""
SELECT p_brand, count(DISTINCT p_partkey) AS n_objects, bool_or(p_size > 45) AS is_pointer,
       count(DISTINCT CASE WHEN l_orderkey IS NOT NULL THEN (l_orderkey, l_linenumber) END) AS n_uses
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand
""")
def merge_objects(spark, sf_dir):
    parts = v.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), "p_brand", (F.col("p_size") > 45).alias("is_pointer")
    )
    uses = v.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return sy.merge_objects(parts, uses, "l_partkey", "p_brand", ["l_orderkey", "l_linenumber"])


@query("""
SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def prefer(spark, sf_dir):
    labels = v.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rule = v.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("quality")
    )
    return sy.prefer(labels, rule, ["doc_id"], "quality")


@query(f"""
WITH {v.ACCESS_SQL}
SELECT entity, bool_or(is_atomic OR type_kind = 'Map') AS is_pointer FROM v_access GROUP BY entity
""")
def pointer_flag(spark, sf_dir):
    rows = v.access_view(v.table(spark, sf_dir, "events"))
    type_kind = F.when(F.col("type_kind") == "Map", "map")
    return sy.pointer_flag(rows, ["entity"], type_kind, F.col("is_atomic"))


@query(f"""
WITH {v.TREE_SQL}
SELECT kind, kind IN ('region', 'nation') AS is_global, count(*) AS n FROM v_tree GROUP BY ALL
""")
def is_global(spark, sf_dir):
    flagged = sy.is_global(v.tree_view(spark, sf_dir), ["customer"], v.TREE_DEPTH, leaves=v.TREE_LEAVES)
    return flagged.groupBy("kind", "is_global").agg(F.count("*").alias("n"))


@query(f"""
WITH {v.WORDS_SQL},
n AS (SELECT * FROM v_words WHERE NOT ends_with(word, ',')),
f AS (SELECT doc_id, line, word, pos,
             min(pos) OVER (PARTITION BY doc_id, line, word) AS in_line,
             min(pos) OVER (PARTITION BY doc_id, word) AS in_doc FROM n),
r AS (SELECT doc_id, word, pos, CASE WHEN in_line < pos THEN in_line
        WHEN in_doc < pos THEN in_doc END AS above,
        in_line = pos OR in_doc = pos AS declares FROM f),
i AS (SELECT doc_id, word, pos, max(decl_id) AS decl_id FROM (
        SELECT doc_id, word, pos, above AS decl_id FROM r WHERE above IS NOT NULL
        UNION ALL SELECT doc_id, word, pos, pos FROM r WHERE declares) GROUP BY ALL),
u AS (SELECT doc_id, decl_id, count(DISTINCT CASE WHEN pos <> decl_id THEN pos END) AS n_uses
      FROM i GROUP BY ALL)
SELECT i.doc_id, i.pos, i.word AS name, i.decl_id, u.n_uses
FROM i JOIN u ON u.doc_id = i.doc_id AND u.decl_id = i.decl_id
""")
def symbol_at(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    words = v.words_in(lines)
    spans = stacked(
        words.select(
            "doc_id", F.lit("identifier").alias("kind"), F.col("pos").alias("start_pos"),
            F.col("pos").alias("end_pos"), F.lit(2).alias("depth"), F.lit(False).alias("is_root"),
        ),
        word_scopes(lines).select(
            "doc_id", "kind", "start_pos", (F.col("end_pos") + 1).alias("end_pos"), "depth",
            (F.col("depth") == 0).alias("is_root"),
        ),
    )
    # a word with a comma behind it stands for a called name
    calls = words.filter(F.col("word").endswith(",")).select("doc_id", F.col("pos").alias("at"))
    asked = words.select("doc_id", "pos")
    return symbols_at(asked, spans, word_timeline(words), calls, ["doc_id"], True)
