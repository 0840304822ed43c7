"""One query per corpus operator over the whole of its table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usetrail.llm import (
    chat, decontaminate, extract, minhash, packing, quality, repair, scoring, secrets, sharding, spelling,
    substring, suffix,
)
from usetrail.llm.common import table
from usetrail.session import scratch_dir


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text"
        " FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    conversations = chat.assembled(given.unionByName(added))
    shown = chat.read_back(chat.prefix_trees(conversations))
    return conversations.select("conv_id", "digest").join(shown, "digest").select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", quality.judged(docs, model).alias("v")).select(
        "doc_id", "v.n_words", "v.word_chars", "v.n_symbols", "v.n_dup_lines", "v.n_repeat_words",
        "v.base_failed", "v.kept", "v.probability", "v.toxicity",
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.cleaned(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return done.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.cleaned(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return done.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("c.runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return docs.select("doc_id", found.alias("c")).select(
        "doc_id", "c.n_words", hit.alias("n_hit"), F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"),
        (F.size("c.runs") > 0).alias("contaminated"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = sharding.write_shards(
        sharding.external_shuffle(docs, shards=40), scratch_dir(spark, "shards") + "/table"
    )
    text = F.coalesce("record.text", F.lit(""))
    return written.select(
        "record.doc_id", (F.octet_length(text) + sharding.OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.perplexities(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repair.repaired(repair.damaged(given), given)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_sharding": op10_sharding,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

#: The assignment pattern with either case spelt out, quotes doubled for SQL.
_ASSIGN = (
    "(" + "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
        for word in ("password", "passwd", "secret", "token", "api_?key")
    ) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_PATTERNS = [
    ("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("endpoint", secrets.ENDPOINT, 0, 0), ("identifier", secrets.IDENTIFIER, 0, 0), ("opaque", secrets.OPAQUE, 0, 0),
]


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one pattern: gaps and matches alternate, so running lengths give the places."""
    return f"""
    SELECT r, {rank} AS rank, '{kind}' AS kind, pos - n AS s, pos AS e, found FROM (
      SELECT r, found, val, length(found) AS n,
             sum(gap + length(found)) OVER (PARTITION BY r ORDER BY i) AS pos
      FROM (SELECT r, unnest(found) AS found, unnest(val) AS val, unnest(gaps[:len(found)]) AS gap,
                   unnest(range(len(found))) AS i
            FROM (SELECT r, regexp_extract_all(body, '{pattern}') AS found,
                         regexp_extract_all(body, '{pattern}', {group}) AS val,
                         list_transform(string_split_regex(body, '{pattern}'), lambda x: length(x)) AS gaps
                  FROM texts)))
    WHERE length(val) >= {least}"""


_SECRET_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
found AS ({' UNION ALL '.join(_found(i, *p) for i, p in enumerate(_PATTERNS))}),
base AS (SELECT * FROM found WHERE rank < 3),
weak AS (
  SELECT * FROM found w WHERE rank >= 3
    AND (rank <> 4 OR (regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[0-9]')))
    AND (rank <> 5 OR (regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]') AND regexp_matches(found, '[0-9]')))
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
near AS (
  SELECT w.r, w.rank, w.s,
         coalesce(bool_or(p.rank IN (1, 4)), false) AS names, coalesce(bool_or(p.rank IN (0, 2, 5)), false) AS secrets,
         coalesce(bool_or(p.rank = 3), false) AS places
  FROM weak w JOIN parts p ON p.r = w.r AND (p.rank <> w.rank OR p.s <> w.s)
   AND p.s <= w.e + {secrets.SCOPE} AND p.e >= w.s - {secrets.SCOPE}
  GROUP BY ALL),
kept AS (
  SELECT r, rank, kind, s, e FROM base UNION ALL
  SELECT w.r, w.rank, w.kind, w.s, w.e FROM weak w JOIN near n ON n.r = w.r AND n.rank = w.rank AND n.s = w.s
  WHERE CASE w.rank WHEN 3 THEN names AND secrets WHEN 4 THEN secrets ELSE names OR places END)
SELECT t.doc_id, count(*) FILTER (k.rank = 0) AS n_assign, count(*) FILTER (k.rank = 1) AS n_access,
       count(*) FILTER (k.rank = 2) AS n_hex,
       sha256(coalesce(string_agg(concat(k.kind, ':', k.s::BIGINT, ':', k.e::BIGINT), ',' ORDER BY k.s, k.rank)
              FILTER (k.rank < 3), '')) AS base_sha256,
       coalesce(string_agg(concat(k.kind, ':', k.s::BIGINT, ':', k.e::BIGINT), ',' ORDER BY k.s, k.rank)
              FILTER (k.rank IS NOT NULL), '') AS spans
FROM texts t LEFT JOIN kept k ON k.r = t.r GROUP BY t.r, t.doc_id"""

_WORD9 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CONTAMINATION_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD9}') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD9}') AS w
  FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM patterns),
windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT w.r, w.n, w.i, p.item_id FROM windows w JOIN patterns p ON p.n = w.n AND p.p = w.p),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.r = d.r LEFT JOIN items ON items.r = d.r"""

_NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, hash(array_to_string(w[i:i + least(3, len(w)) - 1], ' ')) AS g
  FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.r = d.r JOIN c ON c.r = d.r"""

_CONTROL = chat.CONTROL
_CHAT_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
shown AS (
  SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g')) AS n_text,
         length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '{_CONTROL}', '\1\\\2\3', 'g')) AS n_role
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.TURN) + 1 + len(chat.TURN_END)} + n_role + n_text)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id"""

_REPEATS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, md5_number(array_to_string(w[i:i + 19], ' ')) AS h
      FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT r, i, (doc_id, i) <> min((doc_id, i)) OVER (PARTITION BY h) AS again FROM s),
g AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS x FROM f WHERE again),
k AS (SELECT r, count(*) AS n_removed, list(x) AS gone FROM g GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN k.gone IS NULL THEN d.w ELSE
              list_transform(list_filter(range(1, len(d.w) + 1), lambda x: NOT list_contains(k.gone, x)), lambda x: d.w[x]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r"""

CHECKS = {
    "op7_substring_dedup": _REPEATS_SQL,
    "op1_minhash_near_dedup": _NEAR_SQL,
    "op2_chat_formatting": _CHAT_SQL,
    "op8_secret_scans": _SECRET_SQL,
    "op9_benchmark_decontamination": _CONTAMINATION_SQL,
}
