"""Secret scans in SQL functions only: base patterns, and linked parts of credentials.

Base spans are reported as they stand. Parts that prove nothing alone (an upper-case
identifier, a long mixed token, an endpoint) are weak candidates: they are reported only if
parts that complete them lie within `scope` code points of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usetrail.llm.common import fresh, named, text_of

#: Patterns by kind; a span's kind is its place in this list.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"[A-Z0-9]{16,32}"
OPAQUE = r"[A-Za-z0-9+/]{32,}"
#: A scheme has at most 32 characters, so a long run of letters is not read again from every letter of it.
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{0,31}://[A-Za-z0-9._~:/?@%&=+-]+"
KINDS = ["assign", "access", "hex", "endpoint", "identifier", "opaque"]
BASE_KINDS = 3
SCOPE = 200


#: Matches whose lengths are added up at a time.
ADDED_UP = 128


def _let(value: Column, use) -> Column:
    """Bind a value, so that it is computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums_before(lengths: Column) -> Column:
    """What comes before each element of an array of numbers, added up in blocks and then over blocks."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda n, x: n + x)

    def sums(part: Column) -> Column:
        return F.transform(part, lambda _, i: total(F.slice(part, F.lit(1), i)))

    last = F.greatest(F.ceil(F.size(lengths) / ADDED_UP).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(lengths, k * ADDED_UP + 1, F.lit(ADDED_UP)))
    return _let(blocks, lambda b: _let(F.transform(b, total), lambda t: F.flatten(
        F.zip_with(b, sums(t), lambda part, first: F.transform(sums(part), lambda x: x + first))
    )))


def _spans(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, kind, found>> of a pattern's matches, in code points.

    split() gives what lies between the matches, so running lengths give the places.
    Matches whose group `value` is shorter than `least` are dropped after matching.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sized = F.filter(
        F.zip_with(
            F.arrays_zip(found.alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("value")),
            gaps,
            lambda m, gap: F.struct(
                m["found"].alias("found"), F.length(m["value"]).alias("size"), gap.alias("gap"), F.length(m["found"]).alias("n")
            ),
        ),
        lambda m: m["found"].isNotNull(),
    )

    def place(m: Column, first: Column) -> Column:
        start = first + m["gap"]
        return F.struct(
            start.alias("start"), (start + m["n"]).alias("end"), F.lit(kind).alias("kind"), m["found"].alias("found"),
            m["size"].alias("size"),
        )

    placed = _let(sized, lambda all_: F.filter(
        F.zip_with(all_, _sums_before(F.transform(all_, lambda m: m["gap"] + m["n"])), place), lambda m: m["size"] >= least
    ))
    empty = F.array().cast("array<struct<start: int, end: int, kind: int, found: string, size: int>>")
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def _has(pattern: str):
    return lambda span: span["found"].rlike(pattern)


def scan(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc key (as `key`), text_hash, base and spans: arrays of (start, kind, end) in order.

    One row per input row. `base` holds the base spans, `spans` all of them. Weak
    candidates are held against base spans and complementary parts by running extremes over
    the spans of a document in order and in reverse order, so a text with very many spans makes
    no pairs. Only spans are shuffled, never texts. Null and empty texts have no spans; null keys stay rows; equal
    rows are combined before the shuffle and come back as often as they were.
    """
    body = text_of(docs, text)
    texts = docs.select(named(docs, key).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    body = F.col("body")
    kinds = texts.select(
        "key", "text_hash",
        _spans(body, ASSIGN, 0, value=1, least=6).alias("k0"),
        _spans(body, ACCESS, 1).alias("k1"),
        _spans(body, HEX, 2).alias("k2"),
        _spans(body, ENDPOINT, 3).alias("k3"),
        F.filter(_spans(body, IDENTIFIER, 4), lambda s: _has("[A-Z]")(s) & _has("[0-9]")(s)).alias("k4"),
        F.filter(_spans(body, OPAQUE, 5), lambda s: _has("[A-Z]")(s) & _has("[a-z]")(s) & _has("[0-9]")(s)).alias("k5"),
    )
    whole = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(-1).alias("kind"))
    listed = kinds.select(
        "key", "text_hash",
        F.explode(
            F.concat(
                F.array(whole),
                F.transform(
                    F.concat("k0", "k1", "k2", "k3", "k4", "k5"),
                    lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
                ),
            )
        ).alias("s"),
    )
    counted = listed.groupBy("key", "text_hash", "s").agg(F.count("*").alias("copies")).select(
        "key", "text_hash", "s.*", "copies"
    )
    by = Window.partitionBy("key", "text_hash")
    before = by.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def reach(part: Column) -> tuple[Column, Column]:
        """The furthest end of such spans that come before, the nearest start of those that come after."""
        return F.max(F.when(part, F.col("end"))).over(before), F.min(F.when(part, F.col("start"))).over(after)

    is_base = F.col("kind").between(0, BASE_KINDS - 1)
    last, first = reach(is_base)
    counted = counted.withColumns({"last_base": last, "next_base": first}).where(
        (F.col("kind") < BASE_KINDS)
        | ~(F.coalesce(F.col("last_base") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next_base") < F.col("end"), F.lit(False)))
    )

    def near(*kinds: int) -> Column:
        """A part of these kinds lies within the scope, before or after."""
        last, first = reach(F.col("kind").isin(*kinds))
        return F.coalesce(last >= F.col("start") - scope, F.lit(False)) | F.coalesce(
            first <= F.col("end") + scope, F.lit(False)
        )

    names, secrets = near(1, 4), near(0, 2, 5)
    kind = F.col("kind")
    linked = counted.withColumn(
        "reported",
        F.when(kind < BASE_KINDS, True)
        .when(kind == 3, names & secrets)
        .when(kind == 4, secrets)
        .otherwise(names | near(3)),
    )
    span = F.struct("start", "kind", "end")
    rows = linked.groupBy("key", "text_hash").agg(
        F.max(F.when(kind == -1, F.col("copies"))).alias("copies"),
        F.sort_array(F.collect_list(F.when((kind >= 0) & F.col("reported"), span))).alias("spans"),
    )
    return rows.select(
        F.col("key").alias(key), "text_hash",
        F.filter("spans", lambda s: s["kind"] < BASE_KINDS).alias("base"), "spans",
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")


def joined(spans: str | Column) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ","
    )


def masked(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span, runs of overlapping ones as one, replaced.

    Rows and columns stay as they are but for the text; null texts stay null.
    """
    hashed, cuts, scan_key, scan_hash = fresh(docs, "text_hash", "spans", "scan_key", "scan_hash")
    scanned = scan(docs, scope, key, text).groupBy(key, "text_hash").agg(F.first("spans").alias(cuts))
    scanned = scanned.where(F.size(cuts) > 0).withColumnsRenamed({key: scan_key, "text_hash": scan_hash})
    marked = docs.withColumn(hashed, F.xxhash64(text_of(docs, text)))
    hit = marked.join(
        scanned,
        marked[f"`{key}`"].eqNullSafe(scanned[scan_key]) & (marked[hashed] == scanned[scan_hash]),
        "left",
    )
    body = F.col(f"`{text}`")
    clean = F.aggregate(
        F.col(cuts),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    return hit.withColumn(text, F.when(F.col(cuts).isNotNull(), clean).otherwise(body)).select(
        *[f"`{c}`" for c in docs.columns]
    )
