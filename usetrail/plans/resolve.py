"""From a position to its declaration and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usetrail.operators.structure import locate
from usetrail.operators.symbols import count_uses, drop_callee_symbols, resolve_timeline
from usetrail.plans import code_facts
from usetrail.session import gathered, in_place, staged


def symbol_at(
    points: DataFrame, spans: DataFrame, timeline: DataFrame, calls: DataFrame,
    on: list[str], bounded: bool = False,
) -> DataFrame:
    """Declaration and use count of the symbol under each point; no symbol, no row.

    points(on.., pos), spans(on.., kind, start_pos, end_pos, depth, is_root),
    timeline as in `resolve_timeline`, calls(on.., at) the places of called names. With
    `bounded` identifiers are single places (the words of one text): nothing is smaller, so
    a point is on the identifier that stands there, and the result is written at once.
    """
    if bounded:
        with in_place(points.sparkSession):
            return staged(_words_at(points, spans, timeline, calls, on), "symbols")
    hit = locate(points, spans, on).filter("kind = 'identifier'")
    inner = resolve_timeline(drop_callee_symbols(timeline, calls, [*on, "at"]), on, own=True).drop("depth")
    return _answers(hit, inner.join(count_uses(inner, on), [*on, "decl_id"]), on)


def _words_at(points: DataFrame, spans: DataFrame, timeline: DataFrame, calls: DataFrame, on: list[str]) -> DataFrame:
    """`symbol_at` on the words of texts that are all spread by document: no step moves a word."""
    names = spans.filter("kind = 'identifier'").select(*on, F.col("start_pos").alias("pos"), "start_pos")
    hit = points.join(names, [*on, "pos"])
    plain = drop_callee_symbols(timeline, calls, [*on, "at"])
    inner = resolve_timeline(plain, on, True, own=True).drop("depth")
    # uses lie in one document: count them in place instead of joining them back
    each = Window.partitionBy(*on, "decl_id")
    counted = inner.withColumn("n_uses", F.count_if(F.col("pos") != F.col("decl_id")).over(each))
    return _answers(hit, counted, on)


def _answers(hit: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    at = hit.select(*on, F.col("pos").alias("asked"), F.col("start_pos").alias("pos"))
    return at.join(counted, [*on, "pos"]).select(
        *on, F.col("asked").alias("pos"), "name", "decl_id", "n_uses"
    )


def code_symbol_at(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declaration and use count of the variable or field under each point of a syntax-node table.

    points(doc_id, pos). The smallest node around a point decides; on anything but a name, or
    on a name without a declaration, there is no row. Variables resolve by scope, fields by
    their name alone.
    """
    doc = ["doc_id"]
    spans = nodes.select(
        *doc, "kind", "start_pos", (F.col("end_pos") - 1).alias("end_pos"), "depth", F.col("parent_id").isNull().alias("is_root")
    )
    hit = locate(points, spans, doc, bounded=True).filter(F.col("kind").isin("identifier", "field_identifier"))
    found, decls = names = code_facts.names_of(nodes)
    uses = staged(code_facts.code_accesses(nodes, names).select(*doc, "pos", "name", "entity"), "uses", "doc_id")
    own = [
        made.select(*doc, F.col("decl_id").alias("pos"), "name", F.col("decl_id").alias("entity"))
        for made in (decls, code_facts.field_declarations(found, nodes))
    ]
    counts = uses.groupBy(*doc, "entity").agg(F.countDistinct("pos").alias("n_uses"))
    symbols = gathered([uses, *own], "symbols", "doc_id").join(counts, [*doc, "entity"], "left").select(
        *doc, F.col("pos").alias("start_pos"), "name", F.col("entity").alias("decl_id"),
        F.coalesce("n_uses", F.lit(0)).alias("n_uses"),
    )
    at = hit.select(*doc, "pos", "start_pos")
    return at.join(symbols, [*doc, "start_pos"]).select(*doc, "pos", "name", "decl_id", "n_uses")
