"""Intervals and trees: spans, parents, ancestors, lookups by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from usetrail.functions import fixed
from usetrail.functions.columns import holds_range
from usetrail.plans.intervals import best_containing, containing_spans, first_containing
from usetrail.plans.scan import clamped_sum, following, latest, numbered, running, total
from usetrail.session import staged


def line_col_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its 0-based line and place in the line."""
    from usetrail.sources.views import word_view

    return word_view(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))


def _unstray(tokens: DataFrame, doc: str, bounded: bool) -> DataFrame:
    """Nesting level of every token among its own kind; closes without open drop out."""
    step = tokens.withColumn("_d", F.when(F.col("is_open"), 1).otherwise(-1).cast("long"))
    deep = clamped_sum(
        step, [doc, "tag"], ["pos"], "_d", "_after", "_prior", bounded
    )
    level = F.when(F.col("is_open"), F.col("_after")).otherwise(F.col("_after") + 1)
    stray = ~F.col("is_open") & (F.col("_prior") == 0)
    return deep.filter(~stray).withColumn("_level", level).drop("_d", "_after", "_prior")


def pair_spans(tokens: DataFrame, doc: str = "page_id", bounded: bool = True) -> DataFrame:
    """Spans from open and close tokens, nested per kind; unclosed ones end in NULL.

    Once stray closes are gone, opens and closes of one level alternate, so an open is
    closed by the token that follows it on its level. `bounded`: the tokens of a
    document come out of one stored text (as in `running`); pass False for token tables.
    """
    levelled = _unstray(tokens, doc, bounded)
    paired = running(
        levelled, [doc, "tag", "_level"], ["pos"], bounded, _next=following(F.col("pos"))
    )
    return paired.filter("is_open").select(
        doc, F.col("tag").alias("kind"), F.col("pos").alias("start_pos"),
        F.col("_next").alias("end_pos"),
    )


def nesting(tokens: DataFrame, doc: str = "page_id", bounded: bool = True) -> DataFrame:
    """Depth of every open token among all kinds (1 = outermost), and whether it is closed.

    Only tokens that have their counterpart nest: unclosed opens are leaves where they
    stand, stray closes count for nothing.
    """
    spans = pair_spans(tokens, doc, bounded)
    closed = F.col("end_pos").isNotNull()
    sides = F.array(
        F.struct(F.col("start_pos").alias("pos"), F.lit(True).alias("is_open"), closed.cast("long").alias("_d")),
        F.struct(F.col("end_pos").alias("pos"), F.lit(False).alias("is_open"), F.lit(-1).cast("long").alias("_d")),
    )
    steps = spans.select(doc, F.col("kind").alias("tag"), F.explode(sides).alias("_s")).select(
        doc, "tag", "_s.*"
    ).filter("pos IS NOT NULL")
    deep = running(steps, [doc], ["pos"], bounded, _sum=total(F.col("_d")))
    return deep.filter("is_open").select(
        doc, "pos", "tag", "is_open", (F.col("_sum") + 1 - F.col("_d")).alias("depth"),
        (F.col("_d") == 1).alias("closed"),
    )


def parents(opens: DataFrame, doc: str = "page_id", bounded: bool = True) -> DataFrame:
    """Parent of every node in a pre-order list with depths.

    The parent is the latest earlier node one level up. Every node is entered twice,
    as candidate on its own level and as question on the level above; the answer is
    then one as-of scan per (document, level). Where the list says which nodes are
    `closed`, the others hold nothing.
    """
    holds = F.col("_cand") & F.col("closed") if "closed" in opens.columns else F.col("_cand")
    sides = F.array(
        F.struct(F.col("depth").alias("_level"), F.lit(True).alias("_cand")),
        F.struct((F.col("depth") - 1).alias("_level"), F.lit(False).alias("_cand")),
    )
    rows = opens.withColumn("_side", F.explode(sides)).select(
        *opens.columns, "_side._level", "_side._cand"
    )
    found = running(
        rows, [doc, "_level"], ["pos"], bounded,
        _parent=latest(F.when(holds, F.struct("pos", "tag"))),
    )
    return found.filter(~F.col("_cand")).select(
        *opens.columns,
        F.col("_parent.pos").alias("parent_pos"), F.col("_parent.tag").alias("parent_tag"),
    )


def _whole_paths(above: DataFrame, tree: list[str], names: list[str]) -> DataFrame:
    """Paths of inner nodes to their roots, whatever the depth: every round doubles what is known.

    A path that ends at a node takes over that node's path, so a chain of n takes log2(n)
    joins. Rounds are written, as the next one reads them twice.
    """
    paths = above.select(*names, "_id", "_up", F.array("_node").alias("_path"))
    while True:
        paths = staged(paths, "paths")
        round_trip = F.exists("_path", lambda node: node["id"] == F.col("_up"))
        circle = paths.filter("_up IS NOT NULL").agg(F.bool_or(round_trip)).first()[0]
        if circle is None:  # every path has reached its root
            return paths
        if circle:
            raise ValueError("parents form a circle")
        further = paths.select(*[F.col(c).alias(f"{c}_above") for c in (*names, "_id", "_up", "_path")])
        cond = F.col("_up") == F.col("_id_above")
        for t in names:
            cond = cond & (F.col(t) == F.col(f"{t}_above"))
        grown = F.when(F.col("_path_above").isNotNull(), F.concat("_path", "_path_above")).otherwise(F.col("_path"))
        paths = paths.join(further, cond, "left").select(*names, "_id", F.col("_up_above").alias("_up"), grown.alias("_path"))


def with_path(
    nodes: DataFrame, max_depth: int | None = None, extra: list[str] | None = None,
    start: Column | None = None, tree: list[str] | None = None,
    leaves: list[str] | None = None,
) -> DataFrame:
    """Add `path`, the ancestors of each node, nearest first.

    Paths of the nodes that can be parents are built first, one join per step up; then
    every node takes its parent's path in one join. `leaves` names kinds that never are a
    parent: the largest level is then shuffled once and never climbs. `start` limits the
    rows that get a path, e.g. to one kind. `max_depth` is the number of steps the tree can
    have; a deeper tree stops the job instead of being cut. Without it the tree may have any
    depth, and paths are doubled until they reach the roots. `tree` names key columns that
    id and parent share (e.g. the document).
    """
    tree = tree or []
    shown = ["kind", *(extra or [])]
    inner = nodes.filter(~F.col("kind").isin(leaves)) if leaves else nodes
    above = inner.select(
        *[F.col(t).alias(f"_t_{t}") for t in tree], F.col("node_id").alias("_id"),
        F.col("parent_id").alias("_up"), F.struct(F.col("node_id").alias("id"), *shown).alias("_node"),
    )
    path_type = _path_type(nodes, shown)
    if max_depth is None:
        paths = _whole_paths(above, tree, [f"_t_{t}" for t in tree])
    else:
        paths = above.withColumn("_path", F.array("_node").cast(path_type))
    for _ in range((max_depth or 1) - 1):
        step = above.withColumnsRenamed({c: f"{c}_above" for c in above.columns})
        cond = _parent_key(nodes, "_up", "_id") == F.col("_id_above")
        for t in tree:
            cond = cond & (F.col(f"_t_{t}") == F.col(f"_t_{t}_above"))
        grown = F.when(F.col("_node_above").isNotNull(), F.concat("_path", F.array("_node_above"))).otherwise(F.col("_path"))
        paths = paths.join(step, cond, "left").select(
            *[f"_t_{t}" for t in tree], "_id", F.col("_up_above").alias("_up"), grown.alias("_path")
        )
    # names the row, so that it is evaluated for joined rows only
    too_deep = F.raise_error(
        F.concat(F.lit("tree is deeper than max_depth above "), F.col("node_id").cast("string"))
    ).cast(path_type)
    rows = nodes.filter(start) if start is not None else nodes
    cond = _parent_key(nodes, "parent_id", "node_id") == F.col("_id")
    for t in tree:
        cond = cond & (F.col(t) == F.col(f"_t_{t}"))
    path = F.when(F.col("_up").isNotNull(), too_deep).otherwise(F.col("_path"))
    return rows.join(paths, cond, "left").select(
        *nodes.columns, F.coalesce(path, F.array().cast(path_type)).alias("path")
    )


def _parent_key(nodes: DataFrame, parent: str, own: str) -> Column:
    """Parent id for a join; rows without one get a key of their own, or all would meet in one task."""
    if not isinstance(nodes.schema["node_id"].dataType, StringType):
        return F.col(parent)
    return F.coalesce(F.col(parent), F.concat(F.lit("~"), F.col(own)))


def _path_type(nodes: DataFrame, shown: list[str]) -> str:
    fields = [f"id:{nodes.schema['node_id'].dataType.simpleString()}"]
    fields += [f"{c}:{nodes.schema[c].dataType.simpleString()}" for c in shown]
    return f"array<struct<{','.join(fields)}>>"


def ancestors(
    nodes: DataFrame, max_depth: int | None = None, tree: list[str] | None = None,
    leaves: list[str] | None = None,
) -> DataFrame:
    """Every (node, ancestor, distance)."""
    up = with_path(nodes, max_depth, tree=tree, leaves=leaves).select(
        *(tree or []), "node_id", F.posexplode("path").alias("_i", "_a")
    )
    return up.select(
        *(tree or []), "node_id", F.col("_a.id").alias("ancestor"),
        F.col("_a.kind").alias("ancestor_kind"), (F.col("_i") + 1).alias("distance"),
    )


def _before_stop(path: Column, stop: list[str]) -> Column:
    """The part of a path below its first stop kind; the whole path without one."""
    if not stop:
        return path
    kinds = F.transform(path, lambda a: a["kind"].isin(stop))
    at = F.array_position(kinds, True)
    return F.when(at > 0, F.slice(path, F.lit(1), (at - 1).cast("int"))).otherwise(path)


def nearest_ancestor(
    nodes: DataFrame, kinds: list[str], max_depth: int | None, stop: list[str] | None = None,
    start: Column | None = None, tree: list[str] | None = None, into: str = "nearest",
    leaves: list[str] | None = None,
) -> DataFrame:
    """Nearest ancestor of one of `kinds`, not looking past a stop kind."""
    climbed = with_path(nodes, max_depth, start=start, tree=tree, leaves=leaves)
    usable = _before_stop(F.col("path"), stop or [])
    hits = F.filter(usable, lambda a: a["kind"].isin(kinds))
    return climbed.select(*nodes.columns, F.get(hits, F.lit(0))["id"].alias(into))


def outermost_enclosing(
    points: DataFrame, spans: DataFrame, kinds: list[str], on: list[str], bounded: bool = False
) -> DataFrame:
    """First span in pre-order, of the given kinds, that holds each point."""
    wanted = spans.filter(F.col("kind").isin(kinds)).select(*on, "start_pos", "end_pos", "kind")
    found = first_containing(points, wanted, on, "_s", bounded=bounded)
    return found.select(*points.columns, "_s.start_pos", "_s.end_pos", "_s.kind")


def locate(
    points: DataFrame, spans: DataFrame, on: list[str], size: Column | None = None,
    bin_width: int = 8, bounded: bool = False,
) -> DataFrame:
    """Smallest span holding each point, both ends inclusive.

    Punctuation and comments are never chosen unless they are a root (`is_root`). Of
    equal sizes the one that comes first in pre-order wins: the one further left, then the
    outer. `size` need not grow with the span (as `span_size` does not). `bin_width`: by
    what factor the widths of the cells grow that spans are cut into. `bounded`: a group comes
    out of one stored row (as in `running`).
    """
    named = spans.filter(~F.col("kind").isin(fixed.PUNCTUATION_KINDS) | F.col("is_root"))
    length = size if size is not None else F.col("end_pos") - F.col("start_pos")
    best = F.struct(length.alias("size"), "start_pos", "depth", "end_pos", "kind")
    found = best_containing(points, named, on, best, into="_s", growth=bin_width, bounded=bounded)
    return found.select(
        *points.columns, "_s.kind", "_s.start_pos", "_s.end_pos", "_s.depth", "_s.size"
    )


def contained(inner: DataFrame, outer: DataFrame, on: list[str], bounded: bool = False) -> DataFrame:
    """Pairs where an outer span holds an inner span, ends inclusive."""
    far = outer.select(
        *on, F.col("kind").alias("outer_kind"), F.col("start_pos").alias("outer_start"),
        F.col("end_pos").alias("outer_end"),
    )
    pairs = containing_spans(
        inner, far, on, point="start_pos", start="outer_start", end="outer_end", bounded=bounded
    )
    return pairs.filter(
        holds_range(F.col("outer_start"), F.col("outer_end"), F.col("start_pos"), F.col("end_pos"))
    )


def has_descendant(
    nodes: DataFrame, pred: Column, max_depth: int | None, kind: str, tree: list[str] | None = None,
    leaves: list[str] | None = None,
) -> DataFrame:
    """Nodes of a kind with at least one descendant that matches."""
    hit = with_path(nodes, max_depth, start=pred, tree=tree, leaves=leaves).select(
        *(tree or []), F.explode("path").alias("_a")
    )
    return (
        hit.filter(F.col("_a.kind") == kind)
        .select(*(tree or []), F.col("_a.id").alias("node_id"))
        .distinct()
    )


def first_descendant(
    nodes: DataFrame, pred: Column, max_depth: int | None, kind: str, order: str = "ordinal",
    tree: list[str] | None = None, leaves: list[str] | None = None,
) -> DataFrame:
    """First matching descendant of each node of a kind, in the order given."""
    hit = with_path(nodes, max_depth, start=pred, tree=tree, leaves=leaves).select(
        *(tree or []), F.explode("path").alias("_a"), F.struct(order, "node_id").alias("_d")
    )
    first = hit.filter(F.col("_a.kind") == kind).groupBy(
        *(tree or []), F.col("_a.id").alias("node_id")
    ).agg(F.min("_d").alias("_d"))
    return first.select(*(tree or []), "node_id", F.col("_d.node_id").alias("first_id"))


def under(
    nodes: DataFrame, carrier, blocker, max_depth: int | None, stop: list[str] | None = None,
    extra: list[str] | None = None, start: Column | None = None, tree: list[str] | None = None,
    into: str = "hit", leaves: list[str] | None = None,
) -> DataFrame:
    """True where some ancestor is a carrier and none below the first stop is a blocker.

    `carrier` and `blocker` take an ancestor struct and return a condition.
    """
    climbed = with_path(nodes, max_depth, extra=extra, start=start, tree=tree, leaves=leaves)
    carried = F.exists("path", carrier)
    blocked = F.exists(_before_stop(F.col("path"), stop or []), blocker)
    return climbed.select(*nodes.columns, (carried & ~blocked).alias(into))


def zip_ordinal(
    left: DataFrame, right: DataFrame, on: list[str], left_value: str, right_value: str,
    whole: DataFrame | None = None,
) -> DataFrame:
    """Pair the i-th left item with the i-th right item, else with right[0].

    Where a group has no right list at all, the value in `whole` (one row per group)
    stands in.
    """
    l = left.select(*on, "ordinal", F.col(left_value).alias("left_value"))
    r = right.select(*on, "ordinal", F.col(right_value).alias("_same"))
    head = right.filter(F.col("ordinal") == 0).select(*on, F.col(right_value).alias("_first"))
    out = l.join(r, [*on, "ordinal"], "left").join(head, on, "left")
    value = F.coalesce("_same", "_first")
    if whole is not None:
        out = out.join(whole.select(*on, F.col(right_value).alias("_whole")), on, "left")
        value = F.coalesce("_same", "_first", "_whole")
    return out.select(*on, "ordinal", "left_value", value.alias("right_value"))


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based place of each item in its list."""
    return numbered(df, keys, order, "_rn").select(
        *df.columns, (F.col("_rn") - 1).alias(name)
    )


def classify_context(nodes: DataFrame) -> DataFrame:
    """Class of each node from its kind, parent kind and field.

    Reads kind, parent_kind, field, grand_kind, parent_field; adds context_type and
    parent_context. The rules are a fixed list, so they become one CASE expression.
    """
    return nodes.withColumn(
        "context_type", _context(F.col("kind"), F.col("parent_kind"), F.col("field"))
    ).withColumn(
        "parent_context",
        F.when(
            F.col("parent_kind").isNotNull(),
            _context(F.col("parent_kind"), F.col("grand_kind"), F.col("parent_field")),
        ),
    )


def _context(kind: Column, parent: Column, field: Column) -> Column:
    cases = F.when((kind == "identifier") & parent.isNull(), "Unknown")
    for own, above, slot, name in fixed.CLASS_BY_PARENT:
        test = (kind == own) & (parent == above)
        cases = cases.when(test & (field == slot) if slot else test, name)
    for own, name in fixed.CLASS_BY_KIND:
        cases = cases.when(kind == own, name)
    return cases.otherwise("Unknown")


def context_details(kind: Column, line: Column, col: Column) -> Column:
    return F.format_string("Node: %s at %d:%d", kind, line, col)
