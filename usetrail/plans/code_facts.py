"""From a syntax-node table to declarations, uses, accesses and findings.

nodes(doc_id, node_id, parent_id, field, kind, start_pos, end_pos, depth, text); `end_pos`
is exclusive. What surrounds a use is found by one interval join against the few node
kinds that matter and one aggregate, not by climbing the tree. Tables that several later
steps read are written to the shared folder once, which also keeps every plan short, and in
buckets by document: inside `session.in_place` no step shuffles the rows of a document.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions import fixed
from usetrail.functions.columns import (
    holds_range, is_atomic_name, is_heavy_call, is_mutex_method, lock_delta,
)
from usetrail.operators import classify, rules, symbols, sync
from usetrail.plans.intervals import containing_spans
from usetrail.session import gathered, staged

DOC = ["doc_id"]
#: Names are single words, so no node stands below one.
NAME_KINDS = ["identifier", "field_identifier"]
#: The nodes of a document come out of one text.
held_in = partial(containing_spans, bounded=True)


def with_parents(rows: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """Add kind, field, id and end of the next `levels` ancestors (p1_.., p2_..).

    Ancestors are put together first, so the rows, which are most, are joined once. The
    ancestors of a part of the documents are hashed, so the rows are not sorted for it.
    """
    def level(i: int) -> DataFrame:
        return nodes.select(
            F.col("doc_id").alias(f"_doc{i}"), F.col("node_id").alias(f"p{i}_id"), F.col("parent_id").alias(f"p{i}_up"),
            F.col("kind").alias(f"p{i}_kind"), F.col("field").alias(f"p{i}_field"), F.col("end_pos").alias(f"p{i}_end"),
        ).hint("shuffle_hash")

    above = level(1)
    for i in range(2, levels + 1):
        on = (F.col("_doc1") == F.col(f"_doc{i}")) & (F.col(f"p{i - 1}_up") == F.col(f"p{i}_id"))
        above = above.join(level(i), on, "left").drop(f"_doc{i}")
    on = (F.col("doc_id") == F.col("_doc1")) & (F.col("parent_id") == F.col("p1_id"))
    return rows.join(above.hint("shuffle_hash"), on, "left").drop("_doc1")


def call_sites(nodes: DataFrame) -> DataFrame:
    """Calls with callee text, receiver and simple name."""
    calls = nodes.filter("kind = 'call_expression'").select(
        "doc_id", "node_id", "start_pos", "end_pos", "depth"
    )
    function = nodes.filter("field = 'function'").select(
        "doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("fn_id"),
        F.col("kind").alias("fn_kind"), F.trim("text").alias("callee"),
    )
    parts = nodes.filter(F.col("field").isin("operand", "field")).groupBy(
        "doc_id", F.col("parent_id").alias("fn_id")
    ).agg(
        F.max(F.when(F.col("field") == "operand", F.trim("text"))).alias("receiver"),
        F.max(F.when(F.col("field") == "field", F.col("text"))).alias("method"),
    )
    named = calls.join(function, ["doc_id", "node_id"]).join(parts, ["doc_id", "fn_id"], "left")
    selected = F.col("fn_kind") == "selector_expression"
    plain = F.when(F.col("fn_kind") == "identifier", F.col("callee"))
    return named.withColumn("method", F.when(selected, F.col("method"))).withColumn(
        "is_sync_call",
        is_mutex_method(F.col("method")) | is_atomic_name(F.col("receiver"), F.col("method")),
    ).withColumn("simple_name", F.coalesce("method", plain))


def sync_names(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Names of functions whose body holds a mutex or atomic call."""
    bodies = nodes.filter("field = 'body'").select(
        "doc_id", F.col("parent_id").alias("fn_id"), F.col("start_pos").alias("b_start"),
        (F.col("end_pos") - 1).alias("b_end"),
    )
    sites = calls.filter("is_sync_call").select("doc_id", F.col("start_pos").alias("pos"))
    inside = held_in(sites, bodies, DOC, start="b_start", end="b_end")
    declared = nodes.filter(F.col("kind").isin("function_declaration", "method_declaration"))
    owners = inside.select("doc_id", "fn_id").distinct().join(
        declared.select("doc_id", F.col("node_id").alias("fn_id")), ["doc_id", "fn_id"]
    )
    names = nodes.filter("field = 'name'").select(
        "doc_id", F.col("parent_id").alias("fn_id"), F.col("text").alias("simple_name")
    )
    return owners.join(names, ["doc_id", "fn_id"]).select("doc_id", "simple_name").distinct()


def surroundings(points: DataFrame, nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """What encloses each point (doc_id, node_id, pos, end): contexts, calls, sections."""
    owners = nodes.filter(F.col("kind").isin(fixed.COPY_OWNER_KINDS)).select(
        "doc_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("owned")
    )
    kinds = [
        *fixed.FUNCTION_KINDS, *fixed.COPY_LIST_KINDS, *fixed.ADDRESS_STOP_KINDS,
        "go_statement", "block", "defer_statement", "unary_expression",
    ]
    facts = calls.select(
        "doc_id", "node_id", "is_sync_call", "in_sync_fn", "callee",
        is_atomic_name(F.col("receiver"), F.col("method")).alias("is_atomic_call"),
    )
    marks = (
        nodes.filter(F.col("kind").isin(kinds))
        .join(owners, ["doc_id", "parent_id"], "left")
        .join(facts, ["doc_id", "node_id"], "left")
        .select(
            "doc_id", F.col("node_id").alias("m_id"), F.col("kind").alias("m_kind"),
            F.col("depth").alias("m_depth"), F.col("start_pos").alias("m_start"),
            F.col("end_pos").alias("m_end"), F.coalesce("owned", F.lit(False)).alias("m_owned"),
            F.coalesce(F.col("is_sync_call") | F.col("in_sync_fn"), F.lit(False)).alias("m_sync"),
            F.coalesce("is_atomic_call", F.lit(False)).alias("m_atomic"),
            is_heavy_call(F.col("callee")).alias("m_heavy"),
            F.ltrim("text").startswith("&").alias("m_address"),
        )
    )
    pairs = held_in(points, marks, DOC, start="m_start", end="m_end").filter(
        holds_range(F.col("m_start"), F.col("m_end"), F.col("pos"), F.col("end"))
    )
    kind, depth = F.col("m_kind"), F.col("m_depth")

    def nearest(cond: Column) -> Column:
        return F.max_by("m_id", F.when(cond, depth))

    function = kind.isin(fixed.FUNCTION_KINDS)
    found = pairs.groupBy("doc_id", "node_id").agg(
        nearest(function).alias("ctx"),
        F.max_by("m_kind", F.when(function, depth)).alias("ctx_kind"),
        nearest(kind == "block").alias("block"),
        F.min_by("m_id", F.when(kind == "block", depth)).alias("outer_block"),
        F.bool_or(kind == "go_statement").alias("concurrent"),
        F.bool_or(kind == "defer_statement").alias("deferred"),
        F.bool_or("m_sync").alias("in_sync_call"),
        F.bool_or("m_atomic").alias("is_atomic"),
        F.bool_or("m_heavy").alias("heavy"),
        F.bool_or(F.col("m_owned") & kind.isin(fixed.COPY_LIST_KINDS)).alias("in_list"),
        F.max(F.when((kind == "unary_expression") & F.col("m_address"), depth)).alias("_address"),
        F.max(F.when(kind.isin(fixed.ADDRESS_STOP_KINDS), depth)).alias("_stop"),
    )
    addressed = F.col("_address") > F.coalesce(F.col("_stop"), F.lit(-1))
    out = points.join(found, ["doc_id", "node_id"], "left").withColumn(
        "copied", F.coalesce("in_list", F.lit(False)) & ~F.coalesce(addressed, F.lit(False))
    )
    flags = ("concurrent", "deferred", "in_sync_call", "is_atomic", "heavy")
    for name in flags:
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("in_list", "_address", "_stop")


def occurrences(nodes: DataFrame) -> DataFrame:
    """Identifiers with what they are: declaration (kind), field, target side, token."""
    is_name = F.col("kind").isin(NAME_KINDS)
    names = nodes.filter(is_name)
    # whether a range clause declares: its first sign of assignment among its own children
    signs = nodes.filter(F.col("kind").isin(":=", "=")).groupBy("doc_id", F.col("parent_id").alias("signed")).agg(
        F.min_by("kind", "ordinal").alias("sign"))
    up = with_parents(names, nodes.filter(~is_name), 3)
    is_field = (F.col("kind") == "field_identifier") & (F.col("field") == "field")
    listed = F.col("p1_kind") == "expression_list"
    by_list = listed & (F.col("p1_field") == "left") & F.col("p2_kind").isin(
        "short_var_declaration", "range_clause")
    direct = F.col("p1_kind").isin("var_spec", "parameter_declaration") & (F.col("field") == "name")
    decl_kind = F.when(by_list, F.col("p2_kind")).when(direct, F.col("p1_kind")).when(
        (F.col("p1_kind") == "field_declaration") & (F.col("field") == "name"), "field_declaration")
    # a field is the target as `obj.field`, so its selector stands where a name would
    skip = is_field & (F.col("p1_kind") == "selector_expression")
    t_kind = F.when(skip, F.col("p2_kind")).otherwise(F.col("p1_kind"))
    in_list = t_kind == "expression_list"
    side = F.when(in_list, F.when(skip, F.col("p2_field")).otherwise(F.col("p1_field")))
    deep = lambda part: F.when(skip, F.col(f"p3_{part}")).otherwise(F.col(f"p2_{part}"))
    stmt_kind = F.when(in_list, deep("kind")).otherwise(t_kind)
    up = up.withColumn("signed", F.when(in_list, deep("id"))).join(signs.hint("shuffle_hash"), ["doc_id", "signed"], "left")
    token = F.when(stmt_kind == "short_var_declaration", ":=").otherwise(F.coalesce("sign", F.lit("=")))
    return up.select(
        "doc_id", "node_id", F.col("text").alias("name"), F.col("start_pos").alias("pos"),
        F.col("end_pos").alias("end"), decl_kind.alias("decl_kind"), skip.alias("is_field"),
        (skip & (F.col("p1_field") == "function")).alias("is_callee"),
        F.coalesce(F.when(by_list, F.col("p2_end")), F.when(direct, F.col("end_pos")),
                   F.col("end_pos")).alias("visible_from"),
        ((F.col("sign") == ":=") | (F.col("p2_kind") != "range_clause")).alias("declares"),
        classify.reassign_flag(stmt_kind, F.coalesce(side, F.lit("left")), token, F.lit(False),
                               F.lit(True)).alias("reassign"),
        F.when(by_list, F.col("p2_id")).otherwise(F.col("p1_id")).alias("stmt_id"),
    ).withColumn("is_callee", F.coalesce("is_callee", F.lit(False)))


def scopes_of(nodes: DataFrame) -> DataFrame:
    """Scopes of each document, the whole document first."""
    kept = F.col("kind").isin(fixed.SCOPE_KINDS) | F.col("parent_id").isNull()
    return nodes.filter(kept).select(
        "doc_id", F.col("node_id").alias("scope_id"), "depth", "start_pos",
        (F.col("end_pos") - 1).alias("end_pos"),
    )


def declarations(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared variables with scope, visibility and the pointer-like flag."""
    rows = found.filter(F.col("decl_kind").isin(fixed.DECL_KINDS))
    around = held_in(rows.select("doc_id", "node_id", "pos"), scopes_of(nodes), DOC)
    inner = around.groupBy("doc_id", "node_id").agg(F.max_by("scope_id", "depth").alias("scope_id"))
    placed = rows.join(inner, ["doc_id", "node_id"]).withColumn("kind", F.col("decl_kind"))
    kept = symbols.extract_decls(placed, ["doc_id", "scope_id"], bounded=True)
    marks = nodes.filter(
        F.col("kind").isin("pointer_type", *fixed.REFERENCE_KINDS)
        | ((F.col("kind") == "unary_expression") & F.ltrim("text").startswith("&"))
    ).select("doc_id", F.col("start_pos").alias("pos"))
    statements = nodes.select(
        "doc_id", F.col("node_id").alias("stmt_id"), "start_pos", (F.col("end_pos") - 1).alias("end_pos")
    ).join(kept.select("doc_id", "stmt_id").distinct().hint("shuffle_hash"), ["doc_id", "stmt_id"], "left_semi")
    pointers = held_in(marks, statements, DOC).select("doc_id", "stmt_id").distinct()
    flagged = kept.join(
        pointers.withColumn("_ptr", F.lit(True)), ["doc_id", "stmt_id"], "left"
    )
    return flagged.select(
        "doc_id", "name", F.col("pos").alias("decl_id"), "scope_id", "visible_from",
        F.coalesce("_ptr", F.lit(False)).alias("is_pointer"), "node_id", "pos", "end",
    )


def field_declarations(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Declared fields with their type kind; the first declaration of a name wins."""
    types = nodes.filter("field = 'type'").select(
        "doc_id", F.col("parent_id").alias("stmt_id"),
        F.when(F.col("kind") == "slice_type", "Slice").when(F.col("kind") == "map_type", "Map")
        .when((F.col("kind") == "type_identifier") & (F.col("text") == "string"), "String")
        .otherwise("Other").alias("type_kind"),
    )
    rows = found.filter("decl_kind = 'field_declaration'").join(types, ["doc_id", "stmt_id"], "left")
    first = rows.groupBy("doc_id", "name").agg(F.min(F.struct("pos", "type_kind")).alias("_f"))
    return first.select(
        "doc_id", "name", F.col("_f.pos").alias("decl_id"),
        F.coalesce("_f.type_kind", F.lit("Other")).alias("type_kind"),
    )


def assigned_kinds(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Kind of the right side given to each target of an assignment."""
    sides = nodes.filter((F.col("kind") == "expression_list") & F.col("field").isin("left", "right"))
    items = nodes.select("doc_id", F.col("parent_id").alias("list_id"), "ordinal", "kind",
                         F.col("start_pos").alias("i_start"), F.col("end_pos").alias("i_end"))
    lists = sides.select("doc_id", F.col("node_id").alias("list_id"), F.col("parent_id").alias("stmt"),
                         F.col("field").alias("side"))
    members = items.join(lists.hint("shuffle_hash"), ["doc_id", "list_id"])
    left = members.filter("side = 'left'").select(
        "doc_id", "stmt", "ordinal", F.col("i_start").alias("start_pos"),
        (F.col("i_end") - 1).alias("end_pos"))
    right = members.filter("side = 'right'").select("doc_id", "stmt", "ordinal", "kind")
    same = left.join(right, ["doc_id", "stmt", "ordinal"], "left")
    first = right.filter("ordinal = 0").select("doc_id", "stmt", F.col("kind").alias("_first"))
    paired = same.join(first, ["doc_id", "stmt"], "left").select(
        "doc_id", "start_pos", "end_pos", F.coalesce("kind", "_first").alias("rhs_kind"))
    targets = found.filter("reassign").select("doc_id", "node_id", "pos")
    return held_in(targets, paired, DOC).select("doc_id", "node_id", "rhs_kind")


def names_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences and declared variables, both written."""
    found = staged(occurrences(nodes), "occurrences", "doc_id")
    return found, staged(declarations(found, nodes), "declarations", "doc_id")


def code_accesses(nodes: DataFrame, names: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Every use of a variable or field with all facts the rules read.

    `entity` is the position of the declaration; fields are matched by name alone. `names`: what
    `names_of` gave for the nodes, if it is there already.
    """
    found, decls = names or names_of(nodes)
    calls = staged(call_sites(nodes), "calls", "doc_id")
    named = sync_names(nodes, calls)
    flagged = calls.join(named.withColumn("in_sync_fn", F.lit(True)), ["doc_id", "simple_name"], "left")
    flagged = staged(flagged, "sync-calls", "doc_id")
    fields = field_declarations(found, nodes)
    is_use = F.col("decl_kind").isNull() & ~F.col("is_callee")
    # a short declaration of a name its scope already has is a use of the older one
    made = decls.select("doc_id", "node_id", F.lit(True).alias("_made")).distinct()
    again = (F.col("decl_kind") == "short_var_declaration") & F.col("_made").isNull()
    # a name that its document nowhere declares means nothing
    known = found.join(decls.select("doc_id", "name").distinct().hint("shuffle_hash"), ["doc_id", "name"], "left_semi")
    plain = known.join(made.hint("shuffle_hash"), ["doc_id", "node_id"], "left").filter(
        (is_use & ~F.col("is_field")) | again).select(*found.columns)
    resolved = symbols.resolve_scoped(
        plain.select("doc_id", "name", "pos"), decls, scopes_of(nodes), DOC, bounded=True
    ).select("doc_id", "pos", F.col("decl_id").alias("entity"))
    variables = plain.join(resolved, ["doc_id", "pos"]).join(
        decls.select("doc_id", F.col("decl_id").alias("entity"), "is_pointer"), ["doc_id", "entity"]
    ).withColumn("type_kind", F.lit("Other"))
    members = found.filter(is_use & F.col("is_field")).join(
        fields.withColumnRenamed("decl_id", "entity"), ["doc_id", "name"]
    ).withColumn("is_pointer", F.lit(False))
    all_uses = gathered([variables, members], "uses", "doc_id")
    around = surroundings(
        all_uses.select("doc_id", "node_id", "pos", "end"), nodes, flagged
    ).drop("pos", "end")
    homes = surroundings(decls.select("doc_id", "node_id", "pos", "end"), nodes, flagged).select(
        "doc_id", F.col("pos").alias("entity"), F.col("ctx").alias("decl_ctx"))
    facts = all_uses.join(around, ["doc_id", "node_id"]).join(homes, ["doc_id", "entity"], "left")
    facts = facts.join(assigned_kinds(found, nodes), ["doc_id", "node_id"], "left")
    is_global = ~F.col("is_field") & F.col("decl_ctx").isNull()
    captured = classify.captured_flag(
        F.col("ctx"), F.col("ctx_kind") == "function_literal", F.col("decl_ctx"),
        is_global | F.col("is_field"))
    return facts.select(
        "doc_id", "entity", "name", "ctx", "block", "pos", F.col("node_id").alias("seq"),
        F.when(F.col("reassign"), "write").otherwise("read").alias("op"), "is_field", "is_pointer",
        is_global.alias("is_global"), captured.alias("captured"), "concurrent", "is_atomic",
        "in_sync_call", F.when(F.col("heavy"), fixed.HEAVY_CALLS[0]).alias("callee"), "type_kind",
        "rhs_kind", "copied",
    )


def code_locks(nodes: DataFrame) -> DataFrame:
    """Lock events, once for every block around them: a scan looks at one block only."""
    calls = staged(call_sites(nodes).withColumn("in_sync_fn", F.lit(False)), "lock-calls", "doc_id")
    events = calls.withColumn("delta", lock_delta(F.col("method")).cast("long")).filter(
        F.col("delta").isNotNull() & (F.col("receiver") != ""))
    points = events.select(
        "doc_id", "node_id", F.col("start_pos").alias("pos"), F.col("end_pos").alias("end"),
        F.col("receiver").alias("lock_key"), "delta")
    known = surroundings(points, nodes, calls).select(
        "doc_id", "node_id", "pos", "lock_key", "delta", "ctx", "deferred")
    blocks = nodes.filter("kind = 'block'").select(
        "doc_id", F.col("node_id").alias("block"), "start_pos", (F.col("end_pos") - 1).alias("end_pos"))
    placed = held_in(sync.drop_deferred(known), blocks, DOC)
    return placed.select(
        "doc_id", F.coalesce("ctx", F.lit(-1)).alias("ctx"), "block", "pos",
        F.col("node_id").alias("seq"), "lock_key", "delta")


def code_findings(nodes: DataFrame) -> DataFrame:
    """Rule hits of every variable and field of a node table (`rules.rule_flags` columns)."""
    accesses = code_accesses(nodes).withColumn("ctx", F.coalesce("ctx", F.lit(-1))).withColumn(
        "block", F.coalesce("block", F.lit(-1)))
    accesses, locks = staged(accesses, "accesses", "doc_id"), staged(code_locks(nodes), "locks", "doc_id")
    held = sync.held_at(accesses, locks, ["doc_id", "ctx", "block"], ["pos", "seq"], bounded=True)
    rated = rules.with_severity(sync.is_synchronized(held, F.col("in_sync_call")))
    return rules.rule_flags(
        staged(rated, "code", "doc_id"), ["doc_id", "entity"], ["doc_id", "entity", "ctx"], ["pos", "seq"])
