"""Declarations, uses and the resolution of one to the other."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from usetrail.functions import fixed
from usetrail.plans import nested
from usetrail.plans.scan import latest, listed, running, stacked, total

OWN_DEPTH = 1 << 30


def extract_decls(
    candidates: DataFrame, scope: list[str], name: str = "name", bounded: bool = False
) -> DataFrame:
    """Declarations among candidate rows (kind, scope columns, name, pos).

    A short declaration counts only where its scope has none of the name yet; every
    other declaring kind always counts. A range clause declares only with `declares`.
    """
    declaring = candidates.filter(
        F.col("kind").isin(fixed.DECL_KINDS)
        & ((F.col("kind") != "range_clause") | F.col("declares"))
    )
    seen = running(
        declaring, [*scope, name], ["pos"], bounded, _before=total(F.lit(1), exclusive=True)
    )
    redeclared = (F.col("kind") == "short_var_declaration") & (F.col("_before") > 0)
    return seen.filter(~redeclared).drop("_before")


def resolve_asof(
    rows: DataFrame, keys: list[str], order: list[str], is_decl: Column, decl: Column,
    into: str = "decl_id", bounded: bool = False,
) -> DataFrame:
    """Latest declaration at or before each row among rows of the same keys."""
    return running(rows, keys, order, bounded, **{into: latest(F.when(is_decl, decl))})


def resolve_scoped(
    uses: DataFrame, decls: DataFrame, scopes: DataFrame, on: list[str], bounded: bool = False
) -> DataFrame:
    """Innermost enclosing scope with a declaration visible at the use; shadowing kept.

    uses(on.., name, pos), decls(on.., name, decl_id, scope_id, visible_from),
    scopes(on.., scope_id, depth, start_pos, end_pos). Uses without a visible
    declaration give no row.

    One sweep per name: a declaration opens where it becomes visible and closes with its
    scope, so the open ones are a stack, and what a use means is the latest that opened on
    the level the use is at. Neither uses nor declarations are copied per scope. The stack
    holds as scopes nest and an outer declaration is not first seen inside an inner scope that
    declares the name; where that fails the job stops.
    """
    if bounded:
        return _resolved_in_place(uses, decls, scopes, on)
    order = ["pos", "_turn", "_depth", "_decl"]
    steps = _steps(uses, decls, scopes, on)
    levelled = running(steps, [*on, "name"], order, _level=total(F.col("_step"))).filter("_turn < 2")
    # An opening also asks for the one below it, to see that that is no deeper.
    opens = F.col("_turn") == 0
    asks = F.array_compact(F.array(
        F.struct("_level", (~opens).alias("_asks")),
        F.when(opens, F.struct((F.col("_level") - 1).alias("_level"), F.lit(True).alias("_asks"))),
    ))
    rows = levelled.select(*on, "name", *order, F.inline(asks))
    found = running(
        rows, [*on, "name", "_level"], order,
        decl_id=latest(F.when(~F.col("_asks"), F.col("_decl"))), depth=latest(F.when(~F.col("_asks"), F.col("_depth"))),
    )
    crossing = F.raise_error(
        F.concat(F.lit(nested.CROSSING), F.col("name"))
    ).cast("boolean")
    kept = F.when(opens & F.col("_asks") & (F.col("depth") > F.col("_depth")), crossing).otherwise(
        ~opens & F.col("decl_id").isNotNull()
    )
    return found.filter(kept).select(*on, "name", "pos", "decl_id", "depth")


def _sides(opened: Column, closed: Column, *more: Column) -> Column:
    return F.array(
        F.struct(opened.alias("pos"), F.lit(0).alias("_turn"), F.lit(1).alias("_step"), *more),
        F.struct(closed.alias("pos"), F.lit(2).alias("_turn"), F.lit(-1).alias("_step"), *more),
    )


def _steps(uses: DataFrame, decls: DataFrame, scopes: DataFrame, on: list[str]) -> DataFrame:
    """Openings, closings and uses: (on.., name, pos, _turn, _step, _depth, _decl)."""
    homes = scopes.select(*on, "scope_id", F.col("depth").alias("_depth"), F.col("end_pos").alias("_end"))
    live = decls.join(homes, [*on, "scope_id"]).filter(F.col("visible_from") <= F.col("_end"))
    sides = _sides(F.col("visible_from").cast("long"), F.col("_end").cast("long"))
    edges = live.select(*on, "name", "_depth", F.col("decl_id").cast("long").alias("_decl"), F.inline(sides))
    asked = uses.select(*on, "name", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("_turn"), F.lit(0).alias("_step"))
    return stacked(asked, edges, partial=True)


def _resolved_in_place(uses: DataFrame, decls: DataFrame, scopes: DataFrame, on: list[str]) -> DataFrame:
    """`resolve_scoped` of groups that fit a task: the three tables meet as lists, and no word is shuffled or sorted.

    The sweep is made on numbers, many groups at once (`nested.answered`). A group without uses,
    declarations or scopes has no answers.
    """
    c, types = F.col, {x: df.schema[x].dataType for df, x in ((uses, "name"), (scopes, "scope_id"), (scopes, "depth"))}
    lists = (
        listed(uses.select(*on, "name", c("pos").cast("long").alias("pos")), on, "_uses")
        .join(listed(scopes.select(*on, "scope_id", "depth", c("end_pos").cast("long").alias("end_pos")), on, "_scopes"), on)
        .join(listed(decls.select(
            *on, c("name").cast(types["name"]).alias("name"), c("visible_from").cast("long").alias("pos"),
            c("decl_id").cast("long").alias("decl_id"), c("scope_id").cast(types["scope_id"]).alias("scope_id")), on, "_decls"), on)
    )
    made = StructType([*(lists.schema[x] for x in on), StructField("name", types["name"]), StructField("pos", LongType()),
                       StructField("decl_id", LongType()), StructField("depth", types["depth"])])
    return lists.mapInArrow(partial(nested.answered, on), made)


def resolve_timeline(
    rows: DataFrame, on: list[str], bounded: bool = False, own: bool = False
) -> DataFrame:
    """Resolve uses against declarations that stand in one table of scope entries.

    rows(on.., name, scope_id, pos, is_use, depth, at, decl): a use comes once per
    scope around it, a declaration once, at the position from which it is visible. Each
    (scope, name) is one as-of scan, so uses and declarations of one name are never
    paired with each other; the answer is the hit at the greatest depth. With `own` a
    declaration is the answer for its own position.
    """
    scanned = running(
        rows, [*on, "scope_id", "name"], ["pos", "is_use"], bounded, _found=latest(F.col("decl"))
    )
    is_use = F.col("is_use") == 1
    wanted = F.col("_found").isNotNull() & (F.lit(own) | is_use)
    # whole-number buffers keep this a hash aggregate
    rank = F.when(is_use, F.col("depth")).otherwise(OWN_DEPTH)
    found = F.when(is_use, F.col("_found")).otherwise(F.col("decl"))
    return (
        scanned.filter(wanted)
        .groupBy(*on, "name", F.col("at").alias("pos"))
        .agg(F.max_by(found, rank).alias("decl_id"), F.max(rank).alias("depth"))
    )


def collect_uses(resolved: DataFrame, on: list[str]) -> DataFrame:
    """Resolved occurrences less the declaration itself, one row per range."""
    return resolved.filter(F.col("pos") != F.col("decl_id")).dropDuplicates(
        [*on, "decl_id", "pos"]
    )


def count_uses(resolved: DataFrame, on: list[str]) -> DataFrame:
    """Use count of every declaration, 0 included.

    Occurrences are de-duplicated by the same aggregate that counts them.
    """
    distinct = F.countDistinct(F.when(F.col("pos") != F.col("decl_id"), F.col("pos")))
    return resolved.groupBy(*on, "decl_id").agg(distinct.alias("n_uses"))


def resolve_by_name(
    uses: DataFrame, decls: DataFrame, on: list[str], order: list[str], value: str,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """Resolve by name alone: the first declaration of the name wins.

    `chosen` (on.., value) names a declaration the asker points at; it goes before.
    """
    first = decls.groupBy(*on).agg(F.min(F.struct(*order, value)).alias("_f")).select(
        *on, F.col(f"_f.{value}").alias("decl_id")
    )
    if chosen is not None:
        picked = chosen.select(*on, F.col(value).alias("_picked"))
        first = first.join(picked, on, "left").select(
            *on, F.coalesce("_picked", "decl_id").alias("decl_id")
        )
    return uses.join(first, on)


def drop_callee_symbols(uses: DataFrame, calls: DataFrame, on: list[str]) -> DataFrame:
    """Uses that are not the called name of some call."""
    return uses.join(calls.select(*on).distinct(), on, "left_anti")


def drop_symbol_kinds(df: DataFrame, col: str, kinds: list[str] | None = None) -> DataFrame:
    """Rows whose symbol is no function, type, package, builtin or label."""
    return df.filter(~F.col(col).isin(kinds or fixed.HIDDEN_SYMBOL_KINDS))


def merge_objects(
    objects: DataFrame, uses: DataFrame, obj: str, guard: str, use: list[str]
) -> DataFrame:
    """Several objects under one guard name: distinct uses, pointer if any is one."""
    used = uses.join(objects.select(obj, guard), obj)
    n_uses = used.groupBy(guard, *use).agg(F.lit(1).alias("_one")).groupBy(guard).agg(
        F.count("*").alias("n_uses")
    )
    flags = objects.groupBy(guard).agg(
        F.count("*").alias("n_objects"), F.bool_or("is_pointer").alias("is_pointer")
    )
    return flags.join(n_uses, guard, "left").withColumn(
        "n_uses", F.coalesce("n_uses", F.lit(0))
    )


def prefer(primary: DataFrame, fallback: DataFrame, on: list[str], col: str) -> DataFrame:
    """The primary answer of each key, else the fallback's."""
    p = primary.select(*on, F.col(col).alias("_p"))
    f = fallback.select(*on, F.col(col).alias("_f"))
    return f.join(p, on, "full").select(*on, F.coalesce("_p", "_f").alias(col))


def pointer_flag(
    uses: DataFrame, keys: list[str], type_kind: Column, under_reference: Column
) -> DataFrame:
    """Pointer-like: a reference type, or any use under an address or dereference."""
    by_type = type_kind.isin(fixed.POINTER_TYPES) | type_kind.isin(
        "pointer_type", *fixed.REFERENCE_KINDS
    )
    flag = F.coalesce(by_type, F.lit(False)) | F.coalesce(under_reference, F.lit(False))
    return uses.groupBy(*keys).agg(F.bool_or(flag).alias("is_pointer"))


def is_global(nodes: DataFrame, function_kinds: list[str], max_depth: int | None,
              tree: list[str] | None = None, start: Column | None = None,
              leaves: list[str] | None = None) -> DataFrame:
    """True for nodes that neither are nor lie in a function."""
    from usetrail.operators.structure import with_path

    climbed = with_path(nodes, max_depth, tree=tree, start=start, leaves=leaves)
    inside = F.exists("path", lambda a: a["kind"].isin(function_kinds))
    own = F.col("kind").isin(function_kinds)
    return climbed.select(*nodes.columns, (~inside & ~own).alias("is_global"))
