"""Race severity and hazard rules over accesses.

Group facts are aggregates joined back, not windows: they combine before the shuffle,
so one entity with very many accesses costs no more than any other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usetrail.functions import fixed
from usetrail.functions.columns import is_heavy_call, retention_risk
from usetrail.plans.intervals import inside_any
from usetrail.plans.scan import latest, running, stacked, total


def in_concurrent(points: DataFrame, sections: DataFrame, on: list[str]) -> DataFrame:
    """True for points inside any concurrent section; NULL keys and positions are in none."""
    return inside_any(points, sections, on, "concurrent")


def severity(in_sync: Column, concurrent: Column, is_write: Column) -> Column:
    """Low when synchronised, else High in a concurrent section or for a write."""
    return F.when(in_sync, "Low").when(concurrent | is_write, "High").otherwise("Medium")


def with_severity(accesses: DataFrame) -> DataFrame:
    return accesses.withColumn(
        "severity", severity(F.col("in_sync"), F.col("concurrent"), F.col("op") == "write")
    )


def race_findings(accesses: DataFrame) -> DataFrame:
    """Race candidates: not captured, in a concurrent section, on a global or field."""
    shared = F.col("is_global") | F.col("is_field")
    found = accesses.filter(~F.col("captured") & F.col("concurrent") & shared)
    return found.withColumn(
        "access", F.when(F.col("op") == "write", "write access").otherwise("read access")
    )


def race_rollup(findings: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per entity: that a race is possible, and the severity of the last candidate."""
    return findings.groupBy(*keys).agg(
        F.lit(True).alias("potential_race"), F.count("*").alias("n_candidates"),
        F.max(F.struct(*order, "severity"))["severity"].alias("race_severity"),
    )


def _mixed(accesses: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return accesses.groupBy(*keys).agg(
        F.count_if(F.col(flag)).alias("n_true"), F.count_if(~F.col(flag)).alias("n_false")
    ).filter("n_true > 0 AND n_false > 0")


def mixed_atomic(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """Entities accessed both atomically and plainly."""
    return _mixed(accesses, keys, "is_atomic")


def lock_coverage(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """Entities accessed both with and without synchronisation."""
    return _mixed(accesses, keys, "in_sync")


def heavy_under_lock(accesses: DataFrame) -> DataFrame:
    """Synchronised accesses inside a heavy call."""
    return accesses.filter(F.col("in_sync") & is_heavy_call(F.col("callee")))


def retention(assignments: DataFrame) -> DataFrame:
    """Assignments that keep a large backing store or object graph alive."""
    risk = retention_risk(F.col("type_kind"), F.col("rhs_kind"))
    return assignments.withColumn("risk", risk).filter(F.col("risk").isNotNull())


def first_writes(accesses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    place = F.struct(*order)
    return accesses.filter("op = 'write'").groupBy(*keys).agg(F.min(place).alias("_first_write"))


def read_before_write(accesses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Reads that come before the first write of their entity and context."""
    early = accesses.filter("op = 'read'").join(first_writes(accesses, keys, order), keys)
    return early.filter(F.struct(*order) < F.col("_first_write")).select(*accesses.columns)


def write_only(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """Entities with two or more uses, all of them writes."""
    return accesses.groupBy(*keys).agg(
        F.count("*").alias("n_uses"), F.count_if(F.col("op") == "write").alias("n_writes")
    ).filter("n_uses >= 2 AND n_writes = n_uses")


def unlocked_concurrent(accesses: DataFrame) -> DataFrame:
    """Field accesses in a concurrent section without an active lock (a note only)."""
    return accesses.filter(F.col("concurrent") & ~F.col("in_sync"))


def rule_flags(
    accesses: DataFrame, keys: list[str], ctx_keys: list[str], order: list[str]
) -> DataFrame:
    """Group facts and per-use rule hits, one boolean column per rule.

    Reads entity columns `is_field`, `is_global`, `is_pointer` and per-use columns
    op, captured, concurrent, is_atomic, in_sync, severity, callee, type_kind,
    rhs_kind, copied.
    """
    facts = accesses.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if(F.col("op") == "write").alias("_w"),
        F.count_if("is_atomic").alias("_a"), F.count_if("in_sync").alias("_s"),
    )
    n = F.col("_n")
    firsts = first_writes(accesses, ctx_keys, order)
    joined = accesses.join(facts, keys).join(firsts, ctx_keys, "left")
    field, is_write = F.col("is_field"), F.col("op") == "write"
    race = ~F.col("captured") & F.col("concurrent") & (F.col("is_global") | field)
    group_mixed = field & (F.col("_a") > 0) & (F.col("_a") < n)
    group_uneven = field & (F.col("_s") > 0) & (F.col("_s") < n)
    group_write_only = field & (n >= 2) & (F.col("_w") == n)
    early = F.coalesce(F.struct(*order) < F.col("_first_write"), F.lit(False)) & ~is_write
    risk = retention_risk(F.col("type_kind"), F.col("rhs_kind"))
    flags = {
        "race": race,
        "r1": race & (F.col("severity") == "High"),
        "mixed_group": group_mixed,
        "r2": group_mixed & ~F.col("is_atomic"),
        "r3": group_uneven & ~F.col("in_sync"),
        "r4": field & F.col("in_sync") & is_heavy_call(F.col("callee")),
        "r5": field & risk.isNotNull(),
        "r6": group_write_only,
        "r7": field & ~group_write_only & early,
        "r8": ~field & ~F.col("is_pointer") & ~is_write & F.col("copied"),
    }
    return joined.select(
        *accesses.columns, risk.alias("risk"), *[c.alias(k) for k, c in flags.items()]
    )


def emit_findings(
    flagged: DataFrame, keys: list[str], order: list[str], shown: list[str] | None = None
) -> DataFrame:
    """Which use carries which finding; `shown` columns of the use come along.

    Race-high goes on every use it fits. Each other rule goes once per entity, on its
    first use that carries no finding of an earlier rule. A rule can lose at most one
    use to each of the rules between race-high and itself, so its winner is among its
    first seven fitting uses; only those leave the tasks that find them.
    """
    number, shown = len(fixed.RULES), shown or []
    place = F.struct(*order)
    hit_rules = F.array_compact(
        F.array(*[F.when(F.col(f"r{i}"), F.lit(i)) for i in range(2, number + 1)])
    )
    fitting = flagged.filter(~F.col("r1")).select(
        *keys, F.explode(hit_rules).alias("rule_id"), place.alias("at"),
        F.struct(*order, *shown).alias("use"),
    )
    # window and filter: Spark keeps the first rows per task before the shuffle
    first = Window.partitionBy(*keys, "rule_id").orderBy("at")
    shortlist = fitting.withColumn("_rn", F.row_number().over(first)).filter(
        F.col("_rn") <= number - 1
    )
    per_group = shortlist.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rule_id", "at", "use"))).alias("_list")
    )
    # walk the short list in rule order; take a use if its rule and the use are free
    taken_type = per_group.schema["_list"].dataType.simpleString()
    chosen = F.aggregate(
        "_list",
        F.array().cast(taken_type),
        lambda taken, item: F.when(
            F.exists(
                taken,
                lambda t: (t["rule_id"] == item["rule_id"]) | (t["at"] == item["at"]),
            ),
            taken,
        ).otherwise(F.concat(taken, F.array(item))),
    )
    once = per_group.select(*keys, F.explode(chosen).alias("_c")).select(
        *keys, F.col("_c.rule_id").alias("rule_id"), "_c.use.*"
    )
    always = flagged.filter("r1").select(*keys, F.lit(1).alias("rule_id"), *order, *shown)
    return stacked(always, once)


def finding_names(rule_id: Column) -> tuple[Column, Column]:
    """Rule name and diagnostic severity of a rule number."""
    name = F.lit(None).cast("string")
    level = F.lit(None).cast("string")
    for number, rule, sev, _ in fixed.RULES:
        name = F.when(rule_id == number, rule).otherwise(name)
        level = F.when(rule_id == number, sev).otherwise(level)
    return name, level


def finding_message(rule_id: Column, name: Column, op: Column, risk: Column) -> Column:
    """Message of a finding."""
    access = F.when(op == "write", "write access").otherwise("read access")
    out = F.lit(None).cast("string")
    for number, rule, _, text in fixed.RULES:
        if rule == "field-race-high":
            shown = F.format_string(text, name, access)
        elif rule == "field-retention":
            shown = F.format_string(text, risk, name)
        else:
            shown = F.format_string(text, name)
        out = F.when(rule_id == number, shown).otherwise(out)
    return out


def severity_table(spark) -> DataFrame:
    """Diagnostic severities with their rank."""
    return spark.createDataFrame(fixed.SEVERITIES, "rank int, severity string")


def is_field_decl(
    points: DataFrame, spans: DataFrame, on: list[str], field_kinds: list[str],
    stop_kinds: list[str], bounded: bool = False,
) -> DataFrame:
    """True where the innermost span of either list around a point is a field kind.

    The innermost span is the one that starts last; per kind of span (field or stop) that
    is found among the spans still open at the point by a scan over their starts and ends.
    Points keep their columns, NULLs and repeats; a NULL key or position is in no span.
    """
    wanted = spans.filter(F.col("kind").isin(field_kinds + stop_kinds) & keyed_of(on)).filter("start_pos <= end_pos")
    sides = F.array(
        F.struct(F.col("start_pos").alias("_at"), F.lit(0).alias("_turn"), F.lit(1).cast("long").alias("_d")),
        F.struct(F.col("end_pos").alias("_at"), F.lit(2).alias("_turn"), F.lit(-1).cast("long").alias("_d")),
    )
    turns = wanted.select(*on, F.col("kind").isin(field_kinds).alias("_field"), F.explode(sides).alias("_s")).select(
        *on, "_field", "_s.*"
    )
    asked = points.select(
        *on, F.col("pos").alias("_at"), F.lit(1).alias("_turn"), F.lit(0).cast("long").alias("_d"),
        F.struct(*points.columns).alias("_point"),
    )
    order = ["_at", "_turn"]
    deep = running(stacked(asked, turns, partial=True), on, order, bounded, _depth=total(F.col("_d")))
    # the span around a point is the last one opened on the point's own level
    level = F.when(F.col("_d") < 0, F.col("_depth") + 1).otherwise(F.col("_depth"))
    inner = running(
        deep.withColumn("_level", level).filter("_d >= 0"), [*on, "_level"], order, bounded,
        _inner=latest(F.when(F.col("_d") > 0, F.col("_field"))),
    )
    return inner.filter("_turn = 1").select(
        "_point.*",
        (keyed_of(on) & F.col("_at").isNotNull() & (F.col("_depth") > 0) & F.coalesce("_inner", F.lit(False))).alias("is_field"),
    )


def keyed_of(on: list[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in on])
