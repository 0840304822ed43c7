"""The whole way from accesses to findings, decorations and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.functions import fixed
from usetrail.operators import classify, rules, sync
from usetrail.plans.scan import latest, running, stacked
from usetrail.session import staged

ORDER = ["pos", "seq"]


def uses_of(accesses: DataFrame) -> DataFrame:
    """Reads and writes only."""
    return accesses.filter(F.col("op").isin("read", "write"))


def with_capture(
    accesses: DataFrame, keys: list[str], is_global: Column, order: list[str] | None = None
) -> DataFrame:
    """Accesses with `is_global` and `captured`: in another context than the last declaration.

    Declarations and uses are rows of one table, so the declaring context is one as-of scan.
    """
    seen = running(
        accesses.withColumn("is_global", is_global), keys, order or ORDER,
        decl_ctx=latest(F.when(F.col("op") == "decl", F.col("ctx"))),
    )
    flag = classify.captured_flag(F.col("ctx"), F.col("concurrent"), F.col("decl_ctx"), F.col("is_global"))
    return seen.withColumn("captured", flag).drop("decl_ctx")


def assessed(accesses: DataFrame, scope: list[str], order: list[str] | None = None) -> DataFrame:
    """Uses with lock state, synchronisation flag and race severity.

    Lock state is kept per `scope`: the context and its block, or the context alone
    where locks outlive the block.
    """
    order = order or ORDER
    events = sync.drop_deferred(sync.lock_events(accesses)).select(
        *scope, *order, "lock_key", "delta"
    )
    held = sync.held_at(uses_of(accesses), events, scope, order)
    return rules.with_severity(sync.is_synchronized(held, F.col("is_atomic")))


def flagged(
    accesses: DataFrame, scope: list[str], keys: list[str], ctx_keys: list[str],
    order: list[str] | None = None, stage: bool = True,
) -> DataFrame:
    """Assessed uses with one column per rule.

    Missing columns take their neutral value: nothing captured, nothing global. The
    assessed uses are read by every group fact and again per use, so they are written
    to the shared folder once unless `stage` is off.
    """
    ready = assessed(accesses, scope, order)
    if stage:
        ready = staged(ready, "assessed")
    for name in ("captured", "is_global", "copied"):
        if name not in ready.columns:
            ready = ready.withColumn(name, F.lit(False))
    return rules.rule_flags(ready, keys, ctx_keys, order or ORDER)


def findings(
    marked: DataFrame, keys: list[str], name: Column, order: list[str] | None = None
) -> DataFrame:
    """Findings with rule, severity and message."""
    emitted = rules.emit_findings(marked, keys, order or ORDER, ["ctx", "op", "risk"])
    rule, level = rules.finding_names(F.col("rule_id"))
    message = rules.finding_message(F.col("rule_id"), name, F.col("op"), F.col("risk"))
    return emitted.select(
        *keys, *(order or ORDER), "ctx", rule.alias("rule"), level.alias("severity"),
        message.alias("message"),
    )


def use_texts(
    marked: DataFrame, keys: list[str], name: Column, order: list[str] | None = None
) -> DataFrame:
    """Text of every use with all clauses that apply, joined by ' | '.

    Some clauses stand only on the use that carries the finding (uneven locks, heavy
    call); retention and copy clauses stand on every fitting use up to it.
    """
    order = order or ORDER
    number = {"r3": 3, "r4": 4, "r5": 5, "r8": 8}
    emitted = rules.emit_findings(marked, keys, order)
    places = emitted.filter(F.col("rule_id").isin(*number.values())).groupBy(*keys).agg(
        *[F.min(F.when(F.col("rule_id") == i, F.struct(*order))).alias(f"_e{i}") for i in number.values()]
    )
    rows = marked.join(places, keys, "left")
    at = F.struct(*order)
    field = F.col("is_field")

    def on_finding(i: int) -> Column:
        return F.coalesce(at == F.col(f"_e{i}"), F.lit(False))

    def up_to_finding(i: int) -> Column:
        return F.coalesce(at <= F.col(f"_e{i}"), F.lit(True))

    race = F.when(F.col("race"), F.col("severity"))
    text = classify.joined_text(
        classify.base_text(name, F.col("op"), F.col("captured"), race),
        F.when(F.col("mixed_group"), F.format_string(fixed.MIXED_TEXT, name)),
        F.when(on_finding(3), F.format_string(fixed.COVERAGE_TEXT, name)),
        F.when(on_finding(4), F.format_string(fixed.HEAVY_TEXT, name)),
        F.when(field & F.col("concurrent") & ~F.col("in_sync"), fixed.UNLOCKED_TEXT),
        F.when(F.col("r5") & up_to_finding(5), F.col("risk")),
        F.when(F.col("r6"), fixed.WRITE_ONLY_TEXT),
        F.when(F.col("r7"), fixed.EARLY_READ_TEXT),
        F.when(F.col("r8") & up_to_finding(8), fixed.COPY_TEXT),
    )
    return rows.select(*marked.columns, text.alias("hover_text"))


def decorated(marked: DataFrame, decls: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Kind of every use and declaration row."""
    race = F.when(F.col("race"), F.col("severity"))
    kind = classify.lifecycle_kind(
        F.col("op"), F.col("is_pointer"), F.col("op") == "write", F.col("captured"), race
    )
    shown = ["entity", "ctx", "day", *(order or ORDER), "op"]
    shown = [c for c in shown if c in marked.columns]
    uses = marked.select(*shown, kind.alias("kind"))
    heads = decls.select(*shown, F.lit("Declaration").alias("kind"))
    return stacked(uses, heads)
