"""Lock state and hazard rules on hand-written and random accesses."""

import random

import pytest
from pyspark.sql import functions as F

from usetrail.operators import classify, rules, sync
from usetrail.plans import hazards

COLUMNS = (
    "entity bigint, ctx bigint, block string, pos bigint, seq bigint, op string, lock_key string,"
    " is_atomic boolean, concurrent boolean, deferred boolean"
)


def accesses(spark, *rows):
    """Rows (ctx, pos, op, lock key, options)."""
    full = []
    for i, (ctx, pos, op, key, opts) in enumerate(rows):
        full.append((
            opts.get("entity", 1), ctx, opts.get("block", "b"), pos, i, op, key,
            opts.get("atomic", False), opts.get("concurrent", True), opts.get("deferred", False),
        ))
    return spark.createDataFrame(full, COLUMNS)


def severities(spark, *rows):
    out = hazards.assessed(accesses(spark, *rows), ["ctx", "block"])
    return [r["severity"] for r in out.orderBy("pos", "seq").collect()]


@pytest.mark.parametrize("rows, expected", [
    # lock covers the first access only
    ([(1, 1, "acquire", "mu", {}), (1, 2, "read", None, {}), (1, 3, "release", "mu", {}),
      (1, 4, "read", None, {})], ["Low", "High"]),
    # a deferred release keeps the lock
    ([(1, 1, "acquire", "mu", {}), (1, 2, "release", "mu", {"deferred": True}),
      (1, 3, "read", None, {})], ["Low"]),
    # a release before the first acquire does not count below zero
    ([(1, 1, "release", "mu", {}), (1, 2, "acquire", "mu", {}), (1, 3, "read", None, {})], ["Low"]),
    # one of two locks is still held
    ([(1, 1, "acquire", "a", {}), (1, 2, "acquire", "b", {}), (1, 3, "release", "a", {}),
      (1, 4, "read", None, {})], ["Low"]),
    # another context's lock does not help
    ([(1, 1, "acquire", "mu", {}), (2, 2, "read", None, {})], ["High"]),
    # a lock of another block does not help
    ([(1, 1, "acquire", "mu", {"block": "outer"}), (1, 2, "read", None, {})], ["High"]),
    # a lock call at the position of the access counts
    ([(1, 5, "read", None, {}), (1, 5, "acquire", "mu", {})], ["Low"]),
    # lock keys are trimmed, empty keys dropped
    ([(1, 1, "acquire", " ", {}), (1, 2, "read", None, {})], ["High"]),
    # outside concurrent sections a read is medium, a write high
    ([(1, 1, "read", None, {"concurrent": False}), (1, 2, "write", None, {"concurrent": False})],
     ["Medium", "High"]),
    # an atomic access is synchronised
    ([(1, 1, "write", None, {"atomic": True})], ["Low"]),
])
def test_lock_state_and_severity(spark, cutting, rows, expected):
    assert severities(spark, *rows) == expected


def marked(spark, rows):
    """rows: (entity, ctx, op, in_sync, atomic, concurrent, callee, type, rhs, field, copied)."""
    full = [(i, i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(
        full,
        "pos bigint, seq bigint, entity bigint, ctx bigint, op string, in_sync boolean,"
        " is_atomic boolean, concurrent boolean, callee string, type_kind string, rhs_kind string,"
        " is_field boolean, copied boolean",
    )
    df = rules.with_severity(df).withColumn("captured", F.lit(False)).withColumn(
        "is_global", F.lit(False)).withColumn("is_pointer", F.lit(False))
    return rules.rule_flags(df, ["entity"], ["entity", "ctx"], ["pos", "seq"])


def test_emission_order_equals_loop(spark):
    rnd = random.Random(11)
    rows = [
        (rnd.randrange(25), rnd.randrange(2), rnd.choice(["read", "read", "write"]),
         rnd.random() < 0.5, rnd.random() < 0.4, rnd.random() < 0.25,
         rnd.choice(["append", "len", None]), rnd.choice(["Slice", "Map", "Other"]),
         rnd.choice(["slice_expression", "identifier", None]), None, rnd.random() < 0.5)
        for _ in range(400)
    ]
    rows = [(*r[:9], r[0] % 4 != 0, r[10]) for r in rows]
    flagged = marked(spark, rows)
    got = {
        (r["entity"], r["seq"], r["rule_id"])
        for r in rules.emit_findings(flagged, ["entity"], ["pos", "seq"]).collect()
    }
    want = set()
    by_entity = {}
    for i, r in enumerate(rows):
        by_entity.setdefault(r[0], []).append((i, r))
    for entity, uses in by_entity.items():
        field = uses[0][1][9]
        atom = {u[1][4] for u in uses}
        lock = {u[1][3] for u in uses}
        all_writes = len(uses) >= 2 and all(u[1][2] == "write" for u in uses)
        done = set()
        for i, (_, ctx, op, in_sync, atomic, conc, callee, kind, rhs, _, copied) in uses:
            rule = 1 if field and conc and not in_sync else None
            first_write = min((j for j, u in uses if u[1] == ctx and u[2] == "write"), default=None)
            risk = (kind == "Slice" and rhs == "slice_expression") or (
                kind == "Map" and rhs == "identifier")
            tests = [
                (2, field and len(atom) == 2 and not atomic),
                (3, field and len(lock) == 2 and not in_sync),
                (4, field and in_sync and callee == "append"),
                (5, field and risk),
                (6, field and all_writes),
                (7, field and not all_writes and op == "read" and first_write is not None
                 and i < first_write),
                (8, not field and op == "read" and copied),
            ]
            for number, fits in tests:
                if rule is None and fits and number not in done:
                    rule = number
                    done.add(number)
            if rule:
                want.add((entity, i, rule))
    assert got == want


def test_single_rules(spark):
    base = ("len", "Other", None, True, False)
    rows = [
        (1, 1, "write", False, True, False, *base), (1, 1, "write", False, False, False, *base),
        (2, 1, "read", False, False, False, *base), (2, 1, "read", False, False, False, *base),
        (2, 1, "write", False, False, False, *base), (2, 2, "read", False, False, False, *base),
        (3, 1, "write", False, False, False, *base),
    ]
    df = marked(spark, rows)
    assert [r["entity"] for r in rules.mixed_atomic(df, ["entity"]).collect()] == [1]
    early = rules.read_before_write(df, ["entity", "ctx"], ["pos", "seq"])
    assert sorted(r["seq"] for r in early.collect()) == [2, 3]
    assert [r["entity"] for r in rules.write_only(df, ["entity"]).collect()] == [1]
    found = {(r["seq"], r["rule"]) for r in
             hazards.findings(df, ["entity"], F.lit("x")).collect()}
    assert found == {(1, "field-mixed-atomic"), (0, "field-write-only"), (2, "field-read-before-write")}


def test_rollup_takes_the_last_severity(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, "High"), (1, 2, 2, "Low")], "entity int, pos bigint, seq bigint, severity string"
    )
    row = rules.race_rollup(df, ["entity"], ["pos", "seq"]).first()
    assert (row["potential_race"], row["race_severity"]) == (True, "Low")


def test_kinds_and_texts(spark):
    df = spark.createDataFrame(
        [("read", False, False, False, None), ("write", True, True, False, None),
         ("read", True, False, True, None), ("read", True, False, False, None),
         ("read", False, False, False, "Low"), ("write", False, True, False, "High"),
         ("decl", True, False, False, None)],
        "op string, p boolean, w boolean, c boolean, race string",
    )
    kind = classify.lifecycle_kind(*[F.col(c) for c in ("op", "p", "w", "c", "race")])
    assert [r[0] for r in df.select(kind).collect()] == [
        "Use", "AliasReassigned", "AliasCaptured", "Pointer", "RaceLow", "Race", "Declaration"]
    text = classify.base_text(F.lit("x"), F.col("op"), F.col("c"), F.col("race"))
    assert [r[0] for r in df.select(text).collect()][4:6] == [
        "Use of `x` in goroutine - LOW PRIORITY (sync detected, read access)",
        "Use of `x` in goroutine - HIGH PRIORITY data race (write access)"]


def test_reassign_rules(spark):
    rows = [
        ("assignment_statement", "left", "=", False, True, True),
        ("assignment_statement", "left", "=", False, False, False),  # x[i] = v
        ("assignment_statement", "right", "=", False, True, False),
        ("short_var_declaration", "left", ":=", True, True, False),
        ("short_var_declaration", "left", ":=", False, True, True),
        ("inc_statement", None, "++", False, True, True),
        ("range_clause", "left", "=", False, True, True),
        ("range_clause", "left", ":=", True, True, False),
        ("call_expression", None, None, False, True, False),
    ]
    df = spark.createDataFrame(
        rows, "k string, side string, tok string, new boolean, direct boolean, want boolean"
    )
    flag = classify.reassign_flag(*[F.col(c) for c in ("k", "side", "tok", "new", "direct")])
    assert all(r[0] == r[1] for r in df.select(flag, "want").collect())


def test_sync_functions_by_simple_name(spark):
    calls = spark.createDataFrame([("save", "Lock"), ("load", "Print")], "fn string, method string")
    names = sync.sync_functions(calls, "fn", F.col("method") == "Lock")
    sites = spark.createDataFrame([("save",), ("load",)], "callee string")
    got = {r["callee"]: r["in_sync_fn"] for r in sync.flag_calls(sites, names, "callee").collect()}
    assert got == {"save": True, "load": False}
