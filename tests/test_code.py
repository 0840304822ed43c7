"""The whole way from syntax nodes to findings on small hand-built trees."""

import pytest
from pyspark.sql import functions as F

from usetrail.operators import counts, structure
from usetrail.plans import code_facts, hazards


def n(kind, *children, field=None, text=None):
    return {"kind": kind, "field": field, "text": text, "children": children}


def name(text, field=None):
    return n("identifier", field=field, text=text)


def sel(obj, member, field=None):
    return n("selector_expression", name(obj, "operand"),
             n("field_identifier", field="field", text=member), field=field, text=f"{obj}.{member}")


def call(fn, *args):
    fn["field"] = "function"
    return n("call_expression", fn, n("argument_list", *args, field="arguments"))


def assign(left, right, kind="assignment_statement"):
    return n(kind, n("expression_list", left, field="left"), n("expression_list", right, field="right"))


def block(*statements):
    return n("block", *statements, field="body")


def func(label, *statements):
    return n("function_declaration", name(label, "name"), block(*statements))


def go(*statements):
    return n("go_statement", call(n("function_literal", block(*statements))))


def field(label, type_node):
    type_node["field"] = "type"
    return n("field_declaration", n("field_identifier", field="name", text=label), type_node)


def frame(spark, *children):
    rows, clock = [], [0]

    def walk(node, parent, ordinal, depth):
        number = len(rows)
        rows.append(None)
        start = clock[0]
        clock[0] += 2
        for i, child in enumerate(node["children"]):
            walk(child, number, i, depth + 1)
        end = clock[0] - 1
        rows[number] = (1, number, parent, node["field"], ordinal, node["kind"], start, end, depth,
                        node["text"])

    walk(n("source_file", *children), None, 0, 0)
    return spark.createDataFrame(
        rows, "doc_id bigint, node_id bigint, parent_id bigint, field string, ordinal int, kind string,"
        " start_pos bigint, end_pos bigint, depth int, text string")


INT = lambda: n("type_identifier", text="int")


def facts(spark, *children):
    marked = code_facts.code_findings(frame(spark, *children)).cache()
    return marked, marked.orderBy("pos").collect()


def test_lock_atomic_and_race(spark):
    _, rows = facts(
        spark, n("struct_type", field("count", INT())),
        func("run", go(
            call(sel("mu", "Lock")), assign(sel("s", "count"), name("v")), call(sel("mu", "Unlock")),
            assign(sel("s", "count"), name("v")),
            call(sel("atomic", "AddInt64"), sel("s", "count")),
        )),
    )
    uses = [r for r in rows if r["is_field"]]
    assert [(r["op"], r["in_sync"], r["severity"]) for r in uses] == [
        ("write", True, "Low"), ("write", False, "High"), ("read", True, "Low")]
    assert [r["is_atomic"] for r in uses] == [False, False, True]
    assert all(r["mixed_group"] and r["concurrent"] for r in uses)


def test_deferred_unlock_and_locks_of_other_blocks(spark):
    _, rows = facts(
        spark, n("struct_type", field("count", INT())),
        func("run", call(sel("mu", "Lock")), n("defer_statement", call(sel("mu", "Unlock"))),
             assign(sel("s", "count"), name("v")),
             n("if_statement", block(assign(sel("s", "count"), name("v"))))),
    )
    assert [r["in_sync"] for r in rows if r["is_field"]] == [True, False]


def test_sync_function_call_counts(spark):
    _, rows = facts(
        spark, n("struct_type", field("count", INT())), func("guard", call(sel("mu", "Lock"))),
        func("run", call(name("guard"), sel("s", "count")), call(name("other"), sel("s", "count"))),
    )
    assert [r["in_sync"] for r in rows if r["is_field"]] == [True, False]


def test_scopes_reassignment_and_capture(spark):
    _, rows = facts(
        spark,
        func("run", assign(name("x"), name("a"), "short_var_declaration"),
             assign(name("x"), name("x")),
             n("if_statement", block(assign(name("x"), name("b"), "short_var_declaration"),
                                     call(name("use"), name("x")))),
             assign(name("x"), name("c"), "short_var_declaration"),
             go(call(name("use"), name("x")))),
    )
    xs = [r for r in rows if r["name"] == "x"]
    outer = min(r["entity"] for r in xs)
    assert [(r["entity"] == outer, r["op"], r["captured"]) for r in xs] == [
        (True, "write", False), (True, "read", False),   # x = x
        (False, "read", False),                          # inner x
        (True, "write", False),                          # x := again in the same scope
        (True, "read", True)]                            # inside the goroutine


def test_methods_are_no_field_uses_and_globals_can_race(spark):
    _, rows = facts(
        spark, n("struct_type", field("save", INT())), n("var_spec", name("total", "name"), INT()),
        func("run", call(sel("s", "save")), go(assign(name("total"), name("v")))),
    )
    assert not [r for r in rows if r["name"] == "save"]
    total = [r for r in rows if r["name"] == "total"]
    assert [(r["is_global"], r["race"], r["severity"]) for r in total] == [(True, True, "High")]


def test_retention_copy_and_heavy(spark):
    slice_type = n("slice_type", text="[]byte")
    marked, rows = facts(
        spark, n("struct_type", field("buf", slice_type)),
        func("run", assign(name("big"), n("composite_literal"), "short_var_declaration"),
             assign(sel("s", "buf"), n("slice_expression", name("big"))),
             call(sel("mu", "Lock")), call(name("append"), sel("s", "buf")), call(sel("mu", "Unlock")),
             call(name("take"), name("big")),
             call(name("take"), n("unary_expression", name("big"), text="&big"))),
    )
    found = hazards.findings(marked, ["doc_id", "entity"], F.col("entity").cast("string"))
    got = sorted(r["rule"] for r in found.collect())
    assert got == ["field-heavy-under-lock", "field-lock-coverage", "struct-large-copy"]
    buf = [r for r in rows if r["name"] == "buf"]
    assert [r["r5"] for r in buf] == [True, False]  # its use carries the coverage finding already
    assert [r["copied"] for r in rows if r["name"] == "big"][-2:] == [True, False]


def test_counts(spark):
    nodes = frame(
        spark, func("a", assign(name("x"), name("y"), "short_var_declaration"),
                    n("var_spec", name("z", "name"), n("channel_type", field="type")), go()),
        func("b"))
    up = code_facts.with_parents(nodes, nodes, 2).select(
        "doc_id", "kind", "field", F.col("p1_kind").alias("parent_kind"),
        F.col("p2_kind").alias("grand_kind"), F.col("p1_field").alias("list_field"))
    row = counts.count_entities(up, "doc_id", counts.code_classes()).first()
    assert tuple(row)[1:] == (2, 2, 1, 1)
    loose = counts.count_entities(up, "doc_id", counts.code_classes(strict=False)).first()
    assert loose["variables"] == 3


@pytest.mark.parametrize("kind, parent, slot, want", [
    ("identifier", "var_spec", "name", "VariableDeclaration"),
    ("identifier", "selector_expression", "field", "FieldAccess"),
    ("identifier", "selector_expression", "operand", "ObjectAccess"),
    ("identifier", "if_statement", None, "VariableUse"), ("identifier", None, None, "Unknown"),
    ("channel_type", "var_spec", "type", "ChannelType"), ("block", "if_statement", None, "Unknown"),
])
def test_context_classes(spark, kind, parent, slot, want):
    df = spark.createDataFrame(
        [(kind, parent, slot, None, None)],
        "kind string, parent_kind string, field string, grand_kind string, parent_field string")
    assert structure.classify_context(df).first()["context_type"] == want
