"""Spans, lookups and resolution on small tables."""

import random

from pyspark.sql import functions as F

from usetrail.functions.columns import clipped, is_atomic_name, is_heavy_call, is_mutex_method
from usetrail.operators import structure as st
from usetrail.operators import symbols as sy


def random_spans(rnd, start, end, depth, out):
    out.append((1, rnd.choice(["call", "block", "name", "(", "comment"]) if depth else "root",
                start, end, depth, depth == 0))
    at = start
    while depth < 5 and at < end:
        size = rnd.randrange(0, max(1, (end - at) // 2) + 1)
        if rnd.random() < 0.7 and (at, at + size) != (start, end):
            random_spans(rnd, at, min(end, at + size), depth + 1, out)
        at += size + rnd.randrange(0, 2)
        if size == 0:
            at += 1


def test_locate_equals_search(spark):
    rnd = random.Random(5)
    spans = []
    random_spans(rnd, 0, 60, 0, spans)
    df = spark.createDataFrame(
        spans, "doc int, kind string, start_pos bigint, end_pos bigint, depth int, is_root boolean"
    )
    points = spark.range(0, 62).select(F.lit(1).alias("doc"), F.col("id").alias("pos"))
    got = {r["pos"]: (r["size"], r["depth"], r["start_pos"])
           for r in st.locate(points, df, ["doc"], bin_width=8).collect()}
    for pos in range(62):
        fits = [(e - s, d, s) for _, k, s, e, d, root in spans
                if s <= pos <= e and (root or k not in ("(", "comment"))]
        assert got.get(pos) == (min(fits) if fits else None)


def test_shared_edge_goes_to_the_smaller_then_left(spark):
    df = spark.createDataFrame(
        [(1, "root", 0, 9, 0, True), (1, "a", 0, 4, 1, False), (1, "b", 4, 6, 1, False),
         (1, "c", 6, 8, 1, False)],
        "doc int, kind string, start_pos bigint, end_pos bigint, depth int, is_root boolean",
    )
    points = spark.createDataFrame([(1, 4), (1, 6), (1, 9)], "doc int, pos bigint")
    got = {r["pos"]: r["kind"] for r in st.locate(points, df, ["doc"]).collect()}
    assert got == {4: "b", 6: "b", 9: "root"}


def test_pair_spans_with_stray_and_unclosed(spark, cutting):
    rows = [(1, i, t.strip("/"), not t.startswith("/")) for i, t in
            enumerate(["/li", "ul", "li", "/li", "ul", "/ul", "/ul", "/ul", "li", "li", "/li"])]
    df = spark.createDataFrame(rows, "page_id int, pos bigint, tag string, is_open boolean")
    for bounded in (True, False):
        got = {(r["kind"], r["start_pos"], r["end_pos"])
               for r in st.pair_spans(df, bounded=bounded).collect()}
        assert got == {("ul", 1, 6), ("li", 2, 3), ("ul", 4, 5), ("li", 8, None), ("li", 9, 10)}


def test_ancestors_stop_kinds_and_depth_guard(spark):
    nodes = spark.createDataFrame(
        [("a", None, "file"), ("b", "a", "function"), ("c", "b", "go"), ("d", "c", "block"),
         ("e", "d", "name")], "node_id string, parent_id string, kind string",
    )
    pairs = {(r["node_id"], r["ancestor"], r["distance"]) for r in st.ancestors(nodes, 4).collect()}
    assert ("e", "a", 4) in pairs and len(pairs) == 10
    near = st.nearest_ancestor(nodes, ["function"], 4, stop=["go"], start=F.col("node_id") == "e")
    assert near.first()["nearest"] is None
    near = st.nearest_ancestor(nodes, ["function"], 4, start=F.col("node_id") == "e")
    assert near.first()["nearest"] == "b"
    try:
        st.ancestors(nodes, 2).collect()
    except Exception as error:
        assert "deeper than max_depth" in str(error)
    else:
        raise AssertionError("a deeper tree must stop the job")


def test_zip_falls_back_to_first_then_whole(spark):
    left = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "g int, ordinal bigint, t string")
    right = spark.createDataFrame([(1, 0, "x")], "g int, ordinal bigint, t string")
    whole = spark.createDataFrame([(2, "w")], "g int, t string")
    got = {r["left_value"]: r["right_value"]
           for r in st.zip_ordinal(left, right, ["g"], "t", "t", whole).collect()}
    assert got == {"a": "x", "b": "x", "c": "w"}


def test_shadowing(spark, cutting):
    scopes = spark.createDataFrame(
        [(1, 0, 0, 0, 100), (1, 1, 1, 10, 50), (1, 2, 2, 20, 40)],
        "doc int, scope_id bigint, depth int, start_pos bigint, end_pos bigint",
    )
    decls = spark.createDataFrame(
        [(1, "x", 5, 0, 6), (1, "x", 22, 2, 25)],
        "doc int, name string, decl_id bigint, scope_id bigint, visible_from bigint",
    )
    uses = spark.createDataFrame(
        [(1, "x", p) for p in (2, 15, 23, 30, 45, 90)] + [(1, "y", 30)],
        "doc int, name string, pos bigint",
    )
    got = {r["pos"]: r["decl_id"] for r in sy.resolve_scoped(uses, decls, scopes, ["doc"]).collect()}
    # 23 stands in the inner declaration's own statement, so it means the outer one
    assert got == {15: 5, 23: 5, 30: 22, 45: 5, 90: 5}


def test_short_declaration_counts_once_per_scope(spark, cutting):
    rows = [(1, "short_var_declaration", "x", 1, False), (1, "short_var_declaration", "x", 2, False),
            (1, "var_spec", "x", 3, False), (2, "short_var_declaration", "x", 4, False),
            (2, "range_clause", "k", 5, True), (2, "range_clause", "k", 6, False),
            (2, "call_expression", "x", 7, False)]
    df = spark.createDataFrame(rows, "scope int, kind string, name string, pos bigint, declares boolean")
    got = sorted(r["pos"] for r in sy.extract_decls(df, ["scope"]).collect())
    assert got == [1, 3, 4, 5]


def test_uses_by_name_prefers_the_chosen_declaration(spark):
    decls = spark.createDataFrame([("f", 1, 10), ("f", 2, 20), ("g", 3, 30)], "name string, pos int, id int")
    uses = spark.createDataFrame([("f", 7), ("g", 8)], "name string, at int")
    got = {r["name"]: r["decl_id"] for r in sy.resolve_by_name(uses, decls, ["name"], ["pos"], "id").collect()}
    assert got == {"f": 10, "g": 30}
    chosen = spark.createDataFrame([("f", 20)], "name string, id int")
    got = {r["name"]: r["decl_id"]
           for r in sy.resolve_by_name(uses, decls, ["name"], ["pos"], "id", chosen).collect()}
    assert got == {"f": 20, "g": 30}


def test_call_names_and_clipping(spark):
    df = spark.createDataFrame(
        [("atomic", "AddInt64"), ("atomic", "Frob"), ("mu", "Wait"), ("mu", "Go")], "pkg string, fn string"
    )
    got = df.select(is_atomic_name(F.col("pkg"), F.col("fn")), is_mutex_method(F.col("fn"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, False)]
    calls = spark.createDataFrame([(" append ",), ("fmt.Println",), ("len",), (None,)], "c string")
    assert [r[0] for r in calls.select(is_heavy_call(F.col("c"))).collect()] == [True, True, False, False]
    text = spark.createDataFrame([("abcdef",), ("abc",)], "t string").select(clipped(F.col("t"), 4))
    assert [r[0] for r in text.collect()] == ["abcd\n...[truncated 2 chars]", "abc"]
