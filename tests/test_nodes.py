"""Node tables, their graph, and range clauses."""

from pyspark.sql import functions as F
from test_code import INT, assign, call, field, frame, func, go, n, name, sel

from usetrail.operators import graph, structure
from usetrail.plans import code_facts, resolve
from usetrail.sources import nodes as nd


def test_nested_spans_are_numbered_and_linked(spark, cutting):
    spans = spark.createDataFrame(
        [(1, "root", None, 0, 90, 0, None), (1, "a", "x", 0, 40, 1, None), (1, "c", None, 0, 1, 2, "t"),
         (1, "d", None, 5, 40, 2, None), (1, "b", None, 50, 60, 1, None), (2, "root", None, 0, 9, 0, None), (None, "root", None, 3, 4, 0, None)],
        "doc_id bigint, kind string, field string, start_pos bigint, end_pos bigint, depth int, text string")
    for bounded in (True, False):
        got = {(r.doc_id, r.node_id): (r.kind, r.parent_id, r.ordinal) for r in nd.node_table(spans, bounded).collect()}
        assert got == {(1, 0): ("root", None, 0), (1, 1): ("a", 0, 0), (1, 2): ("c", 1, 0), (1, 3): ("d", 1, 1),
                       (1, 4): ("b", 0, 1), (2, 0): ("root", None, 0), (None, 0): ("root", None, 0)}


def test_pages_without_tags_or_text(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p></p><a>  </a><h1>"), (4, "<p>go")], "page_id bigint, html string")
    rows = nd.page_nodes(pages).collect()
    kinds = {d: sorted(r.kind for r in rows if r.doc_id == d) for d in (2, 3, 4)}
    assert kinds[2] == kinds[3] == ["block", "function_declaration", "source_file"]
    assert "short_var_declaration" in kinds[4]


def counted(spark, *children):
    nodes = frame(spark, *children)
    found = code_facts.call_sites(nodes).filter("is_sync_call")
    made, edges = graph.code_graph(nodes, found)
    return (
        {r[0]: r[1] for r in made.groupBy("entity_type").count().collect()},
        {r[0]: r[1] for r in edges.groupBy("edge_type").count().collect()}, made, edges,
    )


def test_graph_of_a_program(spark):
    var = n("var_spec", name("x", "name"), n("channel_type", field="type"))
    made, edges, nodes, links = counted(
        spark, var,
        func("run", call(sel("mu", "Lock")), go(call(name("x"))), assign(name("x"), name("y")),
             n("send_statement", name("x", "channel"), name("z", "value")),
             n("unary_expression", n("<-", field="operator", text="<-"), name("x", "operand")),
             n("unary_expression", n("-", field="operator", text="-"), name("x", "operand"))),
    )
    assert made == {"Variable": 6, "Function": 1, "Goroutine": 1, "Channel": 1}
    assert edges == {"Use": 5, "Call": 3, "Sync": 1, "Send": 1, "Receive": 1, "Spawn": 1}
    assert graph.bad_types(nodes, links).count() == 0
    starts = links.filter("edge_type = 'Use'").select(F.col("from_id").alias("id")).distinct()
    assert starts.join(nodes, "id", "left_anti").count() == 0


def test_a_later_declaration_takes_over_in_the_graph(spark):
    _, _, _, edges = counted(
        spark, n("var_spec", name("x", "name")), call(name("f"), name("x")), n("var_spec", name("x", "name")), call(name("f"), name("x")))
    assert edges.filter("edge_type = 'Use'").select("from_id").distinct().count() == 2


def ranged(sign, value):
    return n("range_clause", n("expression_list", name("k"), field="left"), n(sign), value)


def test_a_range_clause_declares_by_its_own_sign(spark):
    inner = n("func", text="func() { y := 1 }")
    nodes = frame(spark, func("run", n("for_statement", ranged("=", inner)), n("for_statement", ranged(":=", name("xs")))))
    rows = code_facts.occurrences(nodes).filter("name = 'k'").orderBy("pos").collect()
    assert [(r.declares, r.reassign) for r in rows] == [(False, True), (True, True)]
    found = code_facts.declarations(code_facts.occurrences(nodes), nodes).filter("name = 'k'")
    assert found.count() == 1


def test_symbols_by_position_cover_variables_and_fields(spark):
    nodes = frame(
        spark, n("struct_type", field("count", INT())),
        func("run", assign(name("x"), name("a"), "short_var_declaration"), assign(sel("s", "count"), name("x")),
             assign(name("x"), sel("s", "count"))),
    )
    at = {(r.kind, r.text): [] for r in nodes.filter("text IS NOT NULL").collect()}
    for r in nodes.filter("text IS NOT NULL").orderBy("start_pos").collect():
        at[r.kind, r.text].append(r.start_pos)
    points = nodes.select("doc_id", F.col("start_pos").alias("pos")).distinct()
    got = {r.pos: (r.name, r.decl_id, r.n_uses) for r in resolve.code_symbol_at(points, nodes).collect()}
    x, count = at["identifier", "x"], at["field_identifier", "count"]
    assert got == {p: ("x", x[0], 2) for p in x} | {p: ("count", count[0], 2) for p in count}


def test_a_chain_of_any_depth_has_its_ancestors(spark):
    chain = spark.range(1000).selectExpr("1 AS tree", "id AS node_id", "IF(id = 0, NULL, id - 1) AS parent_id", "IF(id = 3, 'f', 'x') AS kind")
    near = structure.nearest_ancestor(chain, ["f"], None, tree=["tree"], start=F.col("node_id") == 999).first()
    assert near["nearest"] == 3
    pairs = structure.ancestors(chain, tree=["tree"])
    assert pairs.count() == 1000 * 999 // 2
    last = pairs.filter("node_id = 999").orderBy("distance").collect()
    assert [(r.ancestor, r.distance) for r in last] == [(998 - i, i + 1) for i in range(999)]


def test_unbounded_paths_equal_bounded_ones(spark):
    rows = [(t, i, None if i == 0 else (i - 1) // 2, "x") for t in range(3) for i in range(40)] + [(7, 1, 99, "x")]
    nodes = spark.createDataFrame(rows, "tree int, node_id bigint, parent_id bigint, kind string")
    a, b = (sorted(tuple(r) for r in structure.ancestors(nodes, d, tree=["tree"]).collect()) for d in (None, 6))
    assert a == b and len(a) > 300
    circle = spark.createDataFrame([(1, 2, "x"), (2, 1, "x")], "node_id bigint, parent_id bigint, kind string")
    try:
        structure.ancestors(circle)
    except ValueError as error:
        assert "circle" in str(error)
    else:
        raise AssertionError("a circle must stop the job")
