"""What a task holds and what is shuffled follow from the plan, whatever the size."""

import datetime as dt
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pyspark.sql import functions as F

from usetrail import session
from usetrail.plans import intervals
from usetrail.queries import code_q, structure_q, symbols_q
from usetrail.sources import nodes as sn
from usetrail.sources import views as v
from usetrail.streaming import streams


def plan_of(df):
    """The plan as text, before anything ran."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan_of(df)))


def test_texts_are_spread_into_parts_of_bounded_bytes(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "some words here " * 10) for i in range(60)], "doc_id int, text string")
    monkeypatch.setattr(session, "PART_BYTES", 1000)
    words = v.word_view(texts)
    assert words.rdd.getNumPartitions() == 10  # 9,600 bytes
    assert words.count() == 60 * 30
    assert exchanges(words) == 1
    assert session.spread(texts.filter("doc_id < 0"), "doc_id", "text").count() == 0


def test_keys_are_counted_without_copies(spark, tmp_path):
    rows = [(1, "a b a\nb"), (1, "a b a\nb"), (None, "x"), (2, "")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = structure_q.make_keys(spark, str(tmp_path))
    assert "Expand" not in plan_of(made)
    got = {r["doc_id"]: (r["n_keys"], r["first_key"], r["n_ranges"], r["last_range"]) for r in made.collect()}
    assert got == {1: (4, "use:a:0:0:1", 4, "1:0:1:1"), None: (1, "use:x:0:0:1", 1, "0:0:0:1")}


def test_nodes_stay_where_their_page_is(spark):
    html = "<a>x</a><h1>f g</h1><p>one two three</p><b>go</b><p>a b c d e f g h i j k l</p>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id int, html string")
    nodes = sn.page_nodes(pages)
    assert exchanges(nodes) == 1
    kinds = sn.with_kinds(nodes)
    assert exchanges(kinds) == 1
    by_id = {(r["doc_id"], r["node_id"]): r for r in nodes.collect()}
    assert len(by_id) == nodes.count() and {k[0] for k in by_id} == {1, 3}
    for r in kinds.collect():
        up = by_id.get((r["doc_id"], r["parent_id"]))
        top = up and by_id.get((r["doc_id"], up["parent_id"]))
        assert (r["parent_kind"], r["parent_field"]) == ((up["kind"], up["field"]) if up else (None, None))
        assert r["grand_kind"] == (top["kind"] if top else None)


def test_best_span_of_a_document_is_found_in_place(spark):
    rnd = random.Random(5)
    spans = [(d, s, s + rnd.choice([-1, 0, 2, 30, 300]), rnd.randrange(3)) for d in (1, 2) for s in (rnd.randrange(300) for _ in range(60))]
    points = [(d, rnd.randrange(-3, 400)) for d in (1, 2, 3) for _ in range(80)] + [(1, 7), (1, 7), (None, 3), (1, None)]
    spread = spark.createDataFrame(points, "doc int, pos bigint").repartition(3, "doc")
    found = intervals.best_containing(
        spread, spark.createDataFrame(spans, "doc int, start_pos bigint, end_pos bigint, rank int"), ["doc"],
        F.struct("rank", "start_pos", "end_pos"), bounded=True,
    )
    want = Counter()
    for d, p in points:
        held = [(x[3], x[1], x[2]) for x in spans if x[0] == d and p is not None and x[1] <= p <= x[2]]
        if held:
            want[(d, p, *min(held))] += 1
    assert Counter(tuple(r) for r in found.select("doc", "pos", "best.*").collect()) == want
    assert "_cell" not in plan_of(found)


def test_words_are_resolved_where_their_text_is(spark, tmp_path):
    rows = [(1, "a b a\nb a, c"), (2, "x\nx x"), (2, "x\nx x"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = symbols_q.resolve_scoped(spark, str(tmp_path))
    shuffled = [x for x in plan_of(made).splitlines() if re.search(r"\bExchange hashpartitioning", x)]
    # by document only, never by name or scope
    assert shuffled and all(re.search(r"hashpartitioning\((doc_id|_groupingexpression)#\w+, ", x) for x in shuffled if "name#" in x or "scope" in x)
    got = {(r["doc_id"], r["same_line"]): r["n"] for r in made.collect()}
    assert got == {(1, True): 1, (1, False): 1, (2, True): 2, (2, False): 2}
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    at = {(r["doc_id"], r["pos"]): (r["name"], r["decl_id"], r["n_uses"]) for r in symbols_q.symbol_at(spark, str(tmp_path)).collect()}
    line = 1 << 20
    assert at == {
        (1, 0): ("a", 0, 1), (1, 1): ("b", 1, 0), (1, 2): ("a", 0, 1), (1, line): ("b", line, 0), (1, line + 2): ("c", line + 2, 0),
        (2, 0): ("x", 0, 0), (2, line): ("x", line, 1), (2, line + 1): ("x", line, 1),
    }
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_keys_of_a_stream_share_groups(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(k % 40 or None, day + dt.timedelta(minutes=k % 7), k, k % 3 == 0) for k in range(400)]
    spark.createDataFrame([*rows, (99, day + dt.timedelta(days=1), 500, True)], "key int, ts timestamp, seq int, put boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("key int, ts timestamp, seq int, put boolean").parquet(f"{tmp_path}/in")

    def apply(state, pos, number, put):
        return (state[0] + 1,), state[0]

    counted = streams._in_order(src, "key", "ts", "1 hour", "seq", "put", {"n": "int"}, (0,), "before int", apply, buckets=3)
    got = {(r["key"], r["seq"]): r["before"] for r in streams.run_to_table(counted, f"{tmp_path}/out").collect()}
    want, seen = {}, Counter()
    for k, _, number, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k, number], seen[k] = seen[k], seen[k] + 1
    assert got == want and "_bucket" in counted._jdf.queryExecution().analyzed().toString()


def test_tables_written_by_document_meet_without_a_shuffle(spark, capsys):
    from usetrail.plans.scan import together
    rows = spark.createDataFrame([(d, i) for d in range(5) for i in range(3)], "doc_id int, n int")
    with session.in_place(spark, 3):
        whole = session.staged(rows, "whole", "doc_id")
        halves = session.gathered([rows.filter("n = 0"), rows.filter("n > 0")], "halves", "doc_id")
        both = together(whole, halves.withColumnRenamed("n", "m").filter("doc_id < 4"), ["doc_id"])
        found = both.join(halves.hint("merge"), ["doc_id", "n"]).groupBy("doc_id").count()
        found.explain()
        assert "Exchange hashpartitioning" not in capsys.readouterr().out
        assert sorted(map(tuple, found.collect())) == [(d, 3) for d in range(5)]
    asked = sorted((r.doc_id, r.m) for r in both.filter("n IS NULL").collect())
    assert asked == [(d, i) for d in range(4) for i in range(3)] and both.count() == 27


def test_the_graph_of_a_program_is_made_where_its_nodes_are(spark, tmp_path, capsys, monkeypatch):
    html = "<a>x y</a><h1>x</h1><p>f x x x x x x</p><p>go f a</p><p>x y z b</p><p>ch x a a a a a a a a a a</p><a>x</a><p>x x x x x x</p>"
    rows = [(1, html), (2, html.replace("x", "long")), (2, "<a>q</a><p>q</p>"), (3, None), (None, html)]
    spark.createDataFrame(rows, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plans, graph_of = [], code_q.graph.code_graph

    def seen(*given):
        made = graph_of(*given)
        for part in made:
            part.explain()
            plans.append(capsys.readouterr().out)
        return made

    monkeypatch.setattr(code_q.graph, "code_graph", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["page_id"], r["part"], r["type"]): r["n"] for r in code_q.code_graph(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and all("Join" in p and "Exchange" not in p for p in plans)
    assert got[1, "node", "Variable"] == got[1, "edge", "Use"] + 3 and got[1, "node", "Function"] == 1
    # pages of one id are one program
    assert got[2, "node", "Variable"] > got[1, "node", "Variable"]


def test_only_texts_are_shuffled_and_words_sorted_once(spark, tmp_path, monkeypatch):
    rows = [(i, "a b a\nb a, c\n" * 20) for i in range(40)]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(session, "PART_BYTES", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = symbols_q.resolve_scoped(spark, str(tmp_path))
        plan = plan_of(made)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if re.search(r"\bExchange\b", x)]
    # texts, and what is counted of a document
    assert moved and all("REPARTITION_BY_NUM" in x or "_groupingexpression" in x for x in moved)
    # the words for their declarations; what else is sorted are lists of whole documents
    sorts = [x for x in plan.splitlines() if re.search(r"\bSort \[", x)]
    assert len([x for x in sorts if "word#" in x]) == 1
    assert all(re.search(r"Sort \[doc_id#\w+ ASC NULLS FIRST\],", x) for x in sorts if "word#" not in x)
    # in a line of a text `a` comes again once; in other lines all come again but for the first two lines
    assert {(r["same_line"], r["n"]) for r in made.collect()} == {(True, 20), (False, 19 * 5 + 1)}


def test_scopes_and_entries_of_words(spark):
    rows = [(1, "a b a\nb"), (2, "x"), (2, "x"), (None, "y"), (3, None), (4, ""), (5, " \n\n  ")]
    lines = v.line_view(spark.createDataFrame(rows, "doc_id int, text string"))
    words, line = v.words_in(lines), 1 << 20
    scopes = symbols_q.word_scopes(lines)
    assert sorted(map(tuple, scopes.collect()), key=repr) == sorted([
        (1, "doc", 0, 0, 0, line), (1, "line", 1, 1, 0, 2), (1, "line", 2, 1, line, line), (2, "doc", 0, 0, 0, 0), (2, "line", 1, 1, 0, 0),
        (None, "doc", 0, 0, 0, 0), (None, "line", 1, 1, 0, 0)], key=repr)
    assert [t for _, t in scopes.dtypes] == ["int", "string", "int", "int", "bigint", "bigint"]
    entries = symbols_q.word_timeline(words)
    assert [t for _, t in entries.dtypes] == ["int", "string", "bigint", "int", "int", "bigint", "bigint", "bigint"]
    declared = Counter((r["doc_id"], r["name"], r["scope_id"], r["pos"], r["decl"]) for r in entries.collect() if not r["is_use"])
    assert declared == Counter({
        (1, "a", 0, 1, 0): 1, (1, "a", 1, 1, 0): 1, (1, "b", 0, 2, 1): 1, (1, "b", 1, 2, 1): 1, (1, "b", 2, line + 1, line): 1,
        (2, "x", 0, 1, 0): 2, (2, "x", 1, 1, 0): 2, (None, "y", 0, 1, 0): 1, (None, "y", 1, 1, 0): 1})
    assert Counter((r["doc_id"], r["is_use"], r["depth"]) for r in entries.collect() if r["is_use"]) == Counter(
        {(d, 1, k): n for d, n in ((1, 4), (2, 2), (None, 1)) for k in (0, 1)})


def test_a_line_ends_with_its_last_word(spark):
    texts = ["a b", " a  b  ", "a", "", "   ", "\t", "a \t ", "\u00e9\u4e2d \u00e9 ", "a\u00a0 b\u00a0", "a\r\nb c\r", "\n\n x\n", "a b a\n" * 3, None]
    lines = v.line_view(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    last = v.words_in(lines).groupBy("doc_id", "line").agg(F.max("pos").alias("pos"))
    got, want = v.last_words_in(lines), sorted(map(tuple, last.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 12 and got.dtypes == last.dtypes
