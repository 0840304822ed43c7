"""Lookups by position against plain searches: crossing spans, sizes that do not grow, dense places."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from usetrail.operators import structure as st
from usetrail.operators import symbols as sy
from usetrail.plans import intervals, nested

SPAN = "doc int, kind string, start_pos bigint, end_pos bigint, depth int, is_root boolean"
LINE = 1 << 20


def grown(rnd, lines):
    """A random tree over (line, col) places; children lie in their parent, also on many lines."""
    nodes = []

    def walk(start, end, depth, parent):
        at = len(nodes)
        nodes.append({"kind": rnd.choice(["call", "name", "(", "comment"]) if depth else "root",
                      "start": start, "end": end, "depth": depth, "children": []})
        if parent is not None:
            nodes[parent]["children"].append(at)
        places = sorted(rnd.choice(lines) for _ in range(6))
        places = [p for p in places if start <= p <= end]
        if depth < 4:
            for a, b in zip(places[::2], places[1::2]):
                if (a, b) != (start, end):
                    walk(a, b, depth + 1, at)

    walk(lines[0], lines[-1], 0, None)
    return nodes


def size(node):
    (l1, c1), (l2, c2) = node["start"], node["end"]
    return c2 - c1 if l1 == l2 else (l2 - l1) * 1000 + c2 + c1


def search(nodes, at, place):
    """The recursive search: a smaller meaningful match of a child replaces the node."""
    node = nodes[at]
    if not node["start"] <= place <= node["end"]:
        return None
    best = at
    for child in node["children"]:
        found = search(nodes, child, place)
        if found is not None and size(nodes[found]) < size(nodes[best]) and nodes[found]["kind"] not in ("(", "comment"):
            best = found
    return best


def flat(place):
    return place[0] * LINE + place[1]


def test_smallest_span_on_many_lines_equals_recursive_search(spark):
    rnd = random.Random(13)
    rows, want = [], {}
    for doc in range(40):
        lines = [(line, col) for line in range(5) for col in rnd.sample(range(1500), 4)]
        lines.sort()
        nodes = grown(rnd, lines)
        rows += [(doc, n["kind"], flat(n["start"]), flat(n["end"]), n["depth"], n["depth"] == 0, size(n)) for n in nodes]
        for place in lines:
            found = search(nodes, 0, place)
            # a match that is no node of its own meaning hides what lies in it; leave such points out
            hidden = any(n["kind"] in ("(", "comment") and n["children"] and n["start"] <= place <= n["end"] for n in nodes)
            if not hidden:
                want[doc, flat(place)] = (nodes[found]["kind"], flat(nodes[found]["start"]), flat(nodes[found]["end"]), size(nodes[found]))
    df = spark.createDataFrame(rows, SPAN + ", lines_size bigint")
    points = spark.createDataFrame(list(want), "doc int, pos bigint")
    got = {(r["doc"], r["pos"]): (r["kind"], r["start_pos"], r["end_pos"], r["size"])
           for r in st.locate(points, df, ["doc"], size=F.col("lines_size")).collect()}
    assert len(want) > 100 and got == want


def crossing(rnd, docs=3, n=80, far=400):
    return [(d, rnd.choice("abc"), s, min(far, s + rnd.choice([0, 1, 3, 20, 200])), rnd.randrange(4), False)
            for d in range(docs) for s in (rnd.randrange(far) for _ in range(n))]


@pytest.mark.parametrize("growth", [2, 8])
def test_best_of_crossing_spans(spark, growth):
    rnd = random.Random(2)
    spans = crossing(rnd)
    points = [(d, rnd.randrange(-3, 410)) for d in range(4) for _ in range(150)] + [(0, 7), (0, 7), (None, 3), (1, None)]
    got = Counter(tuple(r) for r in intervals.best_containing(
        spark.createDataFrame(points, "doc int, pos bigint"), spark.createDataFrame(spans, SPAN), ["doc"],
        F.struct(F.col("depth"), F.col("start_pos"), F.col("end_pos"), F.col("kind")), growth=growth,
    ).select("doc", "pos", "best.*").collect())
    want = Counter()
    for d, p in points:
        held = [(x[4], x[2], x[3], x[1]) for x in spans if x[0] == d and p is not None and x[2] <= p <= x[3]]
        if held:
            want[(d, p, *min(held))] += 1
    assert got == want


@pytest.mark.parametrize("bounded", [True, False])
def test_first_of_crossing_spans(spark, cutting, bounded):
    rnd = random.Random(4)
    spans = crossing(rnd)
    points = [(d, rnd.randrange(-3, 410)) for d in range(4) for _ in range(60)] + [(0, 7), (0, 7), (None, 3), (1, None)]
    got = Counter(tuple(r) for r in st.outermost_enclosing(
        spark.createDataFrame(points, "doc int, pos bigint"), spark.createDataFrame(spans, SPAN), ["a", "b"], ["doc"], bounded
    ).collect())
    want = Counter()
    for d, p in points:
        held = [(x[2], -x[3], x[1]) for x in spans if x[0] == d and x[1] in "ab" and p is not None and x[2] <= p <= x[3]]
        if held:
            start, back, kind = min(held)
            want[(d, p, start, -back, kind)] += 1
    assert got == want


@pytest.mark.parametrize("bounded", [True, False])
def test_pairs_do_not_depend_on_bins(spark, cutting, bounded):
    rnd = random.Random(6)
    spans = [(d, s, e) for d, _, s, e, _, _ in crossing(rnd, n=40)] + [(0, 9, 5), (None, 1, 9), (1, None, 4)]
    points = [(d, rnd.choice([5, 6, 7, rnd.randrange(410)])) for d in range(4) for _ in range(50)] + [(None, 3), (1, None)]
    got = Counter(tuple(r) for r in intervals.containing_spans(
        spark.createDataFrame(points, "doc int, pos bigint"),
        spark.createDataFrame(spans, "doc int, start_pos bigint, end_pos bigint"), ["doc"], bounded=bounded, bin_rows=7,
    ).collect())
    want = Counter((d, p, s, e) for d, p in points for x, s, e in spans
                   if d is not None and d == x and p is not None and s is not None and s <= p <= e)
    assert got == want


def test_a_dense_end_makes_more_bins_not_fuller_ones(spark):
    points = spark.range(100_000).selectExpr("1 AS doc", "IF(id < 100, id * 1000000, 100000000 + id) AS pos")
    spans = spark.createDataFrame([(1, 0, 200_000_000)], "doc int, start_pos bigint, end_pos bigint")
    seen = {}

    def watch(plan, *names):
        seen["sizes"] = [r["n"] for r in plan.groupBy(*names).agg(F.count("*").alias("n")).collect()]

    pairs = intervals.containing_spans(points, spans, ["doc"], bounded=True)
    assert pairs.count() == 100_000
    ranked = intervals.running(points, ["doc"], ["pos"], True, _r=intervals.total(F.lit(1), exclusive=True))
    watch(ranked.withColumn("b", F.expr(f"_r div {intervals.BIN_ROWS}")), "b")
    assert max(seen["sizes"]) <= 2 * sum(seen["sizes"]) / len(seen["sizes"])


def scoped(rnd):
    """Nested scopes of one document, declarations in the innermost one, uses anywhere."""
    scopes, decls, uses = [(1, 0, 0, 0, 200)], [], []

    def walk(start, end, depth):
        at = start + 1
        while at + 8 < end and depth < 5:
            size = rnd.randrange(4, max(5, (end - at) // 2))
            scopes.append((1, len(scopes), depth, at, at + size))
            walk(at, at + size, depth + 1)
            at += size + rnd.randrange(1, 6)

    walk(0, 200, 1)
    for n in range(30):
        pos = rnd.randrange(0, 198)
        inner = max((s for s in scopes if s[3] <= pos <= s[4]), key=lambda s: s[2])
        seen = pos + 1
        if all(not (s[2] > inner[2] and s[3] <= seen <= s[4]) for s in scopes):
            decls.append((1, rnd.choice("xyz"), pos * 100 + n, inner[1], seen))
    uses = [(1, name, p) for p in range(0, 203) for name in "xyzw"]
    return scopes, decls, uses


@pytest.mark.parametrize("bounded", [True, False])
def test_scopes_equal_a_walk_outwards(spark, cutting, bounded):
    rnd = random.Random(21)
    scopes, decls, uses = scoped(rnd)
    frames = [spark.createDataFrame(*x) for x in (
        (uses, "doc int, name string, pos bigint"),
        (decls, "doc int, name string, decl_id bigint, scope_id bigint, visible_from bigint"),
        (scopes, "doc int, scope_id bigint, depth int, start_pos bigint, end_pos bigint"))]
    got = {(r["name"], r["pos"]): (r["depth"], r["decl_id"]) for r in sy.resolve_scoped(*frames, ["doc"], bounded).collect()}
    want = {}
    for _, name, pos in uses:
        for scope in sorted((s for s in scopes if s[3] <= pos <= s[4]), key=lambda s: -s[2]):
            found = [(d[4], d[2]) for d in decls if d[1] == name and d[3] == scope[1] and d[4] <= pos]
            if found:
                want[name, pos] = (scope[2], max(found)[1])
                break
    assert got == want and len({x[0] for x in want.values()}) > 2


def test_a_crossing_declaration_stops_the_job(spark):
    scopes = spark.createDataFrame([(1, 0, 0, 0, 100), (1, 1, 1, 5, 20)], "doc int, scope_id bigint, depth int, start_pos bigint, end_pos bigint")
    decls = spark.createDataFrame([(1, "x", 6, 1, 6), (1, "x", 7, 0, 10)], "doc int, name string, decl_id bigint, scope_id bigint, visible_from bigint")
    uses = spark.createDataFrame([(1, "x", 15)], "doc int, name string, pos bigint")
    with pytest.raises(Exception, match="deeper scope"):
        sy.resolve_scoped(uses, decls, scopes, ["doc"]).collect()


def listed_rows(rows, names, groups):
    return [[dict(zip(names, r[1:], strict=True)) for r in rows if r[0] == g] for g in groups]


@pytest.mark.parametrize("wide", [1, 1 << 52])
@pytest.mark.parametrize("entries", [1, 900, 1 << 20])
def test_lists_of_uses_equal_a_walk_outwards(monkeypatch, wide, entries):
    rnd = random.Random(31)
    monkeypatch.setattr(nested, "ENTRIES", entries)
    scopes, decls, uses, want = [], [], [], []
    for doc in range(6):
        some, made, asked = scoped(rnd)
        # what comes twice, has no name, no place or no scope
        some, made = [*some, some[-1], (1, None, 9, 0, 200)], [*made, *made[:5], *((1, None, 7, *made[0][3:]), (1, "x", 8, None, 3), (1, "x", 8, 0, None))]
        asked = [*asked, *asked[40:60], *((1, None, p) for p in range(0, 203, 7)), (1, "x", None)] if doc else asked
        at = lambda p: None if p is None else p * wide
        scopes += [(doc, i, d, at(e)) for _, i, d, _, e in some] if doc != 3 else [(doc, 0, 0, None)]
        decls += [(doc, n, at(v), i, s) for _, n, i, s, v in made]
        uses += [(doc, n, at(p)) for _, n, p in asked]
        for _, name, pos in asked if doc != 3 else []:
            for scope in sorted((s for s in some if s[1] is not None and pos is not None and s[3] <= pos <= s[4]), key=lambda s: -s[2]):
                found = [(d[4], d[2]) for d in made if d[1] == name and d[3] == scope[1] and d[4] is not None and d[4] <= pos]
                if found:
                    want.append((doc, name, at(pos), max(found)[1], scope[2]))
                    break
    groups = range(6)
    batch = pa.RecordBatch.from_pydict({
        "doc": list(groups), "_uses": listed_rows(uses, ["name", "pos"], groups),
        "_decls": listed_rows(decls, ["name", "pos", "decl_id", "scope_id"], groups),
        "_scopes": listed_rows(scopes, ["scope_id", "depth", "end_pos"], groups)})
    got = [tuple(r.values()) for b in nested.answered(["doc"], [batch, batch.slice(4)]) for r in b.to_pylist()]
    assert got == want + [w for w in want if w[0] > 3]
    assert {w[1] for w in want} >= {"x", None} and len({w[4] for w in want}) > 2


def test_groups_that_lack_a_table_have_no_answers(spark):
    frames = [spark.createDataFrame(*x) for x in (
        ([(1, "x", 9), (1, "x", 9), (2, "x", 9), (3, "x", 9), (None, "x", 9), (5, "x", 1)], "doc int, name string, pos bigint"),
        ([(1, "x", 4, 0, 5), (3, "x", 4, 0, 5), (None, "x", 4, 0, 5), (5, "x", 4, 0, 5)],
         "doc int, name string, decl_id int, scope_id int, visible_from int"),
        ([(1, 0, 3, 0, 9), (2, 0, 3, 0, 9), (None, 0, 3, 0, 9), (5, 0, 3, 0, 9)], "doc int, scope_id bigint, depth smallint, start_pos int, end_pos int"))]
    found = sy.resolve_scoped(*frames, ["doc"], bounded=True)
    assert [tuple(r) for r in found.collect()] == [(1, "x", 9, 4, 3)] * 2
    assert found.dtypes == [("doc", "int"), ("name", "string"), ("pos", "bigint"), ("decl_id", "bigint"), ("depth", "smallint")]


def test_a_crossing_declaration_of_a_document_stops_the_job(spark):
    scopes = spark.createDataFrame([(1, 0, 0, 0, 100), (1, 1, 1, 5, 20)], "doc int, scope_id bigint, depth int, start_pos bigint, end_pos bigint")
    decls = spark.createDataFrame([(1, "x", 6, 1, 6), (1, "x", 7, 0, 10)], "doc int, name string, decl_id bigint, scope_id bigint, visible_from bigint")
    uses = spark.createDataFrame([(1, "x", 15)], "doc int, name string, pos bigint")
    with pytest.raises(Exception, match="deeper scope that declares x"):
        sy.resolve_scoped(uses, decls, scopes, ["doc"], bounded=True).collect()
