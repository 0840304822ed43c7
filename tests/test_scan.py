"""Scans and keyed state against plain loops on random data."""

import random

from pyspark.sql import functions as F

from usetrail.operators import cache
from usetrail.plans.scan import (
    clamped_sum, following, highest, latest, lowest, previous, running, total,
)


def timeline(seed, n=120, keys=3, span=400):
    rnd = random.Random(seed)
    rows = [
        (rnd.choice(["hot"] * 4 + [f"k{i}" for i in range(keys)]), rnd.randrange(span), i,
         rnd.choice([1, -1]))
        for i in range(n)
    ]
    return sorted(rows, key=lambda r: (r[0], r[1], r[2]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, pos bigint, seq bigint, delta bigint")


def groups(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_clamped_sum_equals_loop(spark, cutting):
    rows = timeline(1)
    got = {
        r["seq"]: (r["depth"], r["depth_before"])
        for r in clamped_sum(frame(spark, rows), ["key"], ["pos", "seq"], "delta").collect()
    }
    for members in groups(rows).values():
        depth = 0
        for _, _, seq, delta in members:
            after = max(0, depth + delta)
            assert got[seq] == (after, depth)
            depth = after


def test_running_equals_loop(spark, cutting):
    rows = timeline(2)
    out = running(
        frame(spark, rows), ["key"], ["pos", "seq"],
        s=total(F.col("delta")), before=total(F.lit(1), exclusive=True), lo=lowest(F.col("seq")),
        hi=highest(F.col("seq")), last_up=latest(F.when(F.col("delta") > 0, F.col("seq"))),
        prev=previous(F.col("seq")), nxt=following(F.col("seq")),
    )
    got = {r["seq"]: r for r in out.collect()}
    for members in groups(rows).values():
        seqs = [m[2] for m in members]
        for i, (_, _, seq, _) in enumerate(members):
            r = got[seq]
            ups = [m[2] for m in members[: i + 1] if m[3] > 0]
            assert r["s"] == sum(m[3] for m in members[: i + 1])
            assert (r["before"], r["lo"], r["hi"]) == (i, min(seqs[: i + 1]), max(seqs[: i + 1]))
            assert r["last_up"] == (ups[-1] if ups else None)
            assert r["prev"] == (seqs[i - 1] if i else None)
            assert r["nxt"] == (seqs[i + 1] if i + 1 < len(seqs) else None)


def test_hits_without_refresh_equal_loop(spark, cutting):
    for seed, ttl in ((3, 40), (4, 7), (5, 150)):
        rows = timeline(seed, n=200)
        out = cache.asof_hit(frame(spark, rows), ["key"], ["pos", "seq"], ttl)
        got = {r["seq"]: r["hit"] for r in out.collect()}
        assert len(got) == len(rows)
        for members in groups(rows).values():
            put = None
            for _, pos, seq, _ in members:
                hit = put is not None and pos - put <= ttl
                assert got[seq] == hit, (seed, pos)
                put = put if hit else pos


def test_hits_with_refresh_equal_loop(spark, cutting):
    rows = timeline(6)
    out = cache.refreshing_hit(
        frame(spark, rows), ["key"], ["pos", "seq"], F.col("delta") > 0, 30
    )
    got = {r["seq"]: r["hit"] for r in out.collect()}
    for members in groups(rows).values():
        touched = None
        for _, pos, seq, delta in members:
            if delta > 0:
                touched = pos
                continue
            hit = touched is not None and pos - touched <= 30
            assert got[seq] == hit
            touched = pos if hit else None


def test_debounce_equals_timer_loop(spark, cutting):
    rows = timeline(7)
    out = cache.debounce(frame(spark, rows), ["key"], ["pos", "seq"], 25, F.col("delta"))
    got = {(r["seq"], r["fires_at"]) for r in out.collect()}
    want = set()
    for members in groups(rows).values():
        waiting, last = None, None
        for _, pos, seq, delta in members:
            if waiting and pos >= waiting[1]:
                want.add(waiting)
                waiting = None
            if delta == last:
                continue
            last, waiting = delta, (seq, pos + 25)
        if waiting:
            want.add(waiting)
    assert got == want


def test_hand_written_expiry_and_burst(spark):
    def hits(fn, rows, *args):
        df = spark.createDataFrame(rows, "key string, pos bigint, seq bigint, op string")
        return [r["hit"] for r in fn(df, ["key"], ["pos", "seq"], *args).orderBy("pos").collect()]

    ops = [("d", 0, 0, "put")] + [("d", p, i, "get") for i, p in enumerate((200, 450, 800, 810), 1)]
    assert hits(cache.refreshing_hit, ops, F.col("op") == "put", 300) == [True, True, False, False]
    reqs = [("d", p, i, "get") for i, p in enumerate((0, 200, 350, 600))]
    assert hits(cache.asof_hit, reqs, 300) == [False, True, False, True]
    moves = [("u", 0, 0, "a"), ("u", 100, 1, "b"), ("u", 500, 2, "c"), ("u", 600, 3, "c")]
    df = spark.createDataFrame(moves, "key string, pos bigint, seq bigint, op string")
    fired = cache.debounce(df, ["key"], ["pos", "seq"], 300, F.col("op")).orderBy("pos").collect()
    assert [(r["pos"], r["fires_at"]) for r in fired] == [(100, 400), (500, 800)]


def test_recent_and_live(spark):
    df = spark.createDataFrame([("a", 0), ("b", 100), ("c", 301), ("a", 50)], "key string, pos bigint")
    assert [r["pos"] for r in cache.keep_recent(df, ["pos"], 2).collect()] == [301, 100]
    live = cache.ttl_live(df, ["key"], "pos", F.lit(350), 300)
    assert {r["key"] for r in live.collect()} == {"a", "b", "c"}  # age 300 still lives
    assert {r["key"] for r in cache.ttl_live(df, ["key"], "pos", F.lit(351), 300).collect()} == {"b", "c"}
