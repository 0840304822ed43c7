"""Inputs the tables do not hold: NULLs, unclosed tags, late files, bunched keys."""

import datetime as dt

from pyspark.sql import functions as F

from usetrail.operators import cache, rules, structure
from usetrail.plans.scan import CHUNK, clamped_sum, highest, running, total, with_chunks
from usetrail.streaming import streams


def test_null_positions_and_keys_run_like_others(spark, cutting):
    rows = [("a", None if i == 4 else i, i, 1) for i in range(13)] + [(None, i, 100 + i, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "key string, pos bigint, seq bigint, delta bigint").repartition(3)
    out = running(df, ["key"], ["pos", "seq"], s=total(F.col("delta")), hi=highest(F.col("seq"))).collect()
    assert sorted(r["s"] for r in out if r["key"] == "a") == list(range(1, 14))
    assert next(r["s"] for r in out if r["seq"] == 4) == 1
    assert sorted(r["s"] for r in out if r["key"] is None) == list(range(1, 10))
    deep = clamped_sum(df, ["key"], ["pos", "seq"], "delta").collect()
    assert sorted(r["depth"] for r in deep if r["key"] is None) == list(range(1, 10))


def test_bunched_and_wide_positions_are_cut_by_rows(spark, cutting):
    df = spark.range(4000).select(
        F.lit("k").alias("key"), F.when(F.col("id") < 3900, F.col("id") % 7 - 4 * 10**18).otherwise(F.col("id") * 10**15).alias("pos"),
        F.col("id").alias("seq"),
    )
    cut = with_chunks(df, ["key"], ["pos", "seq"])
    sizes = [r["count"] for r in cut.groupBy(CHUNK).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = running(df, ["key"], ["pos", "seq"], n=total(F.lit(1))).agg(F.countDistinct("n"), F.max("n")).first()
    assert tuple(got) == (4000, 4000)


def test_parents_of_unclosed_and_stray_tags(spark):
    def tokens(text):
        rows = [(1, i, t.strip("/"), not t.startswith("/")) for i, t in enumerate(text.split())]
        return spark.createDataFrame(rows, "page_id bigint, pos bigint, tag string, is_open boolean")

    def parent(text):
        return {r["pos"]: r["parent_pos"] for r in structure.parents(structure.nesting(tokens(text))).collect()}

    assert parent("div li /div ul a /a /ul") == {0: None, 1: 0, 3: None, 4: 3}
    assert parent("div /p p /p /b ul /ul /div") == {0: None, 2: 0, 5: 0}


def test_points_with_nulls_keep_their_answer(spark, cutting):
    points = spark.createDataFrame(
        [(1, 5, None), (1, 5, None), (1, 20, "x"), (None, 5, "y"), (1, None, "z"), (2, 5, "w")],
        "ctx bigint, pos bigint, note string",
    )
    sections = spark.createDataFrame([(1, 0, 30), (1, 2, 6), (None, 0, 9), (2, 6, 9), (2, 0, None)], "ctx bigint, start_pos bigint, end_pos bigint")
    out = rules.in_concurrent(points, sections, ["ctx"]).collect()
    assert sorted(str(r["note"]) for r in out if r["concurrent"]) == ["None", "None", "x"]
    assert len(out) == 6
    spans = spark.createDataFrame(
        [(1, "field", 0, 30), (1, "stop", 2, 6), (1, "field", 3, 4), (1, "other", 3, 9)], "ctx bigint, kind string, start_pos bigint, end_pos bigint"
    )
    asked = spark.createDataFrame([(1, p, None) for p in (0, 2, 3, 4, 5, 6, 7, 30, 31)] + [(None, 1, "n"), (1, None, "n")], "ctx bigint, pos bigint, note string")
    found = rules.is_field_decl(asked, spans, ["ctx"], ["field"], ["stop"]).collect()
    assert {r["pos"] for r in found if r["is_field"]} == {0, 3, 4, 7, 30} and len(found) == 11


def late_stream(spark, tmp_path, files, schema):
    """The rows of each file, one file a trigger, in the order given."""
    import glob
    import os
    import shutil
    import time

    os.mkdir(f"{tmp_path}/in")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        (part,) = glob.glob(f"{tmp_path}/w{i}/part-*.parquet")
        shutil.copy(part, f"{tmp_path}/in/rows-{i}.parquet")
        os.utime(f"{tmp_path}/in/rows-{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    read = spark.read.parquet(f"{tmp_path}/in").schema
    return streams.table_stream(spark, f"{tmp_path}/in", "rows", read, "ts", files_per_trigger=1)


def test_hits_and_repeats_of_a_stream_take_late_rows_where_they_belong(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 10)
    at = lambda m, s, put: ("k", day + dt.timedelta(minutes=m), s, put)
    files = [[at(0, 1, True), at(8, 3, False)], [at(4, 2, False), at(20, 4, False), at(21, 5, False)],
             [at(22, 6, True), at(22, 7, False), ("z", day + dt.timedelta(days=2), 8, True)]]
    src = late_stream(spark, tmp_path, files, "key string, ts timestamp, seq bigint, put boolean")
    hits = streams.run_to_table(streams.stream_hits(src, "key", "ts", "seq", "put", 300_000_000, "1 hour"), f"{tmp_path}/hits")
    # the late get at minute 4 refreshes the entry, so the one at minute 8 hits
    assert [(r["seq"], r["hit"]) for r in hits.orderBy("seq").collect()] == [(2, True), (3, True), (4, False), (5, False), (7, True)]
    moves = streams.run_to_table(streams.stream_repeats(src, "key", "ts", "seq", "put", "1 hour"), f"{tmp_path}/moves")
    assert [(r["seq"], r["changed"]) for r in moves.orderBy("seq").collect()] == [(1, True), (2, False), (6, True), (7, False)]


def test_debounce_stream_takes_late_rows_where_they_belong(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    files = [[(10, 0, "a"), (10, 20, "b")], [(10, 10, "c")], [(14, 0, "z")]]
    for i, rows in enumerate(files):
        made = [("k", day + dt.timedelta(hours=h, minutes=m), v) for h, m, v in rows]
        spark.createDataFrame(made, "key string, ts timestamp, value string").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
    import glob
    import os
    import shutil
    import time

    os.mkdir(f"{tmp_path}/in")
    for i in range(3):
        (part,) = glob.glob(f"{tmp_path}/w{i}/part-*.parquet")
        shutil.copy(part, f"{tmp_path}/in/rows-{i}.parquet")
        os.utime(f"{tmp_path}/in/rows-{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    src = streams.table_stream(spark, f"{tmp_path}/in", "rows", schema, "ts", files_per_trigger=1)
    fired = streams.run_to_table(streams.stream_debounce(src, "key", "ts", "value", 300_000, "1 hour"), f"{tmp_path}/out")
    assert [r["value"] for r in fired.orderBy("pos").collect()] == ["a", "c", "b"]


def test_locks_and_group_findings_of_a_stream_take_late_rows_where_they_belong(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 10)
    at = lambda m, s, lock=None, delta=None: ("k", day + dt.timedelta(minutes=m), s, lock, delta, s % 2 == 0)
    files = [[at(0, 1, "a", 1), at(5, 3), at(9, 5)], [at(8, 4, "a", -1), at(5, 6, "b", 1), at(6, 2, "c", -1), at(12, 8)],
             [("z", day + dt.timedelta(days=2), 9, None, None, None)]]
    src = late_stream(spark, tmp_path, files, "key string, ts timestamp, seq bigint, lock string, delta int, flag boolean")
    held = streams.run_to_table(
        streams.stream_held(src, ["key"], "ts", "seq", "lock", "delta", ["flag"], "1 hour"), f"{tmp_path}/held"
    )
    # the event at the time of use 3 comes before it; the release of a free lock counts for nothing
    assert [(r["seq"], r["held_keys"], r["flag"]) for r in held.orderBy("pos").collect()] == [(3, 2, False), (5, 1, False), (8, 1, True)]
    uses = src.filter("lock IS NULL")
    rules = {2: (["key"], "flag", False), 7: (["key"], "flag", True)}
    found = streams.run_to_table(streams.stream_group_findings(uses, "ts", "seq", rules, "1 hour"), f"{tmp_path}/found")
    due = int((day + dt.timedelta(minutes=12)).replace(tzinfo=dt.UTC).timestamp() * 1_000_000)
    rows = found.orderBy("rule_id").collect()
    assert [(r["rule_id"], r["found"], r["pos"]) for r in rows] == [(2, 3, due), (7, 3, due)]
    # a group that begins with the flag has no row before it, but both kinds
    turned = uses.withColumn("flag", ~F.col("flag"))
    found = streams.run_to_table(streams.stream_group_findings(turned, "ts", "seq", rules, "1 hour"), f"{tmp_path}/turned")
    assert [(r["rule_id"], r["found"]) for r in found.collect()] == [(2, 8)]


def test_recent_entries_of_a_stream_equal_the_batch_form(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    files = [[(k, day + dt.timedelta(hours=h)) for k, h in part]
             for part in ([("a", 1), ("b", 2), ("c", 3)], [("d", 4), ("a", 5)], [("b", 0), ("e", 1)], [("c", 6), ("c", 2)])]
    src = late_stream(spark, tmp_path, files, "key string, ts timestamp")
    kept = streams.stream_recent(src, f"{tmp_path}/recent", ["key"], ["ts"], 2)
    assert {r["key"] for r in kept.collect()} == {"a", "c"}
    last = spark.createDataFrame(sum(files, []), "key string, ts timestamp").groupBy("key").agg(F.max("ts").alias("ts"))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, cache.keep_recent(last, ["ts", "key"], 2).collect()))
