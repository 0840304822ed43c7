"""Readers, sinks and streams."""

from pyspark.sql import functions as F

from usetrail.sources import corpus, sinks
from usetrail.sources.views import table
from usetrail.streaming import streams

SF = "/root/testdata/sf0.001"


def test_corpus_scan_and_package(spark, tmp_path):
    (tmp_path / "a.go").write_text("package main\n\nvar x = 1\n")
    (tmp_path / "b.go").write_text("package other\n")
    docs = corpus.scan_corpus(spark, str(tmp_path), glob="*.go")
    assert docs.count() == 2
    main = corpus.same_package(docs, "main").collect()
    assert len(main) == 1 and main[0]["doc_id"].endswith("/a.go")


def test_empty_overlay_is_ignored(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    new = spark.createDataFrame([(1, "A"), (2, "")], "id int, text string")
    got = {r["id"]: r["text"] for r in corpus.overlay(base, new, "id", "text").collect()}
    assert got == {1: "A", 2: "b", 3: "c"}


def test_findings_are_replaced_and_cleared(spark, tmp_path):
    path = str(tmp_path / "findings")
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, rule string, pos bigint")
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id int")
    sinks.write_findings(make([(1, "a", 1), (2, "b", 2), (3, "c", 3)]), docs(1, 2, 3), path, 1)
    sinks.write_findings(make([(1, "z", 9)]), docs(1, 2), path, 2)
    sinks.write_findings(make([(1, "z", 9)]), docs(1, 2), path, 2)  # a repeated run changes nothing
    got = {(r["doc_id"], r["rule"], r["pos"]) for r in sinks.read_findings(spark, path).collect()}
    assert got == {(1, "z", 9), (3, "c", 3)}


def test_compacted_findings_read_the_same(spark, tmp_path):
    path, slim = str(tmp_path / "findings"), str(tmp_path / "slim")
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, rule string, pos bigint")
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id int")
    sinks.write_findings(make([(1, "a", 1), (2, "b", 2), (3, "c", 3)]), docs(1, 2, 3), path, 1)
    sinks.write_findings(make([(1, "z", 9)]), docs(1, 2), path, 2)
    sinks.compact_findings(spark, path, slim)
    shown = lambda at: sorted(tuple(r) for r in sinks.read_findings(spark, at).collect())
    assert shown(slim) == shown(path) == [(1, "z", 9), (3, "c", 3)]
    assert spark.read.parquet(slim).count() == 5  # three heads and two findings
    sinks.write_findings(make([(3, "d", 4)]), docs(3), slim, 3)
    assert shown(slim) == [(1, "z", 9), (3, "d", 4)]


def test_colors_default_to_empty(spark):
    df = spark.createDataFrame([("raceColor",), ("nope",), (None,)], "k string")
    got = [r["color_value"] for r in sinks.with_colors(df, "k").collect()]
    assert sorted(got) == ["", "", "red"]


def test_streams_equal_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    src = tmp_path / "src"
    events.repartition(3).write.parquet(str(src))
    # several files, one per trigger, so state is carried over micro-batches
    stream = streams.table_stream(spark, str(src), "", events.schema, "ts", files_per_trigger=1)
    counts = streams.run_to_table(
        streams.stream_counts(stream, ["event_type"]), str(tmp_path / "counts"), "update"
    )
    got = {r["event_type"]: r["n"] for r in streams.last_of_batches(counts, ["event_type"]).collect()}
    want = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert got == want
    latest = streams.stream_latest(stream, ["user_id"], ["ts", "event_id"], ["event_type"])
    out = streams.run_to_table(latest, str(tmp_path / "latest"), "update")
    got = {r["user_id"]: r["event_id"] for r in streams.last_of_batches(out, ["user_id"]).collect()}
    batch = corpus.latest_by_key(
        events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]
    )
    assert got == {r["user_id"]: r["event_id"] for r in batch.collect()}


def test_batch_rule_inside_a_stream(spark, tmp_path):
    events = table(spark, SF, "events")
    stream = streams.table_stream(spark, SF, "events", events.schema, "ts")
    rule = lambda b: b.groupBy("user_id").agg(F.count("*").alias("n"))
    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "c"))
        .foreachBatch(streams.per_batch(str(tmp_path / "t"), rule)).start()
    )
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("n")).first()[0] == events.count()


def test_dropping_scratch_takes_own_folders_only(spark, tmp_path):
    from pathlib import Path

    from usetrail import session

    before = session._GIVEN.pop(spark.sparkContext.applicationId, [])  # what other tests still read
    parent = Path(spark.conf.get("spark.checkpoint.dir"))
    (parent / "someone-else").mkdir()
    kept = {p.name for p in parent.iterdir()}
    table = session.staged(spark.range(5), "own")
    assert table.count() == 5 and {p.name for p in parent.iterdir()} > kept
    session.scratch_dir(spark, "never-written")
    assert session.drop_scratch(spark) == 1 and {p.name for p in parent.iterdir()} == kept
    assert session.drop_scratch(spark) == 0
    session._GIVEN[spark.sparkContext.applicationId] = before
