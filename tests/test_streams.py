import datetime as dt
import os

from pyspark.sql import functions as F

from cellsift.operators import alerts as al
from cellsift.operators.scan import scan
from cellsift.plans import stream_jobs
from cellsift.streaming.streams import (
    alert_sink,
    dedupe_alerts,
    run_to_table,
    sent_alerts,
    start_alerts,
    stream_files,
    stream_scan,
    table_stream,
    window_counts,
)

NUMBERS = {"digits": "[0-9]+"}
T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_scan_equals_its_batch_twin_and_goes_on(spark, tmp_path):
    schema = "id int, value string"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    put(spark, src, [(1, "a 1"), (2, "none")], schema)
    stream = lambda: stream_scan(table_stream(spark, src, schema), "value", NUMBERS)
    assert run_to_table(stream(), out, state).count() == 1
    put(spark, src, [(3, "b 22 22 3")], schema)
    got = run_to_table(stream(), out, state)
    want = scan(spark.read.parquet(src), "value", NUMBERS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert run_to_table(stream(), out, state).count() == 2


def test_dedupe_within_horizon(spark, tmp_path):
    schema = "ts timestamp_ntz, msg_hash string"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    hour = dt.timedelta(hours=1)
    put(spark, src, [(T0, "x"), (T0 + hour, "x"), (T0, "y")], schema)
    stream = lambda: dedupe_alerts(table_stream(spark, src, schema), "ts", "1 day").select("msg_hash")
    assert sorted(r[0] for r in run_to_table(stream(), out, state).collect()) == ["x", "y"]
    put(spark, src, [(T0 + 2 * hour, "x"), (T0 + 2 * hour, "z")], schema)
    assert sorted(r[0] for r in run_to_table(stream(), out, state).collect()) == ["x", "y", "z"]
    # beyond the horizon the same alert passes again
    put(spark, src, [(T0 + 80 * hour, "w")], schema)
    run_to_table(stream(), out, state)
    put(spark, src, [(T0 + 81 * hour, "x")], schema)
    assert sorted(r[0] for r in run_to_table(stream(), out, state).collect()) == ["w", "x", "x", "y", "z"]


def test_a_late_copy_does_not_keep_back_one_in_time(spark, tmp_path):
    schema = "ts timestamp_ntz, msg_hash string"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = dt.timedelta(days=1)
    stream = lambda: dedupe_alerts(table_stream(spark, src, schema), "ts", "1 day").select("msg_hash")
    put(spark, src, [(T0 + 10 * day, "w")], schema)
    run_to_table(stream(), out, state)
    put(spark, src, [(T0 + day, "h"), (T0 + 11 * day, "h")], schema)
    assert sorted(r[0] for r in run_to_table(stream(), out, state).collect()) == ["h", "w"]


def test_window_counts_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp_ntz, channel_id string, total_exposed int"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    minute = dt.timedelta(minutes=1)
    put(spark, src, [(T0 + m * minute, "a", 2) for m in (1, 59, 61)] + [(T0 + 300 * minute, "b", 1)], schema)
    stream = lambda: window_counts(table_stream(spark, src, schema), "ts", 60)
    shown = lambda df: sorted((r["channel_id"], r["window_start"].hour, r["findings"], r["total_exposed"]) for r in df.collect())
    assert shown(run_to_table(stream(), out, state)) == [("a", 0, 2, 4), ("a", 1, 1, 2)]
    put(spark, src, [(T0 + 2 * minute, "a", 9), (T0 + 600 * minute, "c", 1)], schema)
    assert shown(run_to_table(stream(), out, state)) == [("a", 0, 2, 4), ("a", 1, 1, 2), ("b", 5, 1, 1)]
    batch = window_counts(spark.read.parquet(src), "ts", 60)
    assert ("a", 0, 3, 13) in shown(batch)


def places(df):
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("host", "database", "table", "column", "collection", "field", "doc_id", "key", "bucket", "channel_name", "message_link", "file_name", "user")])


def test_alert_sink(spark, tmp_path):
    schema = "data_source string, profile string, file_path string, pattern_name string, matches array<string>, sample_text string"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    row = lambda p: ("fs", "p", p, "Email", ["m"], "s")
    stream = lambda: al.alerts(places(table_stream(spark, src, schema)))
    put(spark, src, [row("/a"), row("/a"), row("/b")], schema)
    start_alerts(stream(), out, state).awaitTermination()
    assert sent_alerts(spark, out).count() == 2
    put(spark, src, [row("/a"), row("/c")], schema)
    start_alerts(stream(), out, state).awaitTermination()
    assert sent_alerts(spark, out).count() == 3

    # a batch that runs again after a failure writes the same rows in place of its own
    batch = al.alerts(places(spark.createDataFrame([row("/a"), row("/c")], schema)))
    alert_sink(out)(batch, 1)
    assert sent_alerts(spark, out).count() == 3
    # another stream sees what the first has sent
    alert_sink(out, "other")(batch, 0)
    assert sent_alerts(spark, out).count() == 3


def test_a_batch_opens_no_more_the_more_batches_there_were(spark, tmp_path):
    out = str(tmp_path / "out")
    row = lambda p: ("fs", "p", p, "Email", ["m"], "s")
    schema = "data_source string, profile string, file_path string, pattern_name string, matches array<string>, sample_text string"
    batch = lambda *names: al.alerts(places(spark.createDataFrame([row(n) for n in names], schema)))
    sink = alert_sink(out, compact_after=2)
    for i in range(9):
        sink(batch("/same", f"/{i}"), i)
    assert sent_alerts(spark, out).groupBy("batch_id").count().where("count > 0").count() == 9
    assert sent_alerts(spark, out).count() == 10
    # Batch 9 would look into the base and the outboxes since; stages are gone, of older bases one is left.
    names = sorted(p.name for p in (tmp_path / "out" / "stream=alerts" / "base").iterdir() if p.is_dir())
    assert names == ["upto=5", "upto=7"]
    assert [p.name for p in (tmp_path / "out" / "stream=alerts" / "outbox-7").iterdir() if p.is_dir()] == ["run=8"]
    assert list((tmp_path / "out" / "stream=alerts" / "stage").iterdir()) == []
    # A settled batch that comes again changes nothing, and another stream sees bases and outboxes of the first.
    sink(batch("/same", "/3"), 3)
    alert_sink(out, "other")(batch("/same", "/0", "/8", "/new"), 0)
    sent = sent_alerts(spark, out)
    assert sent.count() == 11 and [r.batch_id for r in sent.where("stream = 'other'").collect()] == [0]
    # What breaks off before its commit is sent by its repetition.
    (tmp_path / "out" / "stream=alerts" / "outbox-7" / "run=8" / "_SUCCESS").unlink()
    assert sent_alerts(spark, out).count() == 10
    sink(batch("/same", "/8"), 8)
    assert sent_alerts(spark, out).where("stream = 'alerts'").count() == 10


def test_new_files(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("one 1")
    (src / "skip.md").write_text("no 2")
    stream = lambda: stream_files(spark, str(src), NUMBERS, "*.txt")
    assert [r["matches"] for r in run_to_table(stream(), out, state).collect()] == [["1"]]
    (src / "sub" / "b.txt").write_text("three 3")
    got = run_to_table(stream(), out, state).collect()
    assert sorted(os.path.basename(r["file_path"]) for r in got) == ["a.txt", "b.txt"]


def test_a_hot_alert_passes_once(spark, tmp_path):
    schema = "ts timestamp_ntz, msg_hash string, matches array<string>"
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(T0, "hot", ["a"])] * 5000 + [(T0, f"h{i}", ["b", "c"]) for i in range(50)] + [(T0, None, ["d"])] * 3
    put(spark, src, rows, schema)
    got = run_to_table(dedupe_alerts(table_stream(spark, src, schema)), out, state)
    assert got.count() == 52
    assert {tuple(r["matches"]) for r in got.collect()} == {("a",), ("b", "c"), ("d",)}


def test_a_table_streams_as_a_file_and_as_a_folder(spark, tmp_path):
    rows = [(1, "web", "a 1 b@c.de"), (2, "web", "none"), (3, None, "22"), (4, "mail", None), (5, "mail", "33 44")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    folder, single = tmp_path / "folder", tmp_path / "single"
    docs.repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    single.mkdir()
    os.link(next((tmp_path / "one").glob("part-*")), single / "documents.parquet")
    for query, n in ((stream_jobs.scan_stream, 4), (stream_jobs.alert_sink, 4)):
        found, want = (sorted(map(str, query(spark, str(d)).collect())) for d in (folder, single))
        assert found == want and len(found) == n
