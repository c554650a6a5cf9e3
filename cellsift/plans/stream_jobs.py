"""Registered queries of streams: a table is streamed once to its end and the result table is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.operators import alerts as al
from cellsift.operators.scan import scan
from cellsift.plans.audit import AUDIT_CATALOG, DENSE_CATALOG, findings_sql, joined, listed_sql, table, texts
from cellsift.session import scratch
from cellsift.streaming.streams import (
    dedupe_alerts,
    run_to_table,
    sent_alerts,
    start_alerts,
    stream_files,
    stream_scan,
    table_stream,
    window_counts,
)


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files."""
    schema = table(spark, sf, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(path):
        return table_stream(spark, f"{sf}/{name}.parquet", schema)
    return table_stream(spark, sf, schema, f"{name}.parquet")


def _run(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    return run_to_table(stream, scratch(spark, label), scratch(spark, f"{label}-state"))


def scan_stream(spark: SparkSession, sf: str) -> DataFrame:
    docs = _stream(spark, sf, "documents").select("doc_id", "text")
    return _run(joined(stream_scan(docs, "text", AUDIT_CATALOG)), "stream-scan")


def _event_findings(events: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "event_type", "props")
    cells = events.select("event_id", "user_id", "ts", text.alias("value"))
    return scan(cells, "value", DENSE_CATALOG)


def alert_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Equal alerts of a stream pass once: here an alert is a user's detector hit with its values."""
    found = _event_findings(_stream(spark, sf, "events"))
    text = F.concat_ws("\n", F.col("user_id").cast("string"), "pattern_name", F.array_join("matches", ", "))
    alerts = found.select("ts", text.alias("message")).withColumn("msg_hash", al.alert_hash())
    return _run(dedupe_alerts(alerts, "ts", "60 days").select("msg_hash", "message"), "stream-dedupe")


_EVENT_CELLS = "(SELECT event_id, user_id, ts, event_type || ' ' || props AS value FROM events)"
_EVENT_FOUND = findings_sql(_EVENT_CELLS, "event_id, user_id, ts", "value", DENSE_CATALOG)
_DEDUPE_SQL = f"""
SELECT DISTINCT message, sha256(message) AS msg_hash FROM (SELECT CAST(user_id AS VARCHAR) || chr(10) || pattern_name || chr(10)
|| array_to_string(m, ', ') AS message FROM {_EVENT_FOUND} AS f) AS x"""


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per user and hour, from a stream; windows the watermark has not passed stay open and are not emitted."""
    found = _event_findings(_stream(spark, sf, "events"))
    return _times(_run(window_counts(found, "ts", 60, ("user_id",), "10 minutes"), "stream-counts"))


def counts_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _times(window_counts(_event_findings(table(spark, sf, "events")), "ts", 60, ("user_id",)))


def _times(df: DataFrame) -> DataFrame:
    for c in ("window_start", "window_end"):
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


def _counts_sql(where: str) -> str:
    return f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
user_id, count(*) AS findings, CAST(sum(len(m)) AS BIGINT) AS total_exposed
FROM (SELECT *, date_trunc('hour', ts) AS w FROM {_EVENT_FOUND} AS f) AS x WHERE {where} GROUP BY w, user_id"""


def alert_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of alerts into the outbox, then the same stream once more under another name: nothing is sent twice."""
    path = scratch(spark, "outbox")
    for stream in ("first", "second"):
        docs = _stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
        found = scan(docs, "text", AUDIT_CATALOG).select(
            F.lit("couchdb").alias("data_source"),
            F.col("source").alias("profile"),
            *[F.lit(None).cast("string").alias(c) for c in _OTHER_PLACES],
            "doc_id",
            "pattern_name",
            "matches",
            "total_exposed",
            "sample_text",
        )
        start_alerts(al.alerts(found), path, scratch(spark, "outbox-state"), stream).awaitTermination()
    sent = sent_alerts(spark, path)
    return sent.select("msg_hash", F.get_json_object("payload", "$.text").alias("text"))


_OTHER_PLACES = tuple(
    c for c in sorted({c for columns in al.LINES.values() for c in columns}) if c != "doc_id"
)
_SINK_SQL = f"""
SELECT DISTINCT sha256(text) AS msg_hash, text FROM (SELECT '*** PII Or Secret Found ***' || chr(10) || 'Data Source: CouchDB - '
|| source || chr(10) || 'Host: ' || chr(10) || 'Database: ' || chr(10) || 'Document ID: ' || CAST(doc_id AS VARCHAR) || chr(10)
|| 'Field: ' || chr(10) || 'Pattern Name: ' || pattern_name || chr(10) || 'Total Exposed: ' || CAST(len(m) AS VARCHAR) || chr(10)
|| 'Exposed Values: ' || array_to_string(m, ', ') AS text FROM {findings_sql('documents', 'doc_id, source', 'text')} AS f) AS x"""


def files_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as files into a folder that a file stream reads; compared by distinct match per host ending."""
    folder = scratch(spark, "arrivals")
    pages = texts(spark, sf, "pages").select(
        F.regexp_extract("url", r"example\.(\w+)", 1).alias("ending"), F.col("html").alias("value")
    )
    pages.write.partitionBy("ending").option("maxRecordsPerFile", 200).text(folder)
    found = stream_files(spark, folder, AUDIT_CATALOG, "*.txt")
    done = _run(found.select("file_path", "pattern_name", F.explode("matches").alias("match")), "stream-files")
    ending = F.regexp_extract("file_path", r"/ending=([^/]+)/", 1).alias("ending")
    return done.select(ending, "pattern_name", "match").distinct()


_FILES_SQL = f"""
SELECT DISTINCT ending, pattern_name, unnest(m) AS match
FROM {findings_sql("(SELECT regexp_extract(url, 'example\\.([a-z0-9_]+)', 1) AS ending, html AS value FROM pages)", 'ending')} AS f"""

QUERIES = {
    "stream_scan": (scan_stream, listed_sql(findings_sql("documents", "doc_id", "text"), "doc_id")),
    "stream_alert_dedupe": (alert_dedupe, _DEDUPE_SQL),
    "stream_window_counts": (
        counts,
        _counts_sql("w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"),
    ),
    "stream_window_counts_batch": (counts_batch, _counts_sql("TRUE")),
    "stream_alert_sink": (alert_sink, _SINK_SQL),
    "stream_new_files": (files_stream, _FILES_SQL),
}
