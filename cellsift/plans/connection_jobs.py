"""Registered queries that go through what a user calls: whole scans of a description, drives, databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.plans.audit import AUDIT_CATALOG, findings_sql, joined, table, texts
from cellsift.plans.file_jobs import as_files
from cellsift.plans.scan_plan import scan_connection
from cellsift.plans.table_jobs import cells_sql
from cellsift.session import scratch
from cellsift.sources.drive import NATIVE_TYPES, drive_cells, drive_listing
from cellsift.sources.tables import catalog_reader, catalog_tables, scan_tables

_SHOWN = ("data_source", "profile", "table", "column", "collection", "field", "doc_id", "key", "pattern_name")


def connection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with and without an order, a document collection and pairs, written out and scanned by one description."""
    base = scratch(spark, "connection")
    for name in ("orders", "customer"):
        table(spark, sf, name).write.parquet(f"{base}/db/{name}")
    docs = texts(spark, sf, "documents").select(F.col("doc_id").alias("_id"), "lang", "text")
    docs.write.json(f"{base}/docs")
    talk = texts(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), F.col("text").alias("value"))
    talk.write.parquet(f"{base}/kv")
    sources = {
        "postgresql": {
            "all": {"path": f"{base}/db"},
            "ordered": {"path": f"{base}/db", "tables": ["orders"], "order_by": {"orders": "o_orderkey"}},
        },
        "mongodb": {"app": {"collections": {"texts": f"{base}/docs"}}},
        "redis": {"cache": {"path": f"{base}/kv"}},
    }
    found = scan_connection(spark, {"sources": sources}, catalog=AUDIT_CATALOG)
    return joined(found).select(*_SHOWN, "matches", "total_exposed", "sample_text")


def _cells(source: str, profile: str, relation: str, **columns: str) -> str:
    named = ", ".join(f'{columns.get(c, "CAST(NULL AS VARCHAR)")} AS "{c}"' for c in _SHOWN[2:-1])
    return f"SELECT '{source}' AS data_source, '{profile}' AS profile, {named}, value FROM {relation}"


_ORDERS, _CUSTOMER = cells_sql("orders", "o_orderkey"), cells_sql("customer", "c_custkey")
_PLACE = {"table": '"table"', "column": '"column"'}
_FIELDS = """(SELECT CAST(doc_id AS VARCHAR) AS id, '_id' AS f, CAST(doc_id AS VARCHAR) AS value FROM documents WHERE doc_id <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lang', lang FROM documents WHERE lang <> ''
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'text', text FROM documents WHERE text <> '')"""
_PAIRS = "(SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS k, text AS value FROM conversations WHERE text <> '')"
_CONNECTION_CELLS = "(" + " UNION ALL ".join(
    [
        _cells("postgresql", "all", f"({_ORDERS} UNION ALL {_CUSTOMER}) AS t", **_PLACE),
        _cells("postgresql", "ordered", f"({_ORDERS}) AS t", **_PLACE),
        _cells("mongodb", "app", f"{_FIELDS} AS t", collection="'texts'", field="f", doc_id="id"),
        _cells("redis", "cache", f"{_PAIRS} AS t", key="k"),
    ]
) + ")"
_IDS = ", ".join(f'"{c}"' for c in _SHOWN[:-1])
_CONNECTION_SQL = f"""
SELECT {_IDS}, pattern_name, array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_CONNECTION_CELLS, _IDS)} AS f"""


def drive_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one name under several owners, in and below the root, and native documents with an exported text."""
    n, pages = F.col("page_id"), texts(spark, sf, "pages")
    native = n % 5 == 0
    where = F.concat(F.lit("file:/drive/"), n.cast("string"), F.when(native, F.lit("/export.txt")).otherwise(F.lit("/page.txt")))
    manifest = pages.select(
        n.cast("string").alias("file_id"),
        F.when(native, F.lit("page")).otherwise(F.lit("page.txt")).alias("file_name"),
        F.concat(F.lit("user"), (n % 4).cast("string")).alias("owner"),
        F.when(n % 7 == 0, F.lit("sub")).otherwise(F.lit("root")).alias("parent"),
        F.when(native, F.lit(NATIVE_TYPES[0])).otherwise(F.lit("text/plain")).alias("mime"),
        F.when(native, where).alias("path"),
    )
    listing = drive_listing(manifest, users=["user1", "user2"])
    cells = drive_cells(listing, as_files(pages, where, F.encode("html", "UTF-8")))
    return cells.select("file_id", "file_name", "user", "file_path", F.md5("value").alias("text_md5"))


_DRIVE_CELLS_SQL = """
SELECT CAST(page_id AS VARCHAR) AS file_id, CASE WHEN page_id % 5 = 0 THEN 'page' ELSE 'page.txt' END AS file_name,
 'user' || CAST(page_id % 4 AS VARCHAR) AS user,
 '/drive/' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 5 = 0 THEN '/export.txt' ELSE '/page.txt' END AS file_path,
 md5(html) AS text_md5 FROM pages WHERE page_id % 4 IN (1, 2) AND html <> ''"""


def two_databases(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of one name in two databases, with a temporary view of that name in the way."""
    parts = []
    for name, source in (("found_a", "nation"), ("found_b", "supplier")):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}.things")
        folder = scratch(spark, "things").replace("'", "''")
        table(spark, sf, source).write.parquet(folder)
        spark.sql(f"CREATE TABLE {name}.things USING parquet LOCATION '{folder}'")
    table(spark, sf, "part").createOrReplaceTempView("things")
    for name in ("found_a", "found_b"):
        cells = scan_tables(catalog_tables(spark, name), catalog_reader(spark, name), database=name)
        parts.append(cells.select("database", "table", "column", "value"))
    return parts[0].unionByName(parts[1])


_DATABASES_SQL = " UNION ALL ".join(
    f"""SELECT '{db}' AS database, 'things' AS "table", "column", value FROM ({cells_sql(name, key)}) AS t_{db}"""
    for db, name, key in (("found_a", "nation", "n_nationkey"), ("found_b", "supplier", "s_suppkey"))
)

QUERIES = {
    "src_connection_scan": (connection_scan, _CONNECTION_SQL),
    "src_drive_cells": (drive_texts, _DRIVE_CELLS_SQL),
    "src_table_discovery_databases": (two_databases, _DATABASES_SQL),
}
