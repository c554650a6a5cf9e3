"""Registered queries of table, document, key-value and literal sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.operators.ordering import row_range
from cellsift.operators.scan import scan
from cellsift.plans.audit import DENSE_CATALOG, findings_sql, joined, listed_sql, table, texts
from cellsift.schema import locate
from cellsift.session import scratch, spread
from cellsift.sources.documents import json_cells, key_value_cells, record_cells, scan_collections
from cellsift.sources.literal import text_cells
from cellsift.sources.tables import catalog_reader, catalog_tables, scan_tables, table_cells

# Columns of the given tables, for the SQL side; doubles and timestamps print alike in Python and DuckDB.
COLUMNS = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "labels": ("doc_id", "quality", "toxic"),
    "lineitem": (
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ),
}
_TEXT = {"c_name", "c_mktsegment", "o_orderstatus", "o_orderpriority", "p_name", "p_brand", "p_type", "s_name", "n_name"}
_TEXT |= {"l_returnflag", "l_linestatus"}
_TIME = {"o_orderdate", "l_shipdate"}


def cells_sql(name: str, key: str, relation: str | None = None, columns: tuple[str, ...] | None = None) -> str:
    parts = []
    for c in columns or COLUMNS[name]:
        filled = f"{c} <> ''" if c in _TEXT else "TRUE" if c in _TIME else f"{c} <> 0"
        parts.append(
            f"SELECT CAST({key} AS VARCHAR) AS row_id, '{name}' AS \"table\", '{c}' AS \"column\", "
            f"CAST({c} AS VARCHAR) AS value FROM {relation or name} AS t_{c} WHERE {c} IS NOT NULL AND {filled}"
        )
    return " UNION ALL ".join(parts)


_SCANNED = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}


def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of four tables, found and located."""
    cells = scan_tables(
        _SCANNED,
        lambda name: spread(table(spark, sf, name), _SCANNED[name]),
        ids={name: [key] for name, key in _SCANNED.items()},
        data_source="mysql",
        profile="shop",
        host="db.example.org",
        database="tpch",
    )
    return joined(scan(cells, "value", DENSE_CATALOG))


_TABLE_CELLS = " UNION ALL ".join(cells_sql(n, k) for n, k in _SCANNED.items())
_TABLE_SQL = f"""
WITH cells AS MATERIALIZED ({_TABLE_CELLS}),
f AS ({findings_sql('cells', 'row_id, "table", "column"', 'value', DENSE_CATALOG)[1:-1]})
SELECT row_id, "table", "column", 'mysql' AS data_source, 'shop' AS profile, 'db.example.org' AS host, 'tpch' AS database,
pattern_name, array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS total_exposed, sample_text FROM f"""


def _summary(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table", "column").agg(
        F.count("*").alias("cells"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


def _summary_sql(cells: str) -> str:
    return (
        f'SELECT "table", "column", count(*) AS cells, min(value) AS lowest, max(value) AS highest FROM ({cells}) AS c '
        'GROUP BY "table", "column"'
    )


def table_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Tables found by name in a database of the session's catalogue, then all of them melted."""
    spark.sql("CREATE DATABASE IF NOT EXISTS found")
    for name in ("nation", "part", "supplier"):
        folder = scratch(spark, "found").replace("'", "''")
        table(spark, sf, name).write.parquet(folder)
        spark.sql(f"DROP TABLE IF EXISTS found.found_{name}")
        spark.sql(f"CREATE TABLE found.found_{name} USING parquet LOCATION '{folder}'")
    return _summary(scan_tables(catalog_tables(spark, "found"), catalog_reader(spark, "found")))


_DISCOVERED = " UNION ALL ".join(
    cells_sql(n, k).replace(f"'{n}' AS \"table\"", f"'found_{n}' AS \"table\"")
    for n, k in (("nation", "n_nationkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"))
)


def table_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    cells = scan_tables(
        ["customer", "nation", "orders", "part"], lambda n: table(spark, sf, n), ["orders", "part", "no_such_table"]
    )
    return _summary(cells)


def some_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The default range of a table source: 500 rows, here after the first 100."""
    return table_cells(table(spark, sf, "orders"), "orders", ["o_orderkey"], (), "o_orderkey", 100, 500).select(
        F.col("o_orderkey").cast("string").alias("row_id"), "table", "column", "value"
    )


def rest_of_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An open range in a two-column order with many ties: all rows but the first 1,000."""
    rows = row_range(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 1000, None)
    return rows.select("o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")


def exclude_columns(spark: SparkSession, sf: str) -> DataFrame:
    dropped = ["l_orderkey", "l_partkey", "l_comment", "l_tax", "l_shipdate"]
    return _summary(table_cells(table(spark, sf, "lineitem"), "lineitem", exclude_columns=dropped))


_KEPT = ("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def cell_melt(spark: SparkSession, sf: str) -> DataFrame:
    return table_cells(table(spark, sf, "customer"), "customer", ["c_custkey"]).select(
        F.col("c_custkey").cast("string").alias("row_id"), "table", "column", "value"
    )


def skip_falsy(spark: SparkSession, sf: str) -> DataFrame:
    return table_cells(table(spark, sf, "labels"), "labels", ["doc_id"]).select(
        F.col("doc_id").cast("string").alias("row_id"), "table", "column", "value"
    )


def stringify(spark: SparkSession, sf: str) -> DataFrame:
    """Integers, floats, timestamps and text of two tables as text."""
    keys = {"lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"]}
    cells = scan_tables(keys, lambda n: spread(table(spark, sf, n), *keys[n]), ids=keys)
    return cells.select("row_id", "table", "column", "value")


_STRING_CELLS = " UNION ALL ".join(
    [
        cells_sql("lineitem", "l_orderkey || '|' || CAST(l_linenumber AS VARCHAR)"),
        cells_sql("part", "p_partkey"),
    ]
)


def document_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON documents: event properties, and whole events as records of another collection."""

    def reader(name: str) -> DataFrame:
        events = table(spark, sf, "events")
        if name == "props":
            return json_cells(events, "props", "event_id")
        return record_cells(events, "event_id")

    cells = scan_collections(["props", "activity"], reader, profile="events", host="mongo.example.org", database="app")
    return joined(scan(cells, "value", DENSE_CATALOG))


_DOCUMENT_CELLS = """(SELECT event_id AS id, 'props' AS collection, 'k' AS field,
 json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') <> '0'
UNION ALL SELECT event_id, 'activity', 'event_id', CAST(event_id AS VARCHAR) FROM events WHERE event_id <> 0
UNION ALL SELECT event_id, 'activity', 'ts', CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
 ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END FROM events WHERE ts IS NOT NULL
UNION ALL SELECT event_id, 'activity', 'value', CAST(value AS VARCHAR) FROM events WHERE value <> 0
UNION ALL SELECT event_id, 'activity', 'props', props FROM events WHERE props <> ''
UNION ALL SELECT event_id, 'activity', 'user_id', CAST(user_id AS VARCHAR) FROM events WHERE user_id <> 0
UNION ALL SELECT event_id, 'activity', 'event_type', event_type FROM events WHERE event_type <> '')"""
_DOCUMENT_SQL = f"""
SELECT CAST(id AS VARCHAR) AS doc_id, collection, field, 'mongodb' AS data_source, 'events' AS profile,
'mongo.example.org' AS host, 'app' AS database, pattern_name, array_to_string(m, '|') AS matches,
CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_DOCUMENT_CELLS, 'id, collection, field', 'value', DENSE_CATALOG)} AS f"""


def key_values(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "customer").select(
        F.encode(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), "UTF-8").alias("k"),
        F.encode(F.concat_ws(" ", "c_name", "c_mktsegment"), "UTF-8").alias("v"),
    )
    cells = locate(key_value_cells(pairs, "k", "v"), "redis", "cache", host="redis.example.org")
    return joined(scan(cells, "value", DENSE_CATALOG))


_KEY_VALUE_CELLS = (
    "(SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS key, c_name || ' ' || c_mktsegment AS value FROM customer)"
)
_KEY_VALUE_SQL = f"""
SELECT key, 'redis' AS data_source, 'cache' AS profile, 'redis.example.org' AS host, pattern_name,
array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_KEY_VALUE_CELLS, 'key', 'value', DENSE_CATALOG)} AS f"""


def text_literals(spark: SparkSession, sf: str) -> DataFrame:
    """One profile per message, its text as the literal to scan."""
    rows = texts(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("profile"), "text")
    return joined(scan(text_cells(rows), "value", DENSE_CATALOG))


_LITERAL_CELLS = "(SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS profile, text AS value FROM conversations)"
_LITERAL_SQL = f"""
SELECT 'text' AS data_source, profile, pattern_name, array_to_string(m, '|') AS matches,
CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM {findings_sql(_LITERAL_CELLS, 'profile', 'value', DENSE_CATALOG)} AS f"""


def profile_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Three kinds of source, several profiles, one list of findings."""
    docs = texts(spark, sf, "documents").selectExpr("doc_id AS id", "lang AS profile", "text AS value")
    pages = texts(spark, sf, "pages").selectExpr("page_id AS id", "'web' AS profile", "html AS value")
    talk = texts(spark, sf, "conversations").selectExpr("conv_id AS id", "role AS profile", "text AS value")
    cells = reduce(DataFrame.unionByName, [locate(docs, "gcs"), locate(pages, "fs"), locate(talk, "slack")])
    return joined(scan(cells, "value", DENSE_CATALOG))


_FANOUT_CELLS = """(SELECT doc_id AS id, 'gcs' AS data_source, lang AS profile, text AS value FROM documents
UNION ALL SELECT page_id, 'fs', 'web', html FROM pages
UNION ALL SELECT conv_id, 'slack', role, text FROM conversations)"""

_CELLS = 'SELECT row_id, "table", "column", value FROM '

QUERIES = {
    "src_table_scan": (table_scan, _TABLE_SQL),
    "src_table_discovery": (table_discovery, _summary_sql(_DISCOVERED)),
    "src_table_whitelist": (
        table_whitelist,
        _summary_sql(cells_sql("orders", "o_orderkey") + " UNION ALL " + cells_sql("part", "p_partkey")),
    ),
    "src_row_range": (
        some_rows,
        _CELLS
        + "("
        + cells_sql("orders", "o_orderkey", "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 100)")
        + ") AS c",
    ),
    "src_row_range_open": (
        rest_of_rows,
        "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders "
        "ORDER BY orders.o_orderdate, o_orderkey OFFSET 1000",
    ),
    "src_exclude_columns": (exclude_columns, _summary_sql(cells_sql("lineitem", "l_orderkey", columns=_KEPT))),
    "src_cell_melt": (cell_melt, cells_sql("customer", "c_custkey")),
    "src_skip_falsy": (skip_falsy, cells_sql("labels", "doc_id")),
    "src_stringify": (stringify, _STRING_CELLS),
    "src_document_fields": (document_fields, _DOCUMENT_SQL),
    "src_key_value": (key_values, _KEY_VALUE_SQL),
    "src_text_literal": (text_literals, _LITERAL_SQL),
    "src_profile_fanout": (
        profile_fanout,
        listed_sql(
            findings_sql(_FANOUT_CELLS, "id, data_source, profile", "value", DENSE_CATALOG), "id, data_source, profile"
        ),
    ),
}
