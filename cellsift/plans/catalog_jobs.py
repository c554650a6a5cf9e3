"""Queries whose detectors are data: a catalogue held in a table, and a scan called from SQL alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.functions.sql import register_scan
from cellsift.operators.catalog_join import scan_with_table
from cellsift.operators.report import severity_totals
from cellsift.operators.scan import scan
from cellsift.operators.severity import rate
from cellsift.plans.audit import AUDIT_CATALOG, SEVERITY_SQL, findings_sql, joined, listed_sql, table, texts

#: Each word of six letters or more that the pages hold is a detector: that word at the end of a sentence or clause.
_WORDS = "[a-z]{6,}"
_END = "[.,]"


def word_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Thousands of detectors as a table, made from the pages, and beside them the ones without a literal."""
    words = table(spark, sf, "pages").select(
        F.explode(F.regexp_extract_all(F.lower("html"), F.lit(_WORDS), F.lit(0))).alias("w")
    ).distinct()
    ends = words.select(F.concat(F.lit("ends "), "w").alias("pattern_name"), F.concat("w", F.lit(_END)).alias("pattern"))
    return ends.union(spark.createDataFrame(list(AUDIT_CATALOG.items()), ends.schema))


def catalog_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    return joined(scan_with_table(docs, word_catalog(spark, sf), "text"))


_PLAIN = listed_sql(findings_sql("documents", "doc_id", "text"), "doc_id")
#: A match ends a run of letters, and its word is an end of that run.
_CATALOG_SQL = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(html), '{_WORDS}')) AS w FROM pages),
r AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '{_WORDS}{_END}', 0, 'i'))) AS r FROM documents),
x AS (SELECT DISTINCT doc_id, text, r[i:] AS m FROM (SELECT *, unnest(range(1, length(r) - 5)) AS i FROM r)),
f AS (SELECT doc_id, any_value(text) AS text, w, list_sort(list(DISTINCT m)) AS m FROM x JOIN w ON w = lower(left(m, -1)) GROUP BY doc_id, w)
SELECT doc_id, 'ends ' || w AS pattern_name, array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS total_exposed,
 substring(text, 1, 50) AS sample_text FROM f UNION ALL ({_PLAIN})"""


def scan_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """A scan written in SQL only."""
    register_scan(spark, "scan_text", AUDIT_CATALOG)
    texts(spark, sf, "documents").createOrReplaceTempView("sql_scan_documents")
    return spark.sql(
        "SELECT d.doc_id, f.pattern_name, array_join(f.matches, '|') AS matches, f.total_exposed, f.sample_text "
        "FROM sql_scan_documents AS d, LATERAL scan_text(d.text) AS f"
    )


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by source, pattern and severity, with subtotals."""
    docs = texts(spark, sf, "documents").select("doc_id", F.col("source").alias("data_source"), "text")
    return severity_totals(rate(scan(docs, "text", AUDIT_CATALOG)))


_TOTALS_SQL = f"""
SELECT source AS data_source, pattern_name, {SEVERITY_SQL} AS severity, CAST(grouping_id(source, pattern_name, {SEVERITY_SQL}) AS BIGINT) AS level,
 count(*) AS findings, CAST(sum(len(m)) AS BIGINT) AS total_exposed
FROM {findings_sql("documents", "doc_id, source", "text")} AS f
GROUP BY GROUPING SETS ((source, pattern_name, {SEVERITY_SQL}), (source, pattern_name), (source), (pattern_name), ())"""


QUERIES = {
    "scan_catalog_table": (catalog_table, _CATALOG_SQL),
    "fn_scan_table": (scan_in_sql, _PLAIN),
    "report_severity_totals": (totals, _TOTALS_SQL),
}
