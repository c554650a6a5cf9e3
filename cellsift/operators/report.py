"""Findings as people read them: places, numbers, totals, pages and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cellsift.operators.ordering import number_rows
from cellsift.schema import ORDER_COLUMNS

SHOWN_MATCHES = 25
PAGE_ROWS = 1000

# What a location is made of, per kind of source.
LOCATION_PARTS: dict[str, tuple[str, ...]] = {
    "mysql": ("host", "database", "table.column"),
    "postgresql": ("host", "database", "table.column"),
    "mongodb": ("host", "database", "collection", "field"),
    "couchdb": ("host", "database", "doc_id", "field"),
    "redis": ("host", "key"),
    "s3": ("bucket", "file_path"),
    "gcs": ("bucket", "file_path"),
    "firebase": ("bucket", "file_path"),
    "fs": ("file_path",),
    "slack": ("channel_name", "message_link"),
    "gdrive": ("file_name",),
    "gdrive_workspace": ("file_name", "user"),
    "text": (),
}


def location() -> Column:
    """Where a finding is, in one string; empty for sources without a place."""
    case = None
    for source, parts in LOCATION_PARTS.items():
        shown = [F.concat(*_between([_text(p) for p in part.split(".")], ".")) for part in parts]
        text = F.concat(*_between(shown, " > ")) if shown else F.lit("")
        case = (F if case is None else case).when(F.col("data_source") == source, text)
    return case.otherwise(F.lit(""))


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _between(cols: Sequence[Column], sep: str) -> list[Column]:
    out = [cols[0]]
    for c in cols[1:]:
        out += [F.lit(sep), c]
    return out


def shown_matches(matches: Column | str = "matches", limit: int = SHOWN_MATCHES) -> Column:
    """Matches joined by commas; from ``limit`` on only the first ones and how many more there are."""
    m = F.col(matches) if isinstance(matches, str) else matches
    head = F.array_join(F.slice(m, 1, limit), ", ")
    more = F.concat(head, F.lit(" + "), (F.size(m) - limit).cast("string"), F.lit(" more"))
    return F.when(F.size(m) < limit, head).otherwise(more)


def numbered(findings: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Running number per source, in the order of the locators."""
    return number_rows(findings, _order(findings, order), ["data_source"], "sl_no")


def _order(findings: DataFrame, order: Sequence[str] | None) -> list[str]:
    return list(order) if order else [c for c in ORDER_COLUMNS if c in findings.columns and c != "data_source"]


def report_table(findings: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The printed table: one row per finding with number, profile, place, pattern, count, values and sample."""
    return numbered(findings, order).select(
        "data_source",
        "sl_no",
        F.col("profile").alias("vulnerable_profile"),
        location().alias("location"),
        "pattern_name",
        F.size("matches").alias("total_exposed"),
        shown_matches().alias("exposed_values"),
        "sample_text",
    )


def grouped(findings: DataFrame, order: Sequence[str] | None = None, page_rows: int = PAGE_ROWS) -> DataFrame:
    """All findings of a source as lists: ``data_source, page, findings``.

    A source's list comes in pages of ``page_rows``, so no row grows with the data; pages in order are the whole list.
    """
    rest = [c for c in findings.columns if c != "data_source"]
    return (
        numbered(findings, order)
        .withColumn("page", F.floor((F.col("sl_no") - 1) / page_rows).cast("long"))
        .groupBy("data_source", "page")
        .agg(F.sort_array(F.collect_list(F.struct("sl_no", *rest))).alias("findings"))
        .withColumn("findings", F.transform("findings", lambda f: F.struct(*[f[c].alias(c) for c in rest])))
    )


def source_totals(findings: DataFrame) -> DataFrame:
    """Number of findings per source and the heading that shows it."""
    totals = findings.groupBy("data_source").agg(F.count("*").alias("total_findings"))
    return totals.withColumn(
        "title",
        F.concat(F.lit("Total "), F.col("total_findings").cast("string"), F.lit(" findings in "), "data_source"),
    )


def severity_matrix(findings: DataFrame, by: Sequence[str] = ("data_source", "pattern_name", "severity")) -> DataFrame:
    """Source totals broken down by pattern and severity."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("findings"), F.sum(F.col("total_exposed").cast("long")).alias("total_exposed")
    )


def severity_totals(findings: DataFrame, by: Sequence[str] = ("data_source", "pattern_name", "severity")) -> DataFrame:
    """The matrix with its subtotals in one pass: every cell, every source and pattern, every source, every pattern, and the whole.

    ``level`` tells them apart from cells whose own value is null: one bit for each of ``by`` that is summed over, the
    first of them the highest.
    """
    columns = [F.col(f"`{c}`") for c in by]
    sets = [columns, columns[:2], columns[:1], columns[1:2], []]
    return findings.groupingSets(sets, *columns).agg(
        F.grouping_id(*columns).cast("long").alias("level"),
        F.count("*").alias("findings"),
        F.sum(F.col("total_exposed").cast("long")).alias("total_exposed"),
    )


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON text per finding next to its source."""
    return findings.select("data_source", F.to_json(F.struct("*")).alias("finding"))


def write_json(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Findings as JSON lines, one folder per source; large sources fill many files, small ones few."""
    findings.hint("rebalance", "data_source").write.mode(mode).partitionBy("data_source").json(path)


def write_table(findings: DataFrame, path: str, mode: str = "append") -> None:
    findings.hint("rebalance", "data_source").write.mode(mode).partitionBy("data_source").parquet(path)
