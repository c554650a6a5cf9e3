"""Shared parts of the registered queries: tables, a catalogue both engines read alike, and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.session import spread

Query = Callable[[SparkSession, str], DataFrame]

#: Detectors that need no word boundary, so that Java and RE2 agree on any text.
AUDIT_CATALOG = {
    "email": r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "card16": r"[0-9]{16}",
    "phone_us": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "hex40": r"[0-9a-f]{40}",
    "digits": r"[0-9]+",
}
WORDS_CATALOG = {"words": r"[a-z]{6,}"}
DENSE_CATALOG = {**AUDIT_CATALOG, **WORDS_CATALOG}

# Unique keys of the given tables.
KEYS = {
    "documents": ("doc_id",),
    "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
    "events": ("event_id",),
    "benchmark": ("item_id",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table with enough splits for regex work."""
    return spread(table(spark, sf_dir, name), *KEYS[name])


def joined(df: DataFrame) -> DataFrame:
    """Match lists as one string, so that any engine can compare them."""
    return df.withColumn("matches", F.array_join("matches", "|"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def redact_sql(x: str) -> str:
    n = f"length({x})"
    return (
        f"CASE WHEN {n} < 4 THEN {x} ELSE left({x}, {n} // 2 - {n} // 4) || repeat('*', 2 * ({n} // 4)) "
        f"|| substring({x}, {n} // 2 + {n} // 4 + 1) END"
    )


def tidy_sql(m: str, redacted: bool = False) -> str:
    if redacted:
        m = f"list_transform({m}, lambda r: {redact_sql('r')})"
    return f"list_sort(list_distinct(list_transform({m}, lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g'))))"


def findings_sql(
    cells: str,
    ids: str,
    text: str = "value",
    catalog: Mapping[str, str] = AUDIT_CATALOG,
    redacted: bool = False,
    groups: Mapping[str, int] | None = None,
) -> str:
    """One SELECT per detector over ``cells`` (a table or a query in parentheses): ids, pattern_name, m, sample_text."""
    parts = []
    sample = f"substring({text}, 1, 50)"
    if redacted:
        sample = redact_sql(f"({sample})")
    for name, rx in catalog.items():
        raw = f"regexp_extract_all({text}, {quoted(rx)}, {(groups or {}).get(name, 0)}, 'i')"
        parts.append(
            f"SELECT {ids}, {quoted(name)} AS pattern_name, {tidy_sql(raw, redacted)} AS m, {sample} AS sample_text "
            f"FROM {cells} AS c_{len(parts)} WHERE {text} IS NOT NULL AND len({raw}) > 0"
        )
    return "(" + " UNION ALL ".join(parts) + ")"


def listed_sql(findings: str, ids: str) -> str:
    """Findings as the queries print them."""
    lead = f"{ids}, " if ids else ""
    return (
        f"SELECT {lead}pattern_name, array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS total_exposed, "
        f"sample_text FROM {findings} AS f"
    )


SEVERITY_SQL = (
    "CASE WHEN len(m) > 20 THEN 'Highest' WHEN len(m) > 10 THEN 'High' WHEN len(m) > 5 THEN 'Medium' ELSE 'Low' END"
)
SEVERITY_TEXT_SQL = (
    "CASE WHEN len(m) > 20 THEN 'Detected more than 20 PII or Secrets' "
    "WHEN len(m) > 10 THEN 'Detected more than 10 PII or Secrets' "
    "WHEN len(m) > 5 THEN 'Detected more than 5 PII or Secrets' "
    "ELSE 'Detected 5 or fewer PII or Secrets' END"
)
SHOWN_SQL = (
    "CASE WHEN len(m) < 25 THEN array_to_string(m, ', ') "
    "ELSE array_to_string(m[1:25], ', ') || ' + ' || CAST(len(m) - 25 AS VARCHAR) || ' more' END"
)
