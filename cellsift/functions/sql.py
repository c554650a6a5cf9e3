"""SQL functions for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cellsift.catalog import Catalog, as_catalog
from cellsift.functions.matching import ODD_LETTERS, flagged
from cellsift.functions.text import BLANKS

def _redacted(s: str) -> str:
    half, quarter = f"length({s}) div 2", f"length({s}) div 4"
    return (
        f"CASE WHEN length({s}) < 4 THEN {s} ELSE concat(left({s}, {half} - {quarter}), repeat('*', CAST(2 * ({quarter}) AS INT)), "
        f"substring({s}, CAST({half} + {quarter} + 1 AS INT))) END"
    )


REDACT_SQL = f"CREATE OR REPLACE TEMPORARY FUNCTION redact(s STRING) RETURNS STRING RETURN {_redacted('s')}"


def register(spark: SparkSession) -> None:
    """Make ``redact(text)`` available to SQL; it is inlined into the plan."""
    spark.sql(REDACT_SQL)


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_scan(
    spark: SparkSession, name: str = "scan_text", catalog: Catalog = None, unicode: bool = True, redacted: bool = False
) -> None:
    """Make a table function of a catalogue: ``SELECT t.id, f.* FROM t, LATERAL scan_text(t.text) AS f``.

    It returns the rows of ``scan`` for one text: ``pattern_name, matches, total_exposed, sample_text``. The body is plain SQL, which
    Spark inlines into the plan: no Python, no join.
    """
    detectors = as_catalog(catalog)
    if not detectors:
        raise ValueError("an empty catalogue finds nothing")

    def hidden(text: str) -> str:
        return _redacted(text) if redacted else text

    blanks = _text(BLANKS)
    tests = []
    for d in detectors:
        found = f"regexp_extract_all(cell, {_text(flagged(d.pattern, unicode))}, 0)"
        if d.literals:  # a text without any of them needs no regex
            odd = [f"contains(cell, '{letter}')" for letter in ODD_LETTERS] if unicode else []
            holds = " OR ".join([f"contains(lower(cell), {_text(literal)})" for literal in d.literals] + odd)
            found = f"IF({holds}, {found}, CAST(array() AS ARRAY<STRING>))"
        matches = f"sort_array(array_distinct(transform({found}, m -> btrim({hidden('m')}, {blanks}))))"
        tests.append(f"named_struct('pattern_name', {_text(d.name)}, 'matches', {matches})")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(cell STRING) "
        "RETURNS TABLE (pattern_name STRING, matches ARRAY<STRING>, total_exposed INT, sample_text STRING) RETURN "
        f"SELECT h.pattern_name, h.matches, size(h.matches), {hidden('substring(cell, 1, 50)')} "
        f"FROM (SELECT explode(filter(array({', '.join(tests)}), t -> size(t.matches) > 0)) AS h)"
    )
