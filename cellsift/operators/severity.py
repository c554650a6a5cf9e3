"""Ordered severity rules as one CASE expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

Rules = Mapping[str, Sequence[Mapping[str, str]]]

# The rules that hold when a user gives none.
DEFAULT_RULES: Rules = {
    "Highest": [{"query": "size(matches) > 20", "description": "Detected more than 20 PII or Secrets"}],
    "High": [
        {
            "query": "size(matches) > 10 AND size(matches) <= 20",
            "description": "Detected more than 10 PII or Secrets",
        }
    ],
    "Medium": [
        {"query": "size(matches) > 5 AND size(matches) <= 10", "description": "Detected more than 5 PII or Secrets"}
    ],
    "Low": [{"query": "size(matches) <= 5", "description": "Detected 5 or fewer PII or Secrets"}],
}
UNKNOWN = ("unknown", "No matching rule found.")


def severity_of(rules: Rules | None = None) -> tuple[Column, Column]:
    """``(severity, description)``; the first rule that is true wins, a rule that is null counts as false.

    Rules are Spark SQL predicates over the columns of a finding.
    """
    severity = description = None
    for level, conditions in (DEFAULT_RULES if rules is None else rules).items():
        for rule in conditions:
            holds = F.expr(rule["query"])
            start = F if severity is None else severity
            start_d = F if description is None else description
            severity = start.when(holds, F.lit(level))
            description = start_d.when(holds, F.lit(rule["description"]))
    if severity is None:
        return F.lit(UNKNOWN[0]), F.lit(UNKNOWN[1])
    return severity.otherwise(F.lit(UNKNOWN[0])), description.otherwise(F.lit(UNKNOWN[1]))


def rate(findings: DataFrame, rules: Rules | None = None) -> DataFrame:
    severity, description = severity_of(rules)
    return findings.withColumns({"severity": severity, "severity_description": description})
