"""Sensitive-data discovery as Spark jobs."""

from cellsift.catalog import DEFAULT_CATALOG, Detector, as_catalog, load_catalog
from cellsift.functions.matching import scan_text
from cellsift.functions.text import redact
from cellsift.operators.alerts import alerts, outbox, suppress, tickets
from cellsift.operators.report import grouped, numbered, report_table, source_totals
from cellsift.operators.scan import any_hit, quick_exit, redact_document, scan, scan_pattern
from cellsift.operators.severity import rate
from cellsift.plans.scan_plan import alerts_for, remember, scan_connection, tickets_for
from cellsift.schema import FINDING_SCHEMA, conform
from cellsift.session import session

__all__ = [
    "DEFAULT_CATALOG",
    "Detector",
    "FINDING_SCHEMA",
    "alerts",
    "alerts_for",
    "any_hit",
    "as_catalog",
    "conform",
    "grouped",
    "load_catalog",
    "numbered",
    "outbox",
    "quick_exit",
    "rate",
    "redact",
    "redact_document",
    "remember",
    "report_table",
    "scan",
    "scan_connection",
    "scan_pattern",
    "scan_text",
    "session",
    "source_totals",
    "suppress",
    "tickets",
    "tickets_for",
]
