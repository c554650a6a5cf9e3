"""Alert texts, suppression of repeats, and ticket payloads — tables only, nothing is sent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellsift.operators.report import shown_matches
from cellsift.operators.severity import Rules, rate, severity_of
from cellsift.schema import ORDER_COLUMNS

# Heading, source labels and locator lines of an alert text.
HEADING = "*** PII Or Secret Found ***"
LINK_LINE = "Message Link"
SOURCE_LABELS = {
    "s3": "S3 Bucket",
    "mysql": "MySQL",
    "postgresql": "PostgreSQL",
    "mongodb": "MongoDB",
    "redis": "Redis",
    "firebase": "Firebase",
    "gcs": "GCS",
    "fs": "File System",
    "slack": "Slack",
    "couchdb": "CouchDB",
    "gdrive": "Google Drive",
    "gdrive_workspace": "Google Drive Workspace",
    "text": "Text",
}
LINES = {
    "s3": ("bucket", "file_path"),
    "mysql": ("host", "database", "table", "column"),
    "postgresql": ("host", "database", "table", "column"),
    "mongodb": ("host", "database", "collection", "field"),
    "redis": ("host", "key"),
    "firebase": ("bucket", "file_path"),
    "gcs": ("bucket", "file_path"),
    "fs": ("file_path",),
    "slack": ("channel_name", "message_link"),
    "couchdb": ("host", "database", "doc_id", "field"),
    "gdrive": ("file_name",),
    "gdrive_workspace": ("file_name", "user"),
    "text": (),
}
LINE_TITLES = {"doc_id": "Document ID"}


def _title(column: str) -> str:
    return LINE_TITLES.get(column, column.replace("_", " ").title())


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def alert_message(mention: str = "") -> Column:
    """The alert text of a finding; ``mention`` goes in front of it."""
    places = labels = None
    for source, columns in LINES.items():
        here = F.col("data_source") == source
        lines = [F.concat(F.lit(f"{_title(c)}: "), _text(F.col(f"`{c}`")), F.lit("\n")) for c in columns]
        labels = (F if labels is None else labels).when(here, F.lit(SOURCE_LABELS[source]))
        places = (F if places is None else places).when(here, F.concat(*lines) if lines else F.lit(""))
    return F.concat(
        F.lit(f"{mention} " if mention else ""),
        F.lit(f"{HEADING}\nData Source: "),
        labels.otherwise(_text(F.col("data_source"))),
        F.lit(" - "),
        _text(F.col("profile")),
        F.lit("\n"),
        places.otherwise(F.lit("")),
        F.lit("Pattern Name: "),
        _text(F.col("pattern_name")),
        F.lit("\nTotal Exposed: "),
        _text(F.size("matches")),
        F.lit("\nExposed Values: "),
        _text(shown_matches()),
    )


def alert_hash(message: Column | str = "message") -> Column:
    """SHA-256 of a message without its link lines, so a message that only moved is the same alert."""
    m = F.col(message) if isinstance(message, str) else message
    lines = F.filter(F.split(m, "\n"), lambda line: ~line.contains(LINK_LINE))
    # never null, so that joins on it do not compute it once more to drop nulls
    return F.coalesce(F.sha2(F.array_join(lines, "\n"), 256), F.lit(""))


def alerts(findings: DataFrame, mention: str = "") -> DataFrame:
    """Findings with their ``message`` and ``msg_hash``."""
    return findings.withColumn("message", alert_message(mention)).withColumn("msg_hash", alert_hash())


def first_of_each(messages: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One alert per hash, the first in order. Tasks drop their own repeats before anything is shuffled."""
    order = order or [c for c in ORDER_COLUMNS if c in messages.columns]
    ranked = W.partitionBy("msg_hash").orderBy(*order, "message")
    return messages.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")


def unseen(messages: DataFrame, history: DataFrame) -> DataFrame:
    """Alerts whose hash is not in ``history(msg_hash)``."""
    return messages.join(history.select("msg_hash"), "msg_hash", "left_anti")


def suppress(
    messages: DataFrame,
    history: DataFrame | None,
    suppress_duplicates: bool = True,
    no_write: bool = False,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """What is left to send: no repeats within the run, none from earlier runs.

    Without ``suppress_duplicates``, or with ``no_write`` (no history is kept), everything is sent.
    """
    if not suppress_duplicates or no_write:
        return messages
    fresh = first_of_each(messages, order)
    return fresh if history is None else unseen(fresh, history)


def append_history(sent: DataFrame, path: str) -> None:
    """Add the hashes of sent alerts to the history table."""
    sent.select("msg_hash").distinct().write.mode("append").parquet(path)


def outbox(messages: DataFrame) -> DataFrame:
    """Chat payloads ``{"text": …}`` by hash."""
    return messages.select("msg_hash", F.to_json(F.struct(F.col("message").alias("text"))).alias("payload"))


def tickets(
    messages: DataFrame,
    project: str,
    issue_type: str,
    description_template: str = "{details}",
    labels: Sequence[str] = (),
    assignee: str | None = None,
    assignees: DataFrame | None = None,
    rules: Rules | None = None,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Ticket payloads, one per alert: ``summary, description, priority, account_id, payload``.

    Severity is that of ``rules``; without rules the one the finding has, or else the default.

    The template may name ``{details}`` (alert text and severity) and any column of the finding. ``assignee`` is an
    e-mail, looked up in ``assignees(email, account_id)``; an unknown one leaves the ticket unassigned.
    """
    rated = rate(messages, rules)
    if rules is None and "severity" in messages.columns:
        given = F.col("severity").isNotNull()
        severity, why = severity_of()
        rated = messages.withColumns(
            {
                "severity": F.when(given, F.col("severity")).otherwise(severity),
                "severity_description": F.when(given, F.col("severity_description")).otherwise(why),
            }
        )
    details = F.concat(
        F.col("message"),
        F.lit("\n\nSeverity: "),
        F.col("severity"),
        F.lit("\nSeverity Description: "),
        F.col("severity_description"),
    )
    summary = F.concat(
        F.lit("Found "),
        F.size("matches").cast("string"),
        F.lit(" "),
        F.col("pattern_name"),
        F.lit(" in "),
        F.col("data_source"),
    )
    rated = rated.withColumns({"summary": summary, "description": _fill(description_template, details, rated)})
    if assignee is not None:
        rated = _assigned(rated, assignee, assignees)
    fields = [
        F.struct(F.lit(project).alias("key")).alias("project"),
        F.col("summary"),
        F.col("description"),
        F.struct(F.lit(issue_type).alias("name")).alias("issuetype"),
        F.struct(F.col("severity").alias("name")).alias("priority"),
    ]
    if assignee is not None:
        fields.append(F.struct(F.col("account_id").alias("accountId")).alias("assignee"))
    if labels:
        fields.append(F.array(*[F.lit(x) for x in labels]).alias("labels"))
    for k, v in (extra or {}).items():
        fields.append(F.lit(v).alias(k))
    return rated.withColumns(
        {"priority": F.col("severity"), "payload": F.to_json(F.struct(F.struct(*fields).alias("fields")))}
    )


def _fill(template: str, details: Column, df: DataFrame) -> Column:
    parts = [F.lit("")]
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field == "details":
            parts.append(details)
        elif field == "matches":
            parts.append(F.array_join("matches", ", "))
        elif field is not None:
            if field not in df.columns:
                raise KeyError(f"the template names {field!r}, which findings do not have")
            parts.append(_text(F.col(f"`{field}`")))
    return F.concat(*parts)


def _assigned(df: DataFrame, email: str, assignees: DataFrame | None) -> DataFrame:
    """Every row with the account of one e-mail address, null if it is unknown."""
    if assignees is None:
        return df.withColumn("account_id", F.lit(None).cast("string"))
    named = df.withColumn("_email", F.lit(email)).drop("account_id")
    one = assignees.where(F.col("email") == email).select(F.col("email").alias("_email"), "account_id")
    one = one.groupBy("_email").agg(F.min("account_id").alias("account_id"))  # at most one row
    return named.join(F.broadcast(one), "_email", "left").drop("_email")


def assign(df: DataFrame, assignees: DataFrame) -> DataFrame:
    """``account_id`` of each row's ``email``. No hint: Spark broadcasts the look-up table if its size allows."""
    one_each = assignees.groupBy("email").agg(F.min("account_id").alias("account_id"))
    return df.join(one_each, "email", "left")
