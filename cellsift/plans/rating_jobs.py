"""Registered queries of severity rules, reports, alerts and tickets.

Documents are dealt out over all kinds of source, so every kind of place and alert text occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.operators import alerts as al
from cellsift.operators import report as rp
from cellsift.operators.ledger import Ledger
from cellsift.operators.scan import scan
from cellsift.operators.severity import rate
from cellsift.plans.audit import (
    DENSE_CATALOG,
    SEVERITY_SQL,
    SEVERITY_TEXT_SQL,
    SHOWN_SQL,
    findings_sql,
    table,
    texts,
)
from cellsift.schema import LOCATORS, conform
from cellsift.session import scratch, written

_SOURCES = tuple(LOCATORS)

# What each locator column holds, spelled for both engines; a source only fills its own columns.
_PLACES = {
    "host": "'h' || lang",
    "database": "source",
    "table": "'t_' || lang",
    "column": "'text'",
    "collection": "'c_' || lang",
    "field": "'body'",
    "doc_id": "id",
    "key": "'k:' || id",
    "bucket": "'b-' || source",
    "file_path": "'/' || lang || '/' || id || '.txt'",
    "file_id": "id",
    "file_name": "'file ' || id",
    "user": "'u' || lang",
    "channel_id": "'C' || id",
    "channel_name": "'room ' || source",
    "message_link": "'https://team.example.com/archives/C' || id",
}


def _case(column: str, value: str) -> str:
    kinds = ", ".join(f"'{s}'" for s in _SOURCES if column in LOCATORS[s])
    return f"CASE WHEN data_source IN ({kinds}) THEN {value} END"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents").selectExpr("cast(doc_id as string) AS id", "doc_id AS n", "lang", "source", "text")
    kind = F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("n") % len(_SOURCES) + 1).cast("int"))
    return docs.withColumn("data_source", kind).selectExpr(
        "data_source",
        "lang AS profile",
        *[f"{_case(c, v)} AS `{c}`" for c, v in _PLACES.items()],
        "text",
        "id AS row_key",
    )


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return conform(scan(_cells(spark, sf), "text", DENSE_CATALOG), extra=("row_key",))


_LIST = "[" + ", ".join(f"'{s}'" for s in _SOURCES) + "]"
_IDS = "id, lang, source, data_source"
FOUND = f"""(SELECT data_source, lang AS profile, id AS row_key,
{', '.join(f'{_case(c, v)} AS "{c}"' for c, v in _PLACES.items())}, pattern_name, m, sample_text
FROM {findings_sql(f"(SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, text, {_LIST}[doc_id % {len(_SOURCES)} + 1] AS data_source FROM documents)", _IDS, 'text', DENSE_CATALOG)} AS f0)"""

# --- severity -------------------------------------------------------------------------------------------------------

RULES = {
    "Highest": [
        {"query": "size(matches) > 10 AND pattern_name IN ('words', 'email')", "description": "many words or addresses"},
        {"query": "pattern_name = 'card16' AND data_source = 's3'", "description": "cards in a bucket"},
    ],
    "High": [
        {"query": "size(matches) > 10 AND data_source = 'slack'", "description": "never reached for words"},
        {"query": "bucket > 'b-src10' AND pattern_name = 'digits'", "description": "null where there is no bucket"},
    ],
    "Medium": [
        {
            "query": "size(matches) > 5 AND size(matches) <= 10 AND data_source = 'fs' AND profile = 'de'",
            "description": "some in German files",
        }
    ],
    "Low": [{"query": "size(matches) <= 2", "description": "one or two"}],
}


def _rated(df: DataFrame) -> DataFrame:
    return df.select("row_key", "data_source", "profile", "pattern_name", "severity", "severity_description")


def severity_default(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(rate(findings(spark, sf)))


def severity_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(rate(findings(spark, sf), RULES))


def severity_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(rate(findings(spark, sf), RULES)).where("severity = 'unknown'")


_PREDICATES = {
    "count": [{"query": "size(matches) > 3", "description": "count comparison"}],
    "name": [{"query": "pattern_name IN ('EMAIL', 'ipv4')", "description": "name in a list, case counts"}],
    "source": [{"query": "data_source = 'redis'", "description": "source"}],
    "both": [{"query": "profile = 'en' AND pattern_name = 'email'", "description": "profile and name"}],
}


def severity_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(rate(findings(spark, sf), _PREDICATES))


def severity_per_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rated findings grouped by source, in pages of at most 200."""
    rated = rate(findings(spark, sf), RULES)
    pages = rp.grouped(rated, ["row_key", "pattern_name"], 200)
    return pages.select(
        "data_source",
        "page",
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["row_key"], f["pattern_name"], f["severity"])), ";").alias("rated"),
    )


_RULES_SQL = """CASE WHEN len(m) > 10 AND pattern_name IN ('words', 'email') THEN 'Highest/many words or addresses'
WHEN pattern_name = 'card16' AND data_source = 's3' THEN 'Highest/cards in a bucket'
WHEN len(m) > 10 AND data_source = 'slack' THEN 'High/never reached for words'
WHEN bucket > 'b-src10' AND pattern_name = 'digits' THEN 'High/null where there is no bucket'
WHEN len(m) > 5 AND len(m) <= 10 AND data_source = 'fs' AND profile = 'de' THEN 'Medium/some in German files'
WHEN len(m) <= 2 THEN 'Low/one or two' ELSE 'unknown/No matching rule found.' END"""
_PREDICATES_SQL = """CASE WHEN len(m) > 3 THEN 'count/count comparison'
WHEN pattern_name IN ('EMAIL', 'ipv4') THEN 'name/name in a list, case counts' WHEN data_source = 'redis' THEN 'source/source'
WHEN profile = 'en' AND pattern_name = 'email' THEN 'both/profile and name' ELSE 'unknown/No matching rule found.' END"""


def _rated_sql(case: str, where: str = "TRUE") -> str:
    return (
        "SELECT row_key, data_source, profile, pattern_name, split_part(s, '/', 1) AS severity, "
        f"split_part(s, '/', 2) AS severity_description FROM (SELECT *, {case} AS s FROM {FOUND} AS f) AS r WHERE {where}"
    )


# --- reports --------------------------------------------------------------------------------------------------------


def group_by_source(spark: SparkSession, sf: str) -> DataFrame:
    pages = rp.grouped(findings(spark, sf), ["row_key", "pattern_name"], 50)
    return pages.select(
        "data_source",
        "page",
        F.size("findings").alias("n"),
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["row_key"], f["pattern_name"])), ";").alias("listed"),
    )


_NUMBERED_SQL = f"""(SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY row_key, pattern_name) AS sl_no FROM {FOUND} AS f)"""


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    """Each finding as JSON text; compared by some of its fields."""
    lines = rp.finding_json(rate(findings(spark, sf)))
    fields = [F.get_json_object("finding", f"$.{c}").alias(c) for c in ("row_key", "pattern_name", "severity", "sample_text")]
    return lines.select("data_source", *fields, F.get_json_object("finding", "$.matches[0]").alias("first_match"))


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return rp.source_totals(findings(spark, sf))


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return rp.numbered(findings(spark, sf), ["row_key", "pattern_name"]).select(
        "data_source", "sl_no", "row_key", "pattern_name"
    )


def locations(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).select("row_key", "data_source", "pattern_name", rp.location().alias("location"))


_LOCATION_SQL = """CASE WHEN data_source IN ('mysql', 'postgresql') THEN concat_ws(' > ', host, database, "table" || '.' || "column")
WHEN data_source = 'mongodb' THEN concat_ws(' > ', host, database, collection, field)
WHEN data_source = 'couchdb' THEN concat_ws(' > ', host, database, doc_id, field)
WHEN data_source = 'redis' THEN concat_ws(' > ', host, key)
WHEN data_source IN ('s3', 'gcs', 'firebase') THEN concat_ws(' > ', bucket, file_path)
WHEN data_source = 'fs' THEN file_path WHEN data_source = 'slack' THEN concat_ws(' > ', channel_name, message_link)
WHEN data_source = 'gdrive' THEN file_name WHEN data_source = 'gdrive_workspace' THEN concat_ws(' > ', file_name, "user")
ELSE '' END"""


def shown(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).select("row_key", "pattern_name", rp.shown_matches().alias("exposed_values"))


def report_table(spark: SparkSession, sf: str) -> DataFrame:
    return rp.report_table(findings(spark, sf), ["row_key", "pattern_name"])


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rp.severity_matrix(rate(findings(spark, sf)))


# --- alerts ---------------------------------------------------------------------------------------------------------

_MENTION = "<@security>"


def _line(title: str, column: str) -> str:
    return f"'{title}: ' || coalesce(\"{column}\", '') || chr(10)"


_LABEL_SQL = "CASE data_source " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in al.SOURCE_LABELS.items()) + " END"
_HDTC = [_line("Host", "host"), _line("Database", "database")]
_LINES_SQL = {
    "mysql": [*_HDTC, _line("Table", "table"), _line("Column", "column")],
    "postgresql": [*_HDTC, _line("Table", "table"), _line("Column", "column")],
    "mongodb": [*_HDTC, _line("Collection", "collection"), _line("Field", "field")],
    "couchdb": [*_HDTC, _line("Document ID", "doc_id"), _line("Field", "field")],
    "redis": [_HDTC[0], _line("Key", "key")],
    "s3": [_line("Bucket", "bucket"), _line("File Path", "file_path")],
    "gcs": [_line("Bucket", "bucket"), _line("File Path", "file_path")],
    "firebase": [_line("Bucket", "bucket"), _line("File Path", "file_path")],
    "fs": [_line("File Path", "file_path")],
    "slack": [_line("Channel Name", "channel_name"), _line("Message Link", "message_link")],
    "gdrive": [_line("File Name", "file_name")],
    "gdrive_workspace": [_line("File Name", "file_name"), _line("User", "user")],
    "text": ["''"],
}
_PLACE_SQL = "CASE data_source " + " ".join(f"WHEN '{s}' THEN {' || '.join(x)}" for s, x in _LINES_SQL.items()) + " END"
_MESSAGE_SQL = (
    f"'*** PII Or Secret Found ***' || chr(10) || 'Data Source: ' || {_LABEL_SQL} || ' - ' || profile || chr(10) || {_PLACE_SQL} "
    f"|| 'Pattern Name: ' || pattern_name || chr(10) || 'Total Exposed: ' || CAST(len(m) AS VARCHAR) || chr(10) "
    f"|| 'Exposed Values: ' || {SHOWN_SQL}"
)
_HASH_SQL = (
    "sha256(array_to_string(list_filter(string_split(message, chr(10)), lambda x: NOT contains(x, 'Message Link')), chr(10)))"
)
_ALERTS_SQL = f"(SELECT *, {_HASH_SQL} AS msg_hash FROM (SELECT *, {_MESSAGE_SQL} AS message FROM {FOUND} AS f) AS a)"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return al.alerts(findings(spark, sf), _MENTION).select("row_key", "pattern_name", "message")


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return al.alerts(findings(spark, sf)).select("row_key", "pattern_name", "msg_hash")


def _run_and_history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Alerts of this run, from a stored finding table, and hashes of an earlier run over the labelled documents."""
    now = al.alerts(written(findings(spark, sf), "findings"))
    labelled = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("row_key"))
    return now, now.join(labelled, "row_key", "left_semi").select("msg_hash")


def suppress_history(spark: SparkSession, sf: str) -> DataFrame:
    now, history = _run_and_history(spark, sf)
    fresh = al.unseen(now, history)
    return fresh.select("row_key", "pattern_name", "msg_hash")


_SEEN_SQL = f"""
WITH a AS MATERIALIZED (SELECT row_key, pattern_name, message, msg_hash FROM {_ALERTS_SQL} AS x),
seen AS (SELECT msg_hash FROM a WHERE row_key IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))"""


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of text findings only by profile and value, so equal ones occur."""
    found = findings(spark, sf).withColumn("data_source", F.lit("text"))
    return al.alerts(found)


_COPIES_SQL = f"(SELECT *, {_HASH_SQL} AS msg_hash FROM (SELECT *, {_MESSAGE_SQL} AS message FROM (SELECT * REPLACE ('text' AS data_source) FROM {FOUND} AS f) AS g) AS a)"


def suppress_within_run(spark: SparkSession, sf: str) -> DataFrame:
    return al.first_of_each(_copies(spark, sf), ["row_key", "pattern_name"]).select("row_key", "pattern_name", "msg_hash")


def suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """Both ways of suppression, as a run does them."""
    now, history = _run_and_history(spark, sf)
    left = al.suppress(now, history, order=["row_key", "pattern_name"])
    return left.select("row_key", "pattern_name", "msg_hash")


def history_append(spark: SparkSession, sf: str) -> DataFrame:
    """History table after two runs: an earlier one over the labelled documents, then all that was still unseen."""
    now, earlier = _run_and_history(spark, sf)
    path = scratch(spark, "history")
    al.append_history(earlier, path)
    al.append_history(al.suppress(now, spark.read.parquet(path), order=["row_key", "pattern_name"]), path)
    return spark.read.parquet(path)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by the digits of the document's number; every run comes twice, as after a failure, and two make a base."""
    now, book = written(_copies(spark, sf), "findings"), Ledger(spark, scratch(spark, "ledger"), compact_after=2)
    runs = sorted(r.n for r in now.select(F.length("row_key").alias("n")).distinct().collect())
    for run in [n for n in runs for _ in range(2)]:
        book.send(now.where(F.length("row_key") == run), run, ["row_key", "pattern_name"])
    return book.all_sent().select("run", "msg_hash", F.get_json_object("payload", "$.text").alias("text"))


_LEDGER_SQL = f"""
SELECT CAST(min(length(row_key)) AS BIGINT) AS run, msg_hash, any_value(message) AS text FROM {_COPIES_SQL} AS x GROUP BY msg_hash"""


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    return al.outbox(al.alerts(findings(spark, sf))).select("msg_hash", F.get_json_object("payload", "$.text").alias("text"))


_TEMPLATE = "A data security issue.\n\n{details}\n\nRule: {pattern_name} in {profile} ({bucket})"


def ticket_payload(spark: SparkSession, sf: str) -> DataFrame:
    made = al.tickets(rate(al.alerts(findings(spark, sf))), "SEC", "Task", _TEMPLATE, ["scan", "pii"])
    path = {
        "summary": "summary",
        "description": "description",
        "project": "project.key",
        "issue_type": "issuetype.name",
        "priority": "priority.name",
        "label": "labels[1]",
    }
    return made.select(
        "row_key", "pattern_name", *[F.get_json_object("payload", f"$.fields.{p}").alias(c) for c, p in path.items()]
    )


_TICKET_SQL = f"""
SELECT row_key, pattern_name, 'Found ' || CAST(len(m) AS VARCHAR) || ' ' || pattern_name || ' in ' || data_source AS summary,
'A data security issue.' || chr(10) || chr(10) || message || chr(10) || chr(10) || 'Severity: ' || {SEVERITY_SQL} || chr(10)
|| 'Severity Description: ' || {SEVERITY_TEXT_SQL} || chr(10) || chr(10) || 'Rule: ' || pattern_name || ' in ' || profile
|| ' (' || coalesce(bucket, '') || ')' AS description,
'SEC' AS project, 'Task' AS issue_type, {SEVERITY_SQL} AS priority, 'pii' AS label FROM {_ALERTS_SQL} AS x"""


def assignee_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as mail addresses of orders' tickets, looked up in a table that knows only some of them."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("email")
    )
    known = table(spark, sf, "customer").where("c_nationkey % 2 = 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("account_id"),
    )
    return al.assign(orders, known)


QUERIES = {
    "severity_default": (severity_default, _rated_sql(f"{SEVERITY_SQL} || '/' || {SEVERITY_TEXT_SQL}")),
    "severity_rules": (severity_rules, _rated_sql(_RULES_SQL)),
    "severity_unknown": (severity_unknown, _rated_sql(_RULES_SQL, "s LIKE 'unknown/%'")),
    "severity_predicates": (severity_predicates, _rated_sql(_PREDICATES_SQL)),
    "severity_per_source_group": (
        severity_per_source,
        "SELECT data_source, (sl_no - 1) // 200 AS page, string_agg(row_key || ':' || pattern_name || ':' || "
        f"split_part({_RULES_SQL}, '/', 1), ';' ORDER BY sl_no) AS rated FROM {_NUMBERED_SQL} AS n GROUP BY ALL",
    ),
    "report_group_by_source": (
        group_by_source,
        "SELECT data_source, (sl_no - 1) // 50 AS page, CAST(count(*) AS INTEGER) AS n, "
        f"string_agg(row_key || ':' || pattern_name, ';' ORDER BY sl_no) AS listed FROM {_NUMBERED_SQL} AS n GROUP BY ALL",
    ),
    "report_json": (
        json_report,
        f"SELECT data_source, row_key, pattern_name, {SEVERITY_SQL} AS severity, sample_text, m[1] AS first_match FROM {FOUND} AS f",
    ),
    "report_source_totals": (
        totals,
        "SELECT data_source, count(*) AS total_findings, 'Total ' || CAST(count(*) AS VARCHAR) || ' findings in ' "
        f"|| data_source AS title FROM {FOUND} AS f GROUP BY data_source",
    ),
    "report_numbered": (numbered, f"SELECT data_source, sl_no, row_key, pattern_name FROM {_NUMBERED_SQL} AS n"),
    "report_location": (locations, f"SELECT row_key, data_source, pattern_name, {_LOCATION_SQL} AS location FROM {FOUND} AS f"),
    "report_top25_matches": (shown, f"SELECT row_key, pattern_name, {SHOWN_SQL} AS exposed_values FROM {FOUND} AS f"),
    "report_table": (
        report_table,
        f"SELECT data_source, sl_no, profile AS vulnerable_profile, {_LOCATION_SQL} AS location, pattern_name, "
        f"CAST(len(m) AS INTEGER) AS total_exposed, {SHOWN_SQL} AS exposed_values, sample_text FROM {_NUMBERED_SQL} AS n",
    ),
    "report_severity_matrix": (
        matrix,
        f"SELECT data_source, pattern_name, {SEVERITY_SQL} AS severity, count(*) AS findings, "
        f"CAST(sum(len(m)) AS BIGINT) AS total_exposed FROM {FOUND} AS f GROUP BY ALL",
    ),
    "alert_message": (
        messages,
        f"SELECT row_key, pattern_name, '{_MENTION} ' || message AS message FROM {_ALERTS_SQL} AS x",
    ),
    "alert_hash": (hashes, f"SELECT row_key, pattern_name, msg_hash FROM {_ALERTS_SQL} AS x"),
    "alert_suppress_history": (
        suppress_history,
        f"{_SEEN_SQL} SELECT row_key, pattern_name, msg_hash FROM a WHERE msg_hash NOT IN (SELECT msg_hash FROM seen)",
    ),
    "alert_suppress_within_run": (
        suppress_within_run,
        "SELECT row_key, pattern_name, msg_hash FROM (SELECT *, row_number() OVER (PARTITION BY msg_hash "
        f"ORDER BY row_key, pattern_name) AS n FROM {_COPIES_SQL} AS x) AS y WHERE n = 1",
    ),
    "alert_suppress": (
        suppressed,
        f"{_SEEN_SQL} SELECT row_key, pattern_name, msg_hash FROM (SELECT *, row_number() OVER (PARTITION BY msg_hash "
        "ORDER BY row_key, pattern_name) AS n FROM a) AS y WHERE n = 1 AND msg_hash NOT IN (SELECT msg_hash FROM seen)",
    ),
    "alert_history_append": (history_append, f"SELECT DISTINCT msg_hash FROM {_ALERTS_SQL} AS x"),
    "alert_outbox": (outbox, f"SELECT msg_hash, message AS text FROM {_ALERTS_SQL} AS x"),
    "alert_ledger": (ledger, _LEDGER_SQL),
    "ticket_payload": (ticket_payload, _TICKET_SQL),
    "ticket_assignee_lookup": (
        assignee_lookup,
        "SELECT 'c' || CAST(o_custkey AS VARCHAR) || '@example.org' AS email, o_orderkey, c_name AS account_id "
        "FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey % 2 = 0",
    ),
}
