"""Registered queries of the detection core."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.catalog import DEFAULT_CATALOG
from cellsift.functions.matching import scan_text
from cellsift.functions.sql import register
from cellsift.functions.text import redact, sample_text
from cellsift.operators.scan import any_hit, quick_exit, redact_document, scan, scan_pattern
from cellsift.operators.severity import rate
from cellsift.plans.audit import (
    AUDIT_CATALOG,
    DENSE_CATALOG,
    SEVERITY_SQL,
    findings_sql,
    joined,
    listed_sql,
    quoted,
    redact_sql,
    texts,
)
from cellsift.schema import conform, locate


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", "text")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in all documents, counted by detector and severity."""
    rated = rate(scan(_documents(spark, sf), "text", AUDIT_CATALOG))
    return rated.groupBy("pattern_name", "severity").agg(
        F.count("*").alias("findings"), F.sum(F.col("total_exposed").cast("long")).alias("total_exposed")
    )


FLAGSHIP_SQL = f"""
SELECT pattern_name, {SEVERITY_SQL} AS severity, count(*) AS findings, CAST(sum(len(m)) AS BIGINT) AS total_exposed
FROM {findings_sql('documents', 'doc_id', 'text')} AS f GROUP BY ALL"""


def multi_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(_documents(spark, sf), "text", AUDIT_CATALOG))


def multi_pattern_pages(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(texts(spark, sf, "pages").select("page_id", "html"), "html", DENSE_CATALOG))


def multi_pattern_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(texts(spark, sf, "conversations").drop("role"), "text", DENSE_CATALOG))


def single_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan_pattern(_documents(spark, sf), "ipv4", "text", AUDIT_CATALOG))


_SHOUTED = {"words": "THE[A-Z]+|Ent[a-z]+"}


def case_insensitive(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(_documents(spark, sf), "text", _SHOUTED))


_GROUPED = {"prefix": r"(th|er)[a-z]{4}", "no_group": r"[0-9]{5}", "two_groups": r"(an)(d[a-z]+)"}


def group_mode(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(_documents(spark, sf), "text", _GROUPED, group_mode="first"))


_CUSTOM = {"ticket": r"[a-z]+ [0-9]+", "year": r"(?:19|20)[0-9]{2}"}


def custom_catalog(spark: SparkSession, sf: str) -> DataFrame:
    pages = texts(spark, sf, "pages").select("page_id", "html")
    return joined(scan(pages, "html", _CUSTOM))


# The built-in detectors as RE2 spells them. RE2 has no Unicode word boundary, so the three bounded ones take in one
# neighbouring character and give their group.
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_END = r"(?:[^\p{L}\p{N}_]|$)"
_BOUNDED = {
    "Email": rf"{_EDGE}([a-z0-9_][a-z0-9._%+-]*@[a-z0-9.-]+\.[a-z]{{2,}}){_END}",
    "Aadhar": rf"{_EDGE}([0-9]{{4}}[-.]?[0-9]{{4}}[-.]?[0-9]{{4}}){_END}",
    "PAN": rf"{_EDGE}([a-z]{{5}}[0-9]{{4}}[a-z]){_END}",
}
RE2_DEFAULT = {d.name: _BOUNDED.get(d.name, d.pattern) for d in DEFAULT_CATALOG}
RE2_GROUPS = {name: 1 for name in _BOUNDED}


def default_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """All built-in detectors over all three text tables."""
    parts = [
        texts(spark, sf, name).selectExpr(f"'{name}' AS tbl", f"{key} AS id", f"{text} AS text")
        for name, key, text in (
            ("documents", "doc_id", "text"),
            ("pages", "page_id", "html"),
            ("conversations", "conv_id * 100 + turn", "text"),
        )
    ]
    return joined(scan(reduce(DataFrame.unionByName, parts), "text"))


_DEFAULT_CELLS = """(SELECT 'documents' AS tbl, doc_id AS id, text FROM documents
UNION ALL SELECT 'pages', page_id, html FROM pages
UNION ALL SELECT 'conversations', conv_id * 100 + turn, text FROM conversations)"""

# One token per built-in detector, made of hashes of the row: h is 64 hex digits, hu the same in capitals,
# d sixteen decimal digits. Written as concatenations that Spark SQL and DuckDB both evaluate.
_UUID = "substr(h,1,8) || '-' || substr(h,9,4) || '-' || substr(h,13,4) || '-' || substr(h,17,4) || '-' || substr(h,21,12)"
_PARTS = {
    "Email": "substr(h,1,8) || '.x@' || substr(h,9,6) || '.example.com'",
    "Aadhar": "substr(d,1,4) || '-' || substr(d,5,4) || '-' || substr(d,9,4)",
    "PAN": "'QWERT' || substr(d,1,4) || 'Z'",
    "Amazon MWS Auth Token": f"'amzn.' || 'mws.' || {_UUID}",
    "Amazon SNS Topic Disclosure": "'arn:aws:' || 'sns:us-east-1:' || substr(d,1,12) || ':Topic_' || substr(h,1,5)",
    "AWS Access Key ID": "'AK' || 'IA' || substr(hu,1,16)",
    "Cloudinary Credentials Disclosure": "'cloudinary' || '://' || substr(d,1,15) || ':' || substr(h,1,20) || '@' || substr(h,21,8)",
    "FCM Server Key": "'AA' || 'AA' || substr(h,1,7) || ':' || h || h || substr(h,1,12)",
    "Mailchimp API": "substr(h,1,32) || '-u' || 's' || substr(d,1,2)",
    "Slack access token": "'xo' || 'xb-' || substr(h,1,51)",
    "Slack User token disclosure": "'xo' || 'xp-' || h || substr(h,1,8)",
    "Slack Webhook": "'https://hooks.' || 'slack.com/services/T' || substr(hu,1,10) || '/B' || substr(hu,11,10) || '/' || substr(h,1,23)",
    "SonarQube Token": "'sonar' || '.login = \"' || substr(h,1,40) || '\"'",
    "AWS Cognito Pool ID": f"':' || {_UUID}",
    "Basic Auth Credentials": "'ftp' || '://' || substr(h,1,6) || ':' || substr(h,7,8) || '@' || substr(h,15,6)",
    "Dynatrace Token": "'dt' || '0c' || substr(d,1,2) || '.' || substr(hu,1,24) || '.' || hu",
    "Facebook Client ID": "'facebook' || '_id=''' || substr(d,1,15) || ''''",
    "Facebook Secret Key": "'fb' || '_key=\"' || substr(h,1,32) || '\"'",
    "Google (GCP) Service-account": "'\"type\": \"service' || '_account\"'",
    "Google API key": "'AI' || 'za' || substr(h,1,35)",
    "Linkedin Client ID": "'linkedin' || ':: ' || substr(h,1,12)",
    "Mailgun API Key": "'ke' || 'y-' || substr(h,1,32)",
    "Paypal Braintree Access Token": "'access_token' || '$production$' || substr(h,1,16) || '$' || substr(h,17,32)",
    "Pictatic API Key": "'sk_' || 'live_' || substr(h,1,32)",
    "Sendgrid API Key": "'S' || 'G.' || substr(h,1,22) || '.' || substr(h,1,43)",
    "Shopify Custom App Access Token": "'shp' || 'ca_' || substr(h,1,32)",
    "Shopify Private App Access Token": "'shp' || 'pa_' || substr(h,1,32)",
    "Shopify Shared Secret": "'shp' || 'ss_' || substr(h,1,32)",
    "Square Accesss Token": "'sq0' || 'atp-' || substr(h,1,22)",
    "Square OAuth Secret": "'sq0' || 'csp-' || substr(h,1,43)",
    "Twilio API Key": "'twilio' || ' = SK' || substr(h,1,32)",
    "Twitter Secret": "'twitter' || ' ' || substr(h,1,40)",
}


_PLANTED = f"concat_ws(' ~ ', text, {', '.join(_PARTS.values())}, 'end')"


def default_catalog_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in detectors over messages into which a made-up token of nearly every kind is put."""
    rows = texts(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "text", "sha2(concat(cast(conv_id as string), '/', cast(turn as string)), 256) AS h"
    )
    rows = rows.selectExpr("*", "upper(h) AS hu", "translate(substr(h, 1, 16), 'abcdef', '123456') AS d")
    planted = rows.selectExpr("conv_id", "turn", f"{_PLANTED} AS text")
    phones = rows.selectExpr(
        "conv_id", "turn + 100 AS turn", "concat('(+1 ', substr(d,1,3), ')-', substr(d,4,3), '-', substr(d,7,4)) AS text"
    )
    return joined(scan(planted.unionByName(phones), "text"))


_PLANTED_CELLS = f"""(WITH r AS (SELECT conv_id, turn, text, sha256(CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)) AS h FROM conversations),
 s AS (SELECT *, upper(h) AS hu, translate(substr(h, 1, 16), 'abcdef', '123456') AS d FROM r)
 SELECT conv_id, turn, {_PLANTED} AS text FROM s
 UNION ALL SELECT conv_id, turn + 100, '(+1 ' || substr(d,1,3) || ')-' || substr(d,4,3) || '-' || substr(d,7,4) FROM s)"""

_PADDED = {"padded": r"\s+[0-9]+\s*", "with_break": r"[0-9]{2}\s"}


def trim_matches(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(_documents(spark, sf), "text", _PADDED))


def distinct_matches(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(texts(spark, sf, "pages").select("page_id", "html"), "html", {"tag": "<[a-z0-9]+"}))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "documents").select("doc_id", sample_text(F.col("text")).alias("sample_text"))


def redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted words of every length, and redacted samples, of each message."""
    return texts(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.array_join(F.transform(F.split("text", " "), redact), " ").alias("words"),
        sample_text(F.col("text"), redacted=True).alias("sample_text"),
    )


def redact_then_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return joined(scan(_documents(spark, sf), "text", DENSE_CATALOG, redacted=True))


def exposed_count(spark: SparkSession, sf: str) -> DataFrame:
    found = scan(_documents(spark, sf), "text", DENSE_CATALOG)
    return found.select("doc_id", "pattern_name", "total_exposed")


def hit_cells(spark: SparkSession, sf: str) -> DataFrame:
    return any_hit(texts(spark, sf, "documents").select("doc_id", "lang", "text"), "text", AUDIT_CATALOG).select(
        "doc_id", "lang", F.length("text").alias("chars")
    )


def locators(spark: SparkSession, sf: str) -> DataFrame:
    cells = locate(
        texts(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", "text"),
        "couchdb",
        host="db.example.org",
        database=F.col("source"),
        field=F.lit("text"),
        profile=F.col("lang"),
    ).drop("lang", "source")
    found = conform(rate(scan(cells, "text", AUDIT_CATALOG)))
    return joined(found).select(
        "data_source", "profile", "host", "database", "doc_id", "field", "bucket", "pattern_name", "matches", "severity"
    )


def first_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Every bucket stops after 25 findings; documents are read in the order of their id."""
    docs = texts(spark, sf, "documents").select("source", "doc_id", "text")
    return joined(quick_exit(scan(docs, "text", DENSE_CATALOG), 25, ("source",), ("doc_id",)))


_QUICK_SQL = f"""
WITH f AS (SELECT * FROM {findings_sql('documents', 'source, doc_id', 'text', DENSE_CATALOG)} AS a),
n AS (SELECT source, doc_id, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT source, doc_id, pattern_name, array_to_string(m, '|') AS matches, CAST(len(m) AS INTEGER) AS total_exposed, sample_text
FROM f JOIN b USING (source, doc_id) WHERE before < 25"""


def column_function(spark: SparkSession, sf: str) -> DataFrame:
    """The scan as a column function inside an ordinary select."""
    found = texts(spark, sf, "pages").select("page_id", F.inline(scan_text("html", AUDIT_CATALOG)))
    return joined(found).withColumn("total_exposed", F.size(F.split("matches", r"\|")))


def sql_redact(spark: SparkSession, sf: str) -> DataFrame:
    register(spark)
    return texts(spark, sf, "pages").selectExpr("page_id", "redact(url) AS url", "redact(html) AS page")


def masked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts with their addresses of two kinds starred out."""
    return redact_document(texts(spark, sf, "documents").select("doc_id", "text"), "text", _MASKED).select("doc_id", "redacted")


_MASKED = {"email": AUDIT_CATALOG["email"], "ipv4": AUDIT_CATALOG["ipv4"]}
_MATCHES_SQL = "list_concat(" + ", ".join(f"regexp_extract_all(text, {quoted(rx)}, 0, 'i')" for rx in _MASKED.values()) + ")"
_MASKED_SQL = f"""
WITH RECURSIVE found AS (SELECT doc_id, text, list_transform(list_sort(list_transform(list_distinct({_MATCHES_SQL}),
 lambda m: {{'n': -length(m), 'm': m}})), lambda k: k.m) AS ms FROM documents),
steps(doc_id, i, n, ms, done) AS (SELECT doc_id, 0, len(ms), ms, text FROM found UNION ALL
 SELECT doc_id, i + 1, n, ms, replace(done, ms[i + 1], {redact_sql('(ms[i + 1])')}) FROM steps WHERE i < n)
SELECT doc_id, done AS redacted FROM steps WHERE i = n"""


def _listed(cells: str, ids: str, text: str = "text", catalog=AUDIT_CATALOG, **options) -> str:
    return listed_sql(findings_sql(cells, ids, text, catalog, **options), ids)


_ANY_SQL = " OR ".join(f"len(regexp_extract_all(text, {quoted(rx)}, 0, 'i')) > 0" for rx in AUDIT_CATALOG.values())

QUERIES = {
    "findings_by_severity": (flagship, FLAGSHIP_SQL),
    "scan_multi_pattern": (multi_pattern, _listed("documents", "doc_id")),
    "scan_multi_pattern_pages": (multi_pattern_pages, _listed("pages", "page_id", "html", DENSE_CATALOG)),
    "scan_multi_pattern_conversations": (
        multi_pattern_conversations,
        _listed("conversations", "conv_id, turn", "text", DENSE_CATALOG),
    ),
    "scan_single_pattern": (
        single_pattern,
        _listed("documents", "doc_id", catalog={"ipv4": AUDIT_CATALOG["ipv4"]}),
    ),
    "scan_case_insensitive": (case_insensitive, _listed("documents", "doc_id", catalog=_SHOUTED)),
    "scan_group_mode": (group_mode, _listed("documents", "doc_id", catalog=_GROUPED, groups={"prefix": 1})),
    "scan_custom_catalog": (custom_catalog, _listed("pages", "page_id", "html", _CUSTOM)),
    "scan_default_catalog": (
        default_catalog,
        _listed(_DEFAULT_CELLS, "tbl, id", catalog=RE2_DEFAULT, groups=RE2_GROUPS),
    ),
    "scan_default_catalog_planted": (
        default_catalog_planted,
        _listed(_PLANTED_CELLS, "conv_id, turn", catalog=RE2_DEFAULT, groups=RE2_GROUPS),
    ),
    "scan_trim_matches": (trim_matches, _listed("documents", "doc_id", catalog=_PADDED)),
    "scan_distinct_matches": (distinct_matches, _listed("pages", "page_id", "html", {"tag": "<[a-z0-9]+"})),
    "scan_sample_text": (samples, "SELECT doc_id, substring(text, 1, 50) AS sample_text FROM documents"),
    "scan_redact": (
        redaction,
        "SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: "
        f"{redact_sql('w')}), ' ') AS words, {redact_sql('(substring(text, 1, 50))')} AS sample_text FROM conversations",
    ),
    "scan_redact_then_dedupe": (
        redact_then_dedupe,
        _listed("documents", "doc_id", catalog=DENSE_CATALOG, redacted=True),
    ),
    "scan_redact_document": (masked_documents, _MASKED_SQL),
    "scan_exposed_count": (
        exposed_count,
        "SELECT doc_id, pattern_name, CAST(len(m) AS INTEGER) AS total_exposed FROM "
        f"{findings_sql('documents', 'doc_id', 'text', DENSE_CATALOG)} AS f",
    ),
    "scan_any_hit": (
        hit_cells,
        f"SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS chars FROM documents WHERE {_ANY_SQL}",
    ),
    "scan_locators": (
        locators,
        "SELECT 'couchdb' AS data_source, lang AS profile, 'db.example.org' AS host, source AS database, "
        "CAST(doc_id AS VARCHAR) AS doc_id, 'text' AS field, CAST(NULL AS VARCHAR) AS bucket, pattern_name, "
        f"array_to_string(m, '|') AS matches, {SEVERITY_SQL} AS severity "
        f"FROM {findings_sql('documents', 'doc_id, lang, source', 'text')} AS f",
    ),
    "scan_quick_exit": (first_objects, _QUICK_SQL),
    "fn_scan": (column_function, _listed("pages", "page_id", "html")),
    "fn_sql_redact": (
        sql_redact,
        f"SELECT page_id, {redact_sql('url')} AS url, {redact_sql('html')} AS page FROM pages",
    ),
}
