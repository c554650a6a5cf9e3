"""Registered queries of file, object and drive sources.

Files are made by Spark from the given tables: either really written and read back, or rows in the shape the binary
file reader delivers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.functions.text import decode_utf8
from cellsift.operators.incremental import changed_objects, content_tag, listing_tag
from cellsift.operators.scan import scan
from cellsift.plans.audit import AUDIT_CATALOG, findings_sql, joined, listed_sql, table, texts
from cellsift.session import scratch
from cellsift.sources.drive import FOLDER_TYPE, NATIVE_TYPES, drive_listing
from cellsift.sources.files import (
    excluded_path,
    file_cells,
    file_kind,
    file_metadata,
    object_cells,
    read_files,
    skipped_files,
)
from cellsift.sources.lines import file_lines, scan_lines


def as_files(df: DataFrame, path, content) -> DataFrame:
    """Rows as the binary file reader would deliver them."""
    return df.select(
        path.alias("path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files, one folder per source, read back without two of the folders.

    Files hold many documents, so what is compared is the distinct matches per folder.
    """
    folder = scratch(spark, "tree")
    docs = texts(spark, sf, "documents").select("source", "text")
    docs.write.partitionBy("source").option("maxRecordsPerFile", 500).text(folder)
    cells = file_cells(read_files(spark, folder, ["source=src3", "source=src11", ".crc"]))
    found = scan(cells, "value", AUDIT_CATALOG, keep=("file_path",))
    return (
        found.select(
            F.regexp_extract("file_path", r"/source=([^/]+)/", 1).alias("source"),
            "pattern_name",
            F.explode("matches").alias("match"),
        )
        .distinct()
    )


_FILES_SQL = f"""
SELECT DISTINCT source, pattern_name, unnest(m) AS match
FROM {findings_sql("(SELECT source, text FROM documents WHERE NOT contains(source, 'src3') AND NOT contains(source, 'src11'))", 'source', 'text')} AS f"""

def files_by_line(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as text files, several lines each, read by line without one folder; findings of files, told by their folder and first match."""
    folder = scratch(spark, "lines")
    pages = texts(spark, sf, "pages").select(
        F.regexp_extract("url", r"example\.(\w+)", 1).alias("ending"), F.regexp_replace("html", "</p>", "</p>\r\n").alias("value")
    )
    pages.write.partitionBy("ending").option("maxRecordsPerFile", 500).text(folder)
    found = scan_lines(file_lines(spark, folder, ["ending=org"]), AUDIT_CATALOG)
    ending = F.regexp_extract("file_path", r"/ending=([^/]+)/", 1).alias("ending")
    return found.select(ending, "pattern_name", F.explode("matches").alias("match")).distinct()


_LINE_CELLS = """(SELECT regexp_extract(url, 'example\\.([a-z0-9_]+)', 1) AS ending, unnest(regexp_split_to_array(replace(html, '</p>', '</p>' || chr(10)),
'\\r\\n|\\n|\\r')) AS value FROM pages WHERE regexp_extract(url, 'example\\.([a-z0-9_]+)', 1) <> 'org')"""
_LINES_SQL = f"""
SELECT DISTINCT ending, pattern_name, unnest(m) AS match FROM {findings_sql(_LINE_CELLS, 'ending')} AS f"""

_EXCLUDED = ("/es/", "page=2", ".net")


def file_exclude(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.where(~excluded_path(F.col("url"), F.lit("https://m.ththth.example.org/en"), _EXCLUDED)).select(
        "page_id", "url"
    )


_EXCLUDE_SQL = """
SELECT page_id, url FROM pages WHERE NOT (
 (SELECT bool_or(contains(regexp_extract(url, '[^/]*$'), p)) FROM (VALUES ('/es/'), ('page=2'), ('.net')) AS v(p))
 OR (regexp_extract(url, '^(.*)/[^/]*$', 1) <> 'https://m.ththth.example.org/en'
     AND (SELECT bool_or(contains(regexp_extract(url, '^(.*)/[^/]*$', 1), p)) FROM (VALUES ('/es/'), ('page=2'), ('.net')) AS v(p))))"""


def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that are not UTF-8 before and after each text become replacement characters."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return texts(spark, sf, "documents").select("doc_id", F.md5(decode_utf8(raw)).alias("text_md5"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    listed = events.select(
        F.concat(F.lit("file:///data/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("path"),
        F.col("ts").cast("timestamp").alias("modificationTime"),
        F.octet_length("props").cast("long").alias("length"),
    )
    return file_metadata(listed)


def object_store(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as objects of buckets; keys with an excluded folder are dropped."""
    path = F.concat(F.lit("s3a://bucket-"), "source", F.lit("/texts/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    objects = as_files(texts(spark, sf, "documents"), path, F.encode("text", "UTF-8"))
    return joined(scan(object_cells(objects, ["/es/"]).drop("member_path"), "value", AUDIT_CATALOG))


_OBJECT_CELLS = """(SELECT 'bucket-' || source AS bucket, 'texts/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path,
text AS value FROM documents WHERE lang <> 'es')"""


def changed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose content tag differs from, or is missing in, a manifest of an earlier run."""
    docs = texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    now = docs.withColumn("tag", content_tag()).drop("content")
    old = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"), "quality")
    manifest = now.join(old, "path").select(
        "path", F.when(F.col("quality") == 1, F.col("tag")).otherwise(F.concat(F.lit("old-"), "tag")).alias("tag")
    )
    return changed_objects(now, manifest)


_CHANGED_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS tag FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""


def changed_rescan(spark: SparkSession, sf: str) -> DataFrame:
    """Tags from the listing alone; everything is kept and new objects are marked."""
    events = table(spark, sf, "events")
    now = events.select(
        F.col("event_id").cast("string").alias("path"),
        F.octet_length("props").cast("long").alias("length"),
        F.col("ts").cast("timestamp").alias("modificationTime"),
        "event_type",
    ).withColumn("tag", listing_tag())
    manifest = now.where(F.col("event_type") != "error").select("path", "tag")
    return changed_objects(now, manifest, rescan=True).select("path", "tag", "is_new")


_RESCAN_SQL = """
SELECT CAST(event_id AS VARCHAR) AS path, CAST(strlen(props) AS VARCHAR) || '-' || CAST(epoch_us(ts) AS VARCHAR) AS tag,
event_type = 'error' AS is_new FROM events"""


def drive(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as drive files of several owners: folders, native documents and plain files, in and below the root."""
    n = F.col("page_id")
    manifest = table(spark, sf, "pages").select(
        n.cast("string").alias("file_id"),
        F.concat(F.lit("page "), n.cast("string"), F.when(n % 3 == 0, F.lit(".txt")).otherwise(F.lit(""))).alias("file_name"),
        F.concat(F.lit("user"), (n % 4).cast("string"), F.lit("@example.org")).alias("owner"),
        F.when(n % 7 == 0, F.lit("sub")).otherwise(F.lit("root")).alias("parent"),
        F.when(n % 5 == 0, F.lit(FOLDER_TYPE))
        .when(n % 3 == 1, F.lit(NATIVE_TYPES[0]))
        .otherwise(F.lit("text/plain"))
        .alias("mime"),
    )
    users = ["user1@example.org", "user2@example.org", "nobody@example.org"]
    return drive_listing(manifest, "root", users, ["13"]).drop("path")


_DRIVE_SQL = f"""
WITH m AS (SELECT CAST(page_id AS VARCHAR) AS file_id,
 'page ' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '' END AS file_name,
 'user' || CAST(page_id % 4 AS VARCHAR) || '@example.org' AS owner,
 CASE WHEN page_id % 5 = 0 THEN '{FOLDER_TYPE}' WHEN page_id % 3 = 1 THEN '{NATIVE_TYPES[0]}' ELSE 'text/plain' END AS mime,
 page_id FROM pages)
SELECT file_id, file_name, file_name || CASE WHEN mime = '{NATIVE_TYPES[0]}' THEN '-runtime.pdf' ELSE '' END AS stored_name,
 owner AS user, owner, mime FROM m
WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id % 4 IN (1, 2) AND NOT contains(file_name, '13')"""


_ENDINGS = (".PNG", ".pdf", ".docx", ".tar.gz", ".mkv", ".gz", ".html", "", ".rar")


def _named_pages(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("page_id") % len(_ENDINGS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.concat("url", ending).alias("path"), F.octet_length("html").cast("long").alias("length"))


def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return _named_pages(spark, sf).select("page_id", "path", file_kind(F.col("path")).alias("file_kind"))


_NAMED_SQL = "(SELECT page_id, url || [" + ", ".join(f"'{e}'" for e in _ENDINGS) + f"][page_id % {len(_ENDINGS)} + 1] AS path, strlen(html) AS length FROM pages)"
_KIND_SQL = """CASE WHEN regexp_matches(lower(path), '\\.(png|jpg|jpeg|gif|bmp)$') THEN 'image' WHEN lower(path) LIKE '%.pdf' THEN 'pdf'
WHEN regexp_matches(lower(path), '\\.(docx|xlsx|pptx)$') THEN 'office' WHEN regexp_matches(lower(path), '\\.(mp4|avi|mov|mkv)$') THEN 'video'
WHEN regexp_matches(lower(path), '\\.(zip|rar|tar|tar\\.gz)$') THEN 'archive' ELSE 'text' END"""


def skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Files without a text reader are listed, not passed over."""
    return skipped_files(_named_pages(spark, sf))


QUERIES = {
    "src_files": (files, _FILES_SQL),
    "src_files_by_line": (files_by_line, _LINES_SQL),
    "src_file_exclude": (file_exclude, _EXCLUDE_SQL),
    "src_decode_text": (decode_text, "SELECT doc_id, md5(chr(65533) || text || chr(65533)) AS text_md5 FROM documents"),
    "src_file_metadata": (
        metadata,
        "SELECT '/data/' || event_type || '/' || CAST(event_id AS VARCHAR) AS file_path, CAST(strlen(props) AS BIGINT) AS file_size, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') AS modified_time FROM events",
    ),
    "src_object_store": (
        object_store,
        listed_sql(findings_sql(_OBJECT_CELLS, "bucket, file_path", "value"), "bucket, file_path"),
    ),
    "src_changed_objects": (changed, _CHANGED_SQL),
    "src_changed_objects_rescan": (changed_rescan, _RESCAN_SQL),
    "src_drive_listing": (drive, _DRIVE_SQL),
    "src_dispatch_by_type": (dispatch, f"SELECT page_id, path, {_KIND_SQL} AS file_kind FROM {_NAMED_SQL} AS p"),
    "src_skipped_files": (
        skipped,
        f"SELECT path AS file_path, length, {_KIND_SQL} AS file_kind FROM {_NAMED_SQL} AS p "
        f"WHERE {_KIND_SQL} IN ('image', 'pdf', 'video') OR lower(path) LIKE '%.rar'",
    ),
}
