"""A whole scan from one connection description, the way a user sets it up.

The description is a plain dict with the parts ``sources``, ``options``, ``severity_rules`` and ``notify``::

    {"sources": {"postgresql": {"shop": {"path": "/data/shop", "tables": ["orders"]}},
                 "fs": {"share": {"path": "/srv/share", "exclude_patterns": [".log"]}},
                 "text": {"note": {"text": "write to a@example.org"}}},
     "options": {"quick_exit": True, "max_matches": 5},
     "severity_rules": {"Highest": [{"query": "size(matches) > 10", "description": "many"}]},
     "notify": {"redacted": True, "suppress_duplicates": True, "slack": {"mention": "<@team>"}}}

Sources are read by Spark's own readers: JDBC or files for tables, JSON for documents, binary files for objects, and
exported tables for key-value stores, drives and chats.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.catalog import Catalog
from cellsift.operators import alerts as al
from cellsift.operators.early_exit import scan_until
from cellsift.operators.incremental import append_manifest
from cellsift.operators.ordering import row_range
from cellsift.operators.scan import quick_exit, scan
from cellsift.operators.severity import rate
from cellsift.schema import LOCATOR_COLUMNS, conform, locate
from cellsift.sources import tables
from cellsift.sources.chat import CHANNEL_TYPES, LOOKBACK_MINUTES, scan_chat, select_channels
from cellsift.sources.documents import key_value_cells, record_cells, scan_collections
from cellsift.sources.drive import drive_cells, drive_listing
from cellsift.sources.files import file_cells, in_buckets, listed_key, object_cells, read_changed, read_files, read_objects
from cellsift.sources.lines import PLACE, file_lines, scan_lines
from cellsift.sources.literal import literal_cells

Options = Mapping[str, object]
#: What a run opened, by kind and profile: rows of path and tag, and the cache they belong to.
Seen = dict[tuple[str, str], tuple[DataFrame, str]]

# Fixed value: default of a source's option.
DEFAULT_MAX_MATCHES = 1

_CELL_COLUMNS = ("data_source", "profile", *LOCATOR_COLUMNS, "value")


def _cells(df: DataFrame, kind: str, profile: str, also: Sequence[str] = (), **locators: object) -> DataFrame:
    df = locate(df, kind, profile, **locators)
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(c) for c in _CELL_COLUMNS],
        *[F.col(f"`{c}`") for c in also],
    )


def _load(spark: SparkSession, o: Options, path: object) -> DataFrame:
    return spark.read.format(str(o.get("format", "parquet"))).load(str(path))


def _table_cells(spark: SparkSession, kind: str, profile: str, o: Options) -> DataFrame:
    """``url`` reads by JDBC, ``path`` a folder per table, otherwise the session's catalogue.

    Whole tables are read. Only ``limit_start`` and ``limit_end`` (a number of rows) make a range, which then needs an
    ``order_by`` for every table.
    """
    if "url" in o:
        partitioning = {k: o[k] for k in ("partition_column", "bounds", "partitions", "properties") if k in o}
        partitioning = {**partitioning, "per_table": o.get("partitioning")}
        # What a database calls a schema: in MySQL the database itself.
        schema = str(o.get("schema") or (o["database"] if kind == "mysql" else "public"))
        reader = tables.jdbc_reader(spark, str(o["url"]), schema=schema, **partitioning)
        names = o.get("available") or tables.jdbc_tables(spark, str(o["url"]), schema, o.get("properties"))
    elif "path" in o:
        suffix = str(o.get("suffix", ""))
        names = list(o.get("available") or o.get("tables") or tables.folder_tables(spark, str(o["path"]), suffix))
        reader = lambda name: _load(spark, o, f"{o['path']}/{name}{suffix}")
    else:
        names = tables.catalog_tables(spark, o.get("database"))
        reader = tables.catalog_reader(spark, o.get("database"))
    cells = tables.scan_tables(
        names,
        reader,
        o.get("tables"),
        o.get("ids"),
        o.get("exclude_columns") or (),
        o.get("order_by"),
        int(o.get("limit_start") or 0),
        None if o.get("limit_end") is None else int(o["limit_end"]),
        kind,
        profile,
    )
    return _cells(cells, kind, profile, host=o.get("host"), database=o.get("database"))


def _document_cells(spark: SparkSession, kind: str, profile: str, o: Options) -> DataFrame:
    collections: Mapping[str, object] = o["collections"]
    key = str(o.get("id", "_id"))
    start, count = int(o.get("limit_start") or 0), o.get("limit_end")

    def reader(name: str) -> DataFrame:
        documents = _load(spark, {"format": "json", **o}, collections[name])
        return record_cells(row_range(documents, key, start, None if count is None else int(count)), key)

    cells = scan_collections(collections, reader, o.get("whitelist"), kind, profile)
    return _cells(cells, kind, profile, host=o.get("host"), database=o.get("database"))


def _redis_cells(spark: SparkSession, kind: str, profile: str, o: Options) -> DataFrame:
    return _cells(key_value_cells(_load(spark, o, o["path"])), kind, profile, host=o.get("host"))


def _opened(spark: SparkSession, kind: str, profile: str, o: Options, read, seen: Seen | None) -> DataFrame:
    """The files to scan: all, or with ``cache`` (a folder of path and tag) those that it does not hold.

    What a run opens under a cache goes into ``seen``, for the caller to append once the findings are stored.
    """
    path, excluded, glob = str(o["path"]), o.get("exclude_patterns") or (), o.get("glob")
    if "cache" not in o:
        return read(spark, path, excluded, glob)
    cache = str(o["cache"])
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.createDataFrame([], "path string, tag string")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(cache)
    files, new = read_changed(spark, path, known, excluded, glob, read)
    if seen is not None:
        seen[kind, profile] = (new, cache)
    return files


def _file_cells(spark: SparkSession, kind: str, profile: str, o: Options, seen: Seen | None) -> DataFrame:
    files = _opened(spark, kind, profile, o, read_files, seen)
    return _cells(file_cells(files, metadata=True), kind, profile, host=o.get("host", "This PC"))


def _object_cells(spark: SparkSession, kind: str, profile: str, o: Options, seen: Seen | None) -> DataFrame:
    return _cells(object_cells(_opened(spark, kind, profile, o, read_objects, seen)), kind, profile)


def _line_findings(spark: SparkSession, kind: str, profile: str, o: Options, catalog: Catalog, **scan_options) -> DataFrame:
    """Findings of a profile of files or objects that is read ``by_line``; archives and office files are read as ever."""
    if "cache" in o:
        raise ValueError("a profile that is read by line keeps no cache")
    path, excluded, glob = str(o["path"]), o.get("exclude_patterns") or (), o.get("glob")
    if kind == "fs":
        lines, places = file_lines(spark, path, excluded, glob), {"host": o.get("host", "This PC")}
        packed = file_cells(read_files(spark, path, excluded, glob), metadata=True, plain_text=False)
    else:
        lines, places = in_buckets(file_lines(spark, path, excluded, glob, objects=True)).drop("file_size", "modified_time"), {}
        packed = object_cells(read_objects(spark, path, excluded, glob), plain_text=False)
    found = scan_lines(_cells(lines, kind, profile, PLACE, **places), catalog, **scan_options)
    return conform(found).unionByName(conform(scan(_cells(packed, kind, profile, **places), "value", catalog, **scan_options)))


def _drive_cells(spark: SparkSession, kind: str, profile: str, o: Options) -> DataFrame:
    users = o.get("impersonate_users") if kind == "gdrive_workspace" else None
    listing = drive_listing(
        _load(spark, o, o["manifest"]), o.get("folder"), users, o.get("exclude_patterns") or ()
    )
    return _cells(drive_cells(listing, read_files(spark, str(o["path"]))), kind, profile)


def _text_cells(spark: SparkSession, kind: str, profile: str, o: Options) -> DataFrame:
    return _cells(literal_cells(spark, {profile: o["text"]}), kind, profile)


READERS: dict[str, Callable[[SparkSession, str, str, Options], DataFrame]] = {
    "mysql": _table_cells,
    "postgresql": _table_cells,
    "mongodb": _document_cells,
    "couchdb": _document_cells,
    "redis": _redis_cells,
    "s3": _object_cells,
    "gcs": _object_cells,
    "firebase": _object_cells,
    "fs": _file_cells,
    "gdrive": _drive_cells,
    "gdrive_workspace": _drive_cells,
    "text": _text_cells,
}
_CACHED = ("s3", "gcs", "firebase", "fs")
_STOPPING = ("s3", "gcs")
_UNIT = ("profile", "bucket", "file_path")


def _stopped_objects(spark: SparkSession, kind: str, profile: str, o: Options, seen: Seen | None, catalog: Catalog, limit: int, **scan_options):
    """Findings of a bucket up to the line; objects behind it are not opened."""

    def find(files: DataFrame) -> DataFrame:
        return scan(_cells(object_cells(files), kind, profile), "value", catalog, **scan_options)

    return scan_until(_opened(spark, kind, profile, o, read_objects, seen), listed_key(), find, limit, _UNIT)


def _chat_findings(spark: SparkSession, profile: str, o: Options, catalog: Catalog, limit: int | None, **scan_options):
    channels = select_channels(
        _load(spark, o, o["channels"]),
        o.get("channel_ids") or (),
        o.get("blacklisted_channel_ids") or (),
        o.get("channel_types", CHANNEL_TYPES),
        bool(o.get("archived_channels", False)),
        bool(o.get("onlyArchived", False)),
        o.get("isExternal"),
    )
    contents = file_cells(read_files(spark, str(o["files"]))) if "files" in o else None
    return scan_chat(
        channels,
        _load(spark, o, o["messages"]),
        _load(spark, o, o["replies"]),
        str(o["workspace_url"]),
        contents,
        catalog,
        profile,
        int(o.get("limit_mins", LOOKBACK_MINUTES)),
        o.get("read_from"),
        limit,
        **scan_options,
    )


def scan_connection(
    spark: SparkSession,
    connection: Mapping,
    source: str = "all",
    catalog: Catalog = None,
    seen: Seen | None = None,
    **scan_options: object,
) -> DataFrame:
    """Rated findings of one source kind, or of all in the description, over all their profiles.

    Profiles of files and objects may be read ``by_line``, so that a large text file is the work of many tasks; a match then ends at a line break.
    Those that name a ``cache`` are scanned for changes only. Pass a dict as ``seen`` and hand it to
    ``remember`` once the findings are stored; then the next run passes over what this one read.
    """
    sources: Mapping[str, Mapping[str, Options]] = connection.get("sources", {})
    kinds = list(sources) if source == "all" else [source]
    options = connection.get("options", {})
    limit = int(options.get("max_matches", DEFAULT_MAX_MATCHES)) if options.get("quick_exit") else None
    scan_options = {"redacted": bool(connection.get("notify", {}).get("redacted", False)), **scan_options}

    found, cells = [], []
    for kind in kinds:
        mine = []
        for profile, o in sources[kind].items():
            if kind == "slack":
                found.append(_chat_findings(spark, profile, o, catalog, limit, **scan_options))
            elif kind in _CACHED and o.get("by_line"):
                (mine if limit is not None and kind in _STOPPING else found).append(
                    _line_findings(spark, kind, profile, o, catalog, **scan_options)
                )
            elif limit is not None and kind in _STOPPING:
                mine.append(_stopped_objects(spark, kind, profile, o, seen, catalog, limit, **scan_options))
            else:
                more = (seen,) if kind in _CACHED else ()
                mine.append(READERS[kind](spark, kind, profile, o, *more))
        if mine and limit is not None and kind in _STOPPING:
            parts = [conform(part) for part in mine]
            stopped = len(parts) == 1 and not any(o.get("by_line") for o in sources[kind].values())
            found.append(parts[0] if stopped else quick_exit(reduce(DataFrame.unionByName, parts), limit, unit=_UNIT))
        else:
            cells += mine
    if cells:
        found.append(conform(scan(reduce(DataFrame.unionByName, cells), "value", catalog, **scan_options)))
    if not found:
        raise ValueError("no source to scan")
    return rate(reduce(DataFrame.unionByName, found), connection.get("severity_rules"))


def remember(seen: Seen) -> None:
    """Add to each cache what a scan has opened."""
    for new, cache in seen.values():
        append_manifest(new, cache)


def alerts_for(
    findings: DataFrame, connection: Mapping, history: DataFrame | None = None, no_write: bool = False
) -> DataFrame:
    """Alerts to send for findings under the description's ``notify`` part."""
    notify = connection.get("notify", {})
    every = al.alerts(findings, notify.get("slack", {}).get("mention", ""))
    return al.suppress(every, history, bool(notify.get("suppress_duplicates", False)), no_write)


def tickets_for(alerts: DataFrame, connection: Mapping, assignees: DataFrame | None = None) -> DataFrame | None:
    """Tickets for alerts; None if the description names no ticket user."""
    jira = connection.get("notify", {}).get("jira", {})
    if not jira.get("username"):
        return None
    return al.tickets(
        alerts,
        str(jira.get("project")),
        str(jira.get("issue_type")),
        jira.get("issue_fields", {}).get("description_template", ""),
        jira.get("labels") or (),
        jira.get("assignee"),
        assignees,
        connection.get("severity_rules"),
    )
