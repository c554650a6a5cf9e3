"""Files and objects: listing, exclusion, kinds, decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellsift.functions.text import decode_utf8
from cellsift.operators.incremental import changed_objects, listing_tag
from cellsift.session import written
from cellsift.sources.archives import KINDS, extract

TEXT_KIND = "text"

#: So many changed files are named in one scan; more make several.
PATHS_AT_ONCE = 50_000

#: Kinds whose text this library can read; archives and office files go through ``extract``.
READ_KINDS = ("text", "office", "archive")


def file_kind(path: Column) -> Column:
    low, kind = F.lower(path), None
    for name, endings in KINDS.items():
        hit = F.lit(False)
        for e in endings:
            hit = hit | low.endswith(e)
        kind = (F if kind is None else kind).when(hit, F.lit(name))
    return kind.otherwise(F.lit(TEXT_KIND))


def excluded_name(name: Column, patterns: Iterable[str]) -> Column:
    """True if a name contains one of the patterns; a pattern that is an extension thereby drops that extension."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(name, F.lit(p))
    return hit


def excluded_path(path: Column, base: Column, patterns: Iterable[str]) -> Column:
    """Exclusion inside a directory tree: by file name, and by the full path of any folder below ``base``."""
    patterns = list(patterns)
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    name = F.substring_index(path, "/", -1)
    return excluded_name(name, patterns) | ((folder != base) & excluded_name(folder, patterns))


def local_path(uri: Column) -> Column:
    """A ``file:`` URI as a plain path; other URIs unchanged."""
    return F.regexp_replace(uri, r"^file:(//(?=/))?", "")


def _load(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    # A file that cannot be one row must not end the scan of the others; ``oversize_files`` lists what is passed over.
    return files.where(F.col("length") <= _longest(spark))


def _longest(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))


def oversize_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files above Spark's limit for a row, from the listing alone."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    large = reader.load(path).select("path", "length").where(F.col("length") > _longest(spark))
    return large.select(local_path(F.col("path")).alias("file_path"), "length")


def listed_path() -> Column:
    """Path of a file from its listing. The metadata column is URL-encoded, where a plus sign stands for itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_files(
    spark: SparkSession, path: str, exclude_patterns: Iterable[str] = (), glob: str | None = None
) -> DataFrame:
    """Files under a directory (or the one file) as ``(path, modificationTime, length, content)``.

    Exclusion is a filter on file metadata, which Spark applies to its listing: excluded files are never opened.
    A path that is one file is always read.
    """
    files, patterns = _load(spark, path, glob), list(exclude_patterns)
    if not patterns:
        return files
    where = plain_uri(listed_path())
    base = plain_uri(F.lit(path.rstrip("/")))
    return files.where((where == base) | ~excluded_path(where, base, patterns))


def read_objects(
    spark: SparkSession, path: str, exclude_patterns: Iterable[str] = (), glob: str | None = None
) -> DataFrame:
    """The same for buckets, where the whole key is checked against the patterns."""
    files, patterns = _load(spark, path, glob), list(exclude_patterns)
    return files.where(~excluded_name(object_key(listed_path()), patterns)) if patterns else files


def plain_uri(uri: Column) -> Column:
    """``file:`` URIs come with one or three slashes, or as a bare path; make them one form."""
    return F.regexp_replace(uri, r"^(?:file:)?/+", "file:/")


def listing(files: DataFrame) -> DataFrame:
    """Path, size, time and change tag of files; content is not read."""
    return files.select(
        local_path(F.col("path")).alias("file_path"), "path", "length", "modificationTime", listing_tag().alias("tag")
    )


def file_metadata(files: DataFrame) -> DataFrame:
    """Size and modification time as reports show them."""
    return files.select(
        local_path(F.col("path")).alias("file_path"),
        F.col("length").alias("file_size"),
        shown_time().alias("modified_time"),
    )


def shown_time(time: Column | str = "modificationTime") -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def with_file_metadata(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings of files with the size and modification time of their file."""
    return findings.join(file_metadata(files), "file_path", "left")


def skipped_files(files: DataFrame) -> DataFrame:
    """Files of kinds without a text reader, so that nothing is passed over in silence."""
    kind = file_kind(F.col("path"))
    return files.select(local_path(F.col("path")).alias("file_path"), "length", kind.alias("file_kind")).where(
        ~F.col("file_kind").isin(*READ_KINDS) | F.lower("file_path").endswith(".rar")
    )


def _name_to_sort_by(files: DataFrame) -> Column:
    """Path to tell a file's kind by: of a file scan the listed one, so that files of other kinds stay closed."""
    try:
        files.select("_metadata.file_path")
    except AnalysisException:
        return F.col("path")
    return F.col("_metadata.file_path")


def file_cells(files: DataFrame, metadata: bool = False, plain_text: bool = True) -> DataFrame:
    """``(file_path, member_path, value)`` of every readable file; each file is read once.

    Plain text stays in the JVM; only archives and office files pass through Python. ``metadata`` adds ``file_size`` and
    ``modified_time``, which plain files bring along; those of archives come from the listing. Without ``plain_text`` archives
    and office files alone are read.
    """
    kind = file_kind(_name_to_sort_by(files))
    shown = ["file_path", "member_path", "value", *(("file_size", "modified_time") if metadata else ())]
    plain = files.where(kind == TEXT_KIND).select(
        local_path(F.col("path")).alias("file_path"),
        F.lit(None).cast("string").alias("member_path"),
        decode_utf8(F.col("content")).alias("value"),
        *((F.col("length").alias("file_size"), shown_time().alias("modified_time")) if metadata else ()),
    )
    packed = extract(files.where(kind.isin("office", "archive"))).where(F.col("error").isNull())
    packed = packed.select(local_path(F.col("path")).alias("file_path"), "member_path", F.col("text").alias("value"))
    if metadata:
        packed = with_file_metadata(packed, files)
    cells = plain.select(*shown).unionByName(packed.select(*shown)) if plain_text else packed.select(*shown)
    return cells.where(F.col("value") != "")


def unread_parts(files: DataFrame) -> DataFrame:
    """Archives, their members and office files that could not be read, each with the reason: ``file_path, member_path, error``."""
    failed = extract(files.where(file_kind(_name_to_sort_by(files)).isin("office", "archive"))).where(F.col("error").isNotNull())
    return failed.select(local_path(F.col("path")).alias("file_path"), "member_path", "error")


def read_changed(
    spark: SparkSession,
    path: str,
    manifest: DataFrame,
    exclude_patterns: Iterable[str] = (),
    glob: str | None = None,
    read: Callable[..., DataFrame] = read_files,
) -> tuple[DataFrame, DataFrame]:
    """Files whose listing tag ``manifest(path, tag)`` does not hold, and the manifest rows to add once they are done.

    The comparison sees the listing only, and exactly the changed files are opened.
    """
    files = read(spark, path, exclude_patterns, glob)
    new = written(changed_objects(listing(files).select("path", "tag"), manifest), "changed")
    # The listing that Spark made already lies on the driver with all its paths; these are some of them.
    paths = [_literal_glob(r.path) for r in new.select("path").toLocalIterator()]
    if not paths:
        return files.limit(0), new
    chunks = [paths[i : i + PATHS_AT_ONCE] for i in range(0, len(paths), PATHS_AT_ONCE)]
    fresh = [spark.read.format("binaryFile").load(chunk).where(F.col("length") <= _longest(spark)) for chunk in chunks]
    return reduce(DataFrame.unionByName, fresh), new


def _literal_glob(path: str) -> str:
    """A path that means itself where Spark expects a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


_OBJECT_URI = r"^[A-Za-z0-9+.-]+://([^/]+)/(.*)$"


def object_bucket(uri: Column) -> Column:
    return F.regexp_extract(uri, _OBJECT_URI, 1)


def object_key(uri: Column) -> Column:
    """Key of ``scheme://bucket/key``; a path of another form is its own key."""
    return F.when(uri.rlike(_OBJECT_URI), F.regexp_extract(uri, _OBJECT_URI, 2)).otherwise(local_path(uri))


def listed_key() -> Column:
    """Key of an object from its listing: a filter on it keeps the others closed."""
    return object_key(local_path(listed_path()))


def object_cells(files: DataFrame, exclude_patterns: Iterable[str] = (), plain_text: bool = True) -> DataFrame:
    """Objects to ``(bucket, file_path, member_path, value)``; ``read_objects`` excludes before reading."""
    kept = files.where(~excluded_name(object_key(F.col("path")), list(exclude_patterns)))
    return in_buckets(file_cells(kept, plain_text=plain_text))


def in_buckets(cells: DataFrame) -> DataFrame:
    """Cells of files as cells of objects: ``file_path`` becomes the key, ``bucket`` is added."""
    uri, others = F.col("file_path"), [c for c in cells.columns if c not in ("bucket", "file_path")]
    return cells.select(object_bucket(uri).alias("bucket"), object_key(uri).alias("file_path"), *others)
