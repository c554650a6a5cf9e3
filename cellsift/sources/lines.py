"""Text files by their lines: a file of any size is the work of many tasks.

Spark cuts text files into ranges that begin and end at line breaks (LF, CRLF or CR). Each line is a cell of its own, and what the lines of a file
give is merged into findings of the file: matches are a set, so tasks drop their own repeats before anything is shuffled, and a
large file's matches meet spread by their values first. The same rule holds for every size; no file is too large.

A match ends at a line break, which a scan of whole files lets some patterns cross. The sample of a finding is that of the first line
with a match. Files that end in ``.gz`` or another ending Spark unpacks are read unpacked, by one task each.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.catalog import Catalog
from cellsift.operators.scan import scan
from cellsift.sources.files import (
    TEXT_KIND,
    excluded_name,
    excluded_path,
    file_kind,
    listed_key,
    listed_path,
    local_path,
    plain_uri,
    shown_time,
)

#: Where a line stands in its file: the start of its range and a number that grows within.
PLACE = ("line_range", "line_number")
_FOUND = ("pattern_name", "matches", "total_exposed", "sample_text")


def file_lines(
    spark: SparkSession, path: str, exclude_patterns: Iterable[str] = (), glob: str | None = None, objects: bool = False
) -> DataFrame:
    """``file_path, member_path, file_size, modified_time, line_range, line_number, value`` of the lines of text files that are not empty.

    Exclusion works as in ``read_files``, or with ``objects`` as in ``read_objects``: excluded files, and those of other kinds, are not opened.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    where, patterns = listed_path(), list(exclude_patterns)
    lines = reader.text(path).where(file_kind(F.col("_metadata.file_path")) == TEXT_KIND)
    if patterns and objects:
        lines = lines.where(~excluded_name(listed_key(), patterns))
    elif patterns:
        base = plain_uri(F.lit(path.rstrip("/")))
        lines = lines.where((plain_uri(where) == base) | ~excluded_path(plain_uri(where), base, patterns))
    return lines.select(
        local_path(where).alias("file_path"),
        F.lit(None).cast("string").alias("member_path"),
        F.col("_metadata.file_size").alias("file_size"),
        shown_time(F.col("_metadata.file_modification_time")).alias("modified_time"),
        F.col("_metadata.file_block_start").alias(PLACE[0]),
        F.monotonically_increasing_id().alias(PLACE[1]),
        F.make_valid_utf8("value").alias("value"),
    ).where(F.col("value") != "")


def merge_lines(found: DataFrame) -> DataFrame:
    """Findings of lines as findings of what their other columns name: one row each and detector, with the distinct matches of all lines."""
    keys = [F.col(f"`{c}`") for c in found.columns if c not in (*_FOUND, *PLACE)]
    first = F.struct(*PLACE, "sample_text")
    one = found.select(*keys, "pattern_name", F.explode("matches").alias("match"), first.alias("first"))
    values = one.groupBy(*keys, "pattern_name", "match").agg(F.min("first").alias("first"))
    files = values.groupBy(*keys, "pattern_name").agg(
        F.sort_array(F.collect_list("match")).alias("matches"), F.min("first").alias("first")
    )
    return files.select(*keys, "pattern_name", "matches", F.size("matches").alias("total_exposed"), "first.sample_text")


def scan_lines(lines: DataFrame, catalog: Catalog = None, **options: object) -> DataFrame:
    """Findings of files from their lines, in the form of ``scan``; other columns of ``lines`` are carried along."""
    return merge_lines(scan(lines, "value", catalog, **options))
