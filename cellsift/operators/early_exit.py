"""A scan of files that stops reading once enough is found.

Files are taken in the order of their keys, in slices that double. Findings of a slice are written and counted; the loop ends with the
slice in which the line is crossed, so files behind it are never opened. Slices are cut by a key range that Spark applies to its
listing. A scan that finds nothing costs one job for each doubling of what it has read, and reads every file once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cellsift.operators.ordering import number_rows
from cellsift.operators.scan import quick_exit
from cellsift.session import written

#: Files in the first slice, for each core of the cluster.
FIRST_FILES = 4


def scan_until(
    files: DataFrame,
    key: Column,
    find: Callable[[DataFrame], DataFrame],
    max_matches: int,
    unit: tuple[str, ...],
    first: int | None = None,
) -> DataFrame:
    """The rows of ``quick_exit(find(files), max_matches, unit=unit)``, read from as few files as their order allows.

    ``files`` must be a file scan and ``key`` made from its listing (``_metadata``), so that a filter on it passes over files unopened.
    ``find`` makes findings of any part of the files. Units come in the order of the keys, each from one file.
    """
    if max_matches < 1:
        return find(files.limit(0))
    size = first or FIRST_FILES * files.sparkSession.sparkContext.defaultParallelism
    keys = written(number_rows(files.select(key.alias("key")), ["key"], name="no"), "listing")
    total = keys.count()
    found, seen, at, low = [], 0, 0, None
    while at < total and seen < max_matches:
        end = min(at + size, total)
        # The last key of the slice; one row comes to the driver.
        high = keys.where(F.col("no") == end).first().key
        part = files.where(key <= F.lit(high))
        if low is not None:
            part = part.where(key > F.lit(low))
        found.append(written(find(part), "slice"))
        seen += found[-1].limit(max_matches).count()
        at, low, size = end, high, 2 * size
    if not found:
        return find(files.limit(0))
    return quick_exit(reduce(DataFrame.unionByName, found), max_matches, unit=unit, stored=True)
