"""Scan only what changed since the last run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def content_tag(content: str = "content"):
    """A tag that changes with the bytes."""
    return F.md5(F.col(content))


def listing_tag():
    """A tag from the listing alone, so that unchanged files are never opened."""
    return F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))


def changed_objects(
    objects: DataFrame, manifest: DataFrame, on: Sequence[str] = ("path", "tag"), rescan: bool = False
) -> DataFrame:
    """Objects whose tag the manifest does not hold. ``rescan=True`` keeps all of them and marks what is new."""
    on = list(on)
    if not rescan:
        return objects.join(manifest.select(*on), on, "left_anti")
    known = manifest.select(*on).distinct().withColumn("_known", F.lit(True))
    return (
        objects.join(known, on, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    )


def append_manifest(objects: DataFrame, path: str, on: Sequence[str] = ("path", "tag")) -> None:
    objects.select(*on).write.mode("append").parquet(path)
