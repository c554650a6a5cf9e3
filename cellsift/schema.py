"""The shape of a finding and of the places a finding can come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The locator columns each kind of source fills in.
LOCATORS: dict[str, tuple[str, ...]] = {
    "mysql": ("host", "database", "table", "column"),
    "postgresql": ("host", "database", "table", "column"),
    "mongodb": ("host", "database", "collection", "field"),
    "couchdb": ("host", "database", "doc_id", "field"),
    "redis": ("host", "key"),
    "s3": ("bucket", "file_path"),
    "gcs": ("bucket", "file_path"),
    "firebase": ("bucket", "file_path"),
    "fs": ("host", "file_path", "file_size", "modified_time"),
    "gdrive": ("file_id", "file_name", "file_path"),
    "gdrive_workspace": ("file_id", "file_name", "user", "file_path"),
    "slack": ("channel_id", "channel_name", "user", "message_link"),
    "text": (),
}

LOCATOR_COLUMNS: tuple[str, ...] = (
    "host",
    "database",
    "table",
    "column",
    "collection",
    "field",
    "doc_id",
    "key",
    "bucket",
    "file_path",
    "file_size",
    "modified_time",
    "member_path",
    "file_id",
    "file_name",
    "user",
    "channel_id",
    "channel_name",
    "message_link",
)

FINDING_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("data_source", "profile", *LOCATOR_COLUMNS, "pattern_name")]
    + [
        T.StructField("matches", T.ArrayType(T.StringType())),
        T.StructField("total_exposed", T.IntegerType()),
        T.StructField("sample_text", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("severity_description", T.StringType()),
    ]
)

#: Columns that say where a finding is; also the default order of every report.
ORDER_COLUMNS: tuple[str, ...] = ("data_source", "profile", *LOCATOR_COLUMNS, "pattern_name", "sample_text")


def locate(df: DataFrame, data_source: str, profile: str | None = None, **locators: object) -> DataFrame:
    """Add the constant locators of one source; values may be literals or columns."""
    from pyspark.sql import Column

    values = {"data_source": data_source, **({"profile": profile} if profile is not None else {}), **locators}
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def conform(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project any finding table onto ``FINDING_SCHEMA``; absent columns become nulls.

    Rows of different sources then union without a schema merge. ``extra`` names columns to keep behind.
    """
    have = set(df.columns)
    cols = [
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FINDING_SCHEMA.fields
    ]
    return df.select(*cols, *[F.col(f"`{c}`") for c in extra])
