"""Drive manifests: which files a drive scan reads, and under which name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cellsift.sources.files import READ_KINDS, excluded_name, file_cells, file_kind, local_path

# Types of native documents, which a drive delivers as PDF, the folder type, and the name mark.
NATIVE_TYPES = (
    "application/vnd.google-apps.document",
    "application/vnd.google-apps.spreadsheet",
    "application/vnd.google-apps.presentation",
    "application/vnd.google-apps.drawing",
    "application/vnd.google-apps.script",
)
FOLDER_TYPE = "application/vnd.google-apps.folder"
RUNTIME_MARK = "-runtime.pdf"


def stored_name(name: Column, mime: Column) -> Column:
    return F.when(mime.isin(*NATIVE_TYPES), F.concat(name, F.lit(RUNTIME_MARK))).otherwise(name)


def shown_name(stored: Column) -> Column:
    return F.replace(stored, F.lit(RUNTIME_MARK), F.lit(""))


def drive_listing(
    manifest: DataFrame,
    folder: str | None = None,
    users: Sequence[str] | DataFrame | None = None,
    exclude_patterns: Iterable[str] = (),
) -> DataFrame:
    """Files to scan from ``manifest(file_id, file_name, owner, parent, mime)``, of the whole drive.

    ``folder`` limits to direct children. A column ``path`` says where a file's content lies (for a native document: where its
    exported text does); without it contents lie at ``<file_id>/<stored name>``. ``users`` (a list, or a table with a ``user`` column) limits to files they own
    and names them in ``user``. Folders are skipped; ``stored_name`` is what the exclusion patterns see.
    """
    files = manifest.where(F.col("mime") != FOLDER_TYPE)
    if folder is not None:
        files = files.where(F.col("parent") == folder)
    files = files.withColumn("stored_name", stored_name(F.col("file_name"), F.col("mime")))
    files = files.where(~excluded_name(F.col("stored_name"), exclude_patterns))
    if isinstance(users, DataFrame):
        files = files.join(users.select(F.col("user").alias("owner")).distinct(), "owner", "left_semi")
        files = files.withColumn("user", F.col("owner"))
    elif users:
        files = files.where(F.col("owner").isin(*users)).withColumn("user", F.col("owner"))
    else:
        files = files.withColumn("user", F.lit(None).cast("string"))
    path = F.col("path") if "path" in manifest.columns else F.lit(None)
    return files.select(
        "file_id",
        shown_name(F.col("stored_name")).alias("file_name"),
        "stored_name",
        "user",
        "owner",
        "mime",
        path.cast("string").alias("path"),
    )


def drive_cells(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Texts of listed files: ``(file_id, file_name, user, file_path, member_path, value)``.

    ``files`` are the drive's files as the binary reader delivers them. A file belongs to its listing by its path or its id, never
    by its name, which many may share. Only kinds that can be read are opened; see ``drive_unread`` for the others.
    """
    wanted = listing.select("file_id", "file_name", "user", local_path(F.col("path")).alias("_path"))
    texts = file_cells(files).withColumn("_id", F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1))
    by_path = wanted.where(F.col("_path").isNotNull()).join(texts, F.col("_path") == F.col("file_path"))
    by_id = wanted.where(F.col("_path").isNull()).join(texts, F.col("file_id") == F.col("_id"))
    columns = ["file_id", "file_name", "user", "file_path", "member_path", "value"]
    return by_path.select(*columns).unionByName(by_id.select(*columns))


def drive_unread(listing: DataFrame) -> DataFrame:
    """Listed files without a text reader: native documents whose export the manifest does not name, images, PDF and the like."""
    where = F.coalesce("path", "stored_name")
    kind = file_kind(where)
    return listing.select("file_id", "file_name", "user", kind.alias("file_kind")).where(~F.col("file_kind").isin(*READ_KINDS))
