"""Document collections and key-value stores as cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cellsift.functions.text import decode_utf8
from cellsift.schema import locate
from cellsift.sources.tables import cell_text, pick_tables

# JSON spellings of values that count as empty.
EMPTY_JSON = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")


def json_cells(df: DataFrame, body: str, doc_id: str) -> DataFrame:
    """JSON texts to ``(doc_id, field, value)`` for the top-level fields that hold something.

    Nested values are one cell of JSON text. Texts that are not JSON objects have no fields.
    """
    fields = df.select(
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"),
        F.explode(F.from_json(F.col(f"`{body}`"), "map<string,variant>")).alias("field", "_value"),
    )
    return fields.where(~F.to_json("_value").isin(*EMPTY_JSON)).select(
        "doc_id", "field", F.col("_value").cast("string").alias("value")
    )


def record_cells(df: DataFrame, doc_id: str) -> DataFrame:
    """The same for documents already read into columns (``spark.read.json``, a connector's table).

    Every field is a cell, the id too: keys are often addresses or numbers of people.
    """
    fields = df.schema.fields
    taken = df.select(
        F.col(f"`{doc_id}`").cast("string").alias("_doc_id"),
        *[cell_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields],
    )
    melted = taken.unpivot(["_doc_id"], [f"`{f.name}`" for f in fields], "field", "value")
    return melted.where(F.col("value").isNotNull() & (F.col("value") != "")).withColumnRenamed("_doc_id", "doc_id")


def scan_collections(
    collections: Iterable[str],
    reader: Callable[[str], DataFrame],
    whitelist: Iterable[str] | None = None,
    data_source: str = "mongodb",
    profile: str | None = None,
    **locators: object,
) -> DataFrame:
    """Cells of all selected collections; ``reader`` gives ``(doc_id, field, value)`` for a collection name."""
    parts = [reader(name).withColumn("collection", F.lit(name)) for name in pick_tables(collections, whitelist)]
    if not parts:
        raise ValueError("no collection selected")
    return locate(reduce(DataFrame.unionByName, parts), data_source, profile, **locators)


def key_value_cells(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Key-value pairs, text or bytes, to ``(key, value)``; empty values are skipped."""
    pairs = df.select(
        *[
            (decode_utf8(F.col(f"`{c}`")) if df.schema[c].dataType.typeName() == "binary" else F.col(f"`{c}`"))
            .cast("string")
            .alias(name)
            for c, name in ((key, "key"), (value, "value"))
        ]
    )
    return pairs.where(F.col("value").isNotNull() & (F.col("value") != ""))
