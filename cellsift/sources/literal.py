"""Configured literal texts as cells."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def text_cells(texts: DataFrame, profile: str = "profile", text: str = "text") -> DataFrame:
    """A table of texts, one per profile, to ``(data_source, profile, value)``."""
    return texts.select(
        F.lit("text").alias("data_source"), F.col(profile).cast("string").alias("profile"), F.col(text).alias("value")
    ).where(F.col("value").isNotNull() & (F.col("value") != ""))


def literal_cells(spark: SparkSession, texts: Mapping[str, object]) -> DataFrame:
    """``{profile: text}`` from a configuration."""
    rows = [(p, str(t)) for p, t in texts.items() if t]
    return text_cells(spark.createDataFrame(rows, "profile string, text string"))
