"""All registered queries with their SQL twins."""

from __future__ import annotations

import functools
import importlib

from pyspark.sql import DataFrame, SparkSession

from cellsift.plans.audit import Query

_MODULES = ("detection", "catalog_jobs", "table_jobs", "file_jobs", "connection_jobs", "chat_jobs", "rating_jobs", "stream_jobs")


def _in_utc(query: Query) -> Query:
    """The given tables hold UTC times without a zone, so the session must not shift them."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    return run


def registered() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in _MODULES:
        queries = importlib.import_module(f"cellsift.plans.{module}").QUERIES
        out.update({name: (_in_utc(query), sql) for name, (query, sql) in queries.items()})
    return out
