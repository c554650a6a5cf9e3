"""Session settings and the few places where a plan is cut or spread on purpose."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs are written for. All are ordinary Spark options; a cluster may set its own.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_STAGES: dict[str, list[str]] = {}


def session(app: str = "cellsift", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for written stages and stream state: the one the cluster names.

    Only a local session, where driver and executors share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellsift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Delete the stages this session has written. Results that were built on them and not yet read are lost."""
    paths = _STAGES.pop(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def written(df: DataFrame, label: str = "stage", compact: bool = True) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    Later branches see the very same rows, read only the columns they need, and survive lost executors. The work runs in the
    splits it comes in. ``compact`` then lets Spark merge what they leave, by size: a scan finds little in each split, which
    would leave as many tiny files.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    (df.hint("rebalance") if compact else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, enough: int = 200) -> DataFrame:
    """Give a table that arrives in few splits (one big row group, say) enough tasks for regex work.

    ``df`` must be a plain file scan. A scan with ``enough`` splits, or with one per core, is left alone, so
    large inputs are never shuffled here; ``keys`` should be unique so that no task gets a hot key.
    """
    want = min(df.sparkSession.sparkContext.defaultParallelism, enough)
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)
