"""The same work on streams. All state lives in stream checkpoints and written tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from cellsift.catalog import Catalog
from cellsift.operators.ledger import Ledger
from cellsift.operators.scan import scan
from cellsift.sources.files import file_cells


def table_stream(
    spark: SparkSession, folder: str, schema: object, glob: str | None = None, per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def stream_scan(cells: DataFrame, text: str = "value", catalog: Catalog = None, **options: object) -> DataFrame:
    """Findings of an unbounded stream of cells; stateless, so append mode without a watermark."""
    return scan(cells, text, catalog, **options)


def dedupe_alerts(alerts: DataFrame, at: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Let one of equal alerts pass per horizon. State is one hash per alert inside the horizon.

    Which of several copies comes first is for Spark to see: a copy that is late is dropped and does not keep a later one back.
    """
    stamped = alerts.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["msg_hash"])


def window_counts(
    findings: DataFrame,
    at: str = "ts",
    minutes: int = 60,
    by: tuple[str, ...] = ("channel_id",),
    late: str = "10 minutes",
) -> DataFrame:
    """Findings and exposed values per channel and look-back window; rows later than ``late`` are dropped."""
    stamped = findings.withColumn(at, F.col(at).cast("timestamp"))
    if findings.isStreaming:
        stamped = stamped.withWatermark(at, late)
    counts = stamped.groupBy(F.window(at, f"{minutes} minutes"), *by).agg(
        F.count("*").alias("findings"), F.sum(F.col("total_exposed").cast("long")).alias("total_exposed")
    )
    return counts.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *by,
        "findings",
        "total_exposed",
    )


def alert_sink(path: str, stream: str = "alerts", compact_after: int = 20) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: send what no earlier batch of any stream of ``path`` has sent.

    Each stream has a ledger of its own in ``path``, whose runs are its batches: a batch that is run again after a failure replaces its own
    rows, and one that is settled stays as it is. What a batch lists and opens does not grow with the number of batches.
    A stream that begins anew with another checkpoint counts its batches anew, so it takes another name.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        books = _ledgers(batch.sparkSession, path, compact_after)
        mine = books.pop(stream, None) or Ledger(batch.sparkSession, f"{path}/stream={stream}", compact_after)
        mine.send(batch, batch_id, others=list(books.values()))

    return handle


def _ledgers(spark: SparkSession, path: str, compact_after: int = 20) -> dict[str, Ledger]:
    """Ledgers by the name of their stream."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return {}
    names = [status.getPath().getName() for status in system.listStatus(root)]
    streams = sorted(n.removeprefix("stream=") for n in names if n.startswith("stream="))
    return {n: Ledger(spark, f"{path}/stream={n}", compact_after) for n in streams}


def sent_alerts(spark: SparkSession, path: str) -> DataFrame | None:
    """``msg_hash, payload, stream, batch_id`` of all streams, or None before anything was sent."""
    books = _ledgers(spark, path)
    if not books:
        return None
    sent = [book.all_sent().select("msg_hash", "payload", F.lit(name).alias("stream"), F.col("run").alias("batch_id"))
            for name, book in books.items()]
    return reduce(DataFrame.unionByName, sent)


def start_alerts(
    alerts: DataFrame, path: str, checkpoint: str, stream: str = "alerts", **trigger: object
) -> StreamingQuery:
    writer = alerts.writeStream.foreachBatch(alert_sink(path, stream)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def new_files(spark: SparkSession, folder: str, glob: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Files that arrive in a folder, each once: the stream's checkpoint remembers what was read."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(folder)


def stream_files(spark: SparkSession, folder: str, catalog: Catalog = None, glob: str | None = None, **options: object):
    """Findings of files as they arrive."""
    return scan(file_cells(new_files(spark, folder, glob)), "value", catalog, **options)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything that is there now into a table and return the table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
