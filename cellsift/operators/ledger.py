"""Runs that send alerts and remember them: each alert once, whatever fails between.

A run has a number. It writes what it sends to its own folder of the outbox, in one commit; that folder is also what it remembers, so there
is no moment at which an alert is sent but not remembered. A run that is repeated ignores itself and later runs and
replaces its own folder: it sends the same alerts. Outbox folders without Spark's mark of success count as never written.

Looking up what was sent must not grow with the number of runs. After ``compact_after`` runs their hashes are written, with those of
earlier ones, as one base, in folders by the first two digits of the hash, and a lookup opens the folders that its own
hashes name and the outboxes since. A base is used once it is complete; the one before it stays until the next is. Runs after a
base have their outboxes in a folder of that base, so that a run lists no others.

Several writers, each with its own ledger, may look up each other's runs (``others``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.operators.alerts import first_of_each, outbox, unseen

OUTBOX = "msg_hash string, payload string"
#: A base's folder of one pair of digits is written by so many tasks.
TASKS_PER_BUCKET = 4


def _box(base: int | None) -> str:
    """Folder for the outboxes of runs that follow a base."""
    return "outbox" if base is None else f"outbox-{base}"


class Ledger:
    """What runs have sent, in one folder that all of them share. Runs of one ledger come one after the other."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 20):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    def send(self, alerts: DataFrame, run: int, order: Sequence[str] | None = None, others: Sequence[Ledger] = ()) -> DataFrame:
        """Payloads of this run by hash: the first alert of each hash that no earlier run, and no run of ``others``, has sent.

        Run numbers grow; gaps are allowed. A run that a base already holds is settled, and its outbox is given as it is.
        """
        base = self._last_base()
        if base is not None and run <= base:
            if any(run in self._runs(box, "run") for box in self._boxes()):
                return self.sent(run)
            raise ValueError(f"run {run} comes after run {base} was settled")
        stage = self._folder("stage", "run", run)
        first_of_each(alerts, order).write.mode("overwrite").parquet(stage)
        fresh = self.spark.read.schema(alerts.schema).parquet(stage)
        known = [self._known(fresh, base, run), *(other._known(fresh, other._last_base()) for other in others)]
        left = reduce(unseen, [k for k in known if k is not None], fresh)
        outbox(left).write.mode("overwrite").parquet(self._folder(_box(base), "run", run))
        self._delete(stage)
        if len(self._since(base, run + 1)) >= self.compact_after:
            self.compact(run)
        return self.spark.read.schema(OUTBOX).parquet(self._folder(_box(base), "run", run))

    def sent(self, run: int) -> DataFrame:
        """The outbox of a run."""
        for box in self._boxes():
            if run in self._runs(box, "run"):
                return self.spark.read.schema(OUTBOX).parquet(self._folder(box, "run", run))
        raise KeyError(run)

    def all_sent(self) -> DataFrame:
        """``run, msg_hash, payload`` of all runs."""
        complete = [(box, runs) for box in self._boxes() if (runs := self._runs(box, "run"))]
        empty = self.spark.createDataFrame([], OUTBOX + ", run long")
        return reduce(DataFrame.unionByName, [self._sent_in(*found) for found in complete], empty).select("run", "msg_hash", "payload")

    def compact(self, run: int) -> None:
        """Write the hashes of all runs up to this one as a base, and let go of the base before the last."""
        bases = sorted(n for n in self._runs("base", "upto") if n < run)
        last = bases[-1] if bases else None
        since = [self._sent_in(_box(last), self._since(last, run + 1)).select("msg_hash")]
        if bases:
            since.append(self._base(last).select("msg_hash"))
        hashes = reduce(DataFrame.union, since).distinct().withColumn("bucket", F.left("msg_hash", F.lit(2)))
        salt = F.pmod(F.xxhash64("msg_hash"), F.lit(TASKS_PER_BUCKET))
        spread = hashes.repartition("bucket", salt)
        spread.write.mode("overwrite").partitionBy("bucket").parquet(self._folder("base", "upto", run))
        for old in bases[:-1]:
            self._delete(self._folder("base", "upto", old))

    def _known(self, fresh: DataFrame, base: int | None, run: int | None = None) -> DataFrame | None:
        """Hashes of earlier runs (of all, without ``run``) that can be among those of ``fresh``."""
        parts = []
        if base is not None:
            buckets = [r.b for r in fresh.select(F.left("msg_hash", F.lit(2)).alias("b")).distinct().collect()]  # 256 at most
            parts.append(self._base(base).where(F.col("bucket").isin(buckets)).select("msg_hash"))
        since = self._since(base, run)
        if since:
            parts.append(self._sent_in(_box(base), since).select("msg_hash"))
        return reduce(DataFrame.union, parts) if parts else None

    def _base(self, upto: int) -> DataFrame:
        return self.spark.read.schema("msg_hash string, bucket string").parquet(self._folder("base", "upto", upto))

    def _last_base(self) -> int | None:
        return max(self._runs("base", "upto"), default=None)

    def _since(self, base: int | None, run: int | None = None) -> list[int]:
        """Complete runs after a base and before ``run``."""
        return sorted(n for n in self._runs(_box(base), "run") if run is None or n < run)

    def _sent_in(self, box: str, runs: Sequence[int]) -> DataFrame:
        return self.spark.read.schema(OUTBOX + ", run long").parquet(f"{self.path}/{box}").where(F.col("run").isin(list(runs)))

    def _boxes(self) -> list[str]:
        """Folders of outboxes, one for each base there has been and one for the time before the first."""
        path = self._hadoop(self.path)
        system = self._system(path)
        if not system.exists(path):
            return []
        names = [status.getPath().getName() for status in system.listStatus(path)]
        return sorted(n for n in names if re.fullmatch(r"outbox(--?\d+)?", n))

    def _folder(self, kind: str, key: str, number: int) -> str:
        return f"{self.path}/{kind}/{key}={number}"

    def _runs(self, kind: str, key: str) -> list[int]:
        """Numbers of the complete folders of a kind."""
        path = self._hadoop(f"{self.path}/{kind}")
        system = self._system(path)
        if not system.exists(path):
            return []
        found = [re.fullmatch(rf"{key}=(-?\d+)", status.getPath().getName()) for status in system.listStatus(path)]
        numbers = [int(m[1]) for m in found if m]
        return [n for n in numbers if system.exists(self._hadoop(f"{self._folder(kind, key, n)}/_SUCCESS"))]

    def _delete(self, folder: str) -> None:
        path = self._hadoop(folder)
        self._system(path).delete(path, True)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())
