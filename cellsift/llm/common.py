"""What the operators of this package share: tables, written stages, shipped modules, Arrow helpers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from cellsift.session import scratch


def ship(module: str) -> None:
    """Executors get the module's functions with the task, whether or not the package is installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def worker_cache() -> dict:
    """A dict that outlives the tasks of a Python worker, for small constant tables only."""
    return sys.__dict__.setdefault("_cellsift_worker_cache", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the tasks it has, and go on from the files.

    Cuts the lineage: a lost executor costs a re-read of files that every executor sees.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in one array, and the offsets of its rows; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many slices, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0x2545F4914F6CDD1D)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class SliceHasher:
    """Hashes of slices of a byte array: the bytes are digits, a slice is taken from running sums and moved to its own place."""

    def __init__(self):
        self.up, self.down = _powers(1 << 16, _BASE), _powers(1 << 16, _INVERSE)

    def over(self, raw: np.ndarray) -> None:
        if len(self.up) <= len(raw):
            size = 1 << len(raw).bit_length()
            self.up, self.down = _powers(size, _BASE), _powers(size, _INVERSE)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(own + _LENGTH * (ends - starts).astype(np.uint64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places; a run also ends where a row does."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(inside))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a text column in slices of about a megabyte: the first row's place, the bytes and their offsets."""
    raw, offsets = text_bytes(batch.column(column))
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
