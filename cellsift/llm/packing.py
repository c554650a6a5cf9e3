"""Documents packed into training sequences by harmonic classes.

A piece of a class has a length of capacity / j, for j = 1, 2, 4, ... up to the capacity, and a bin of that class holds exactly j of
them. A document may be cut: from its start as many whole capacities as it holds, then of the rest always the longest class length
that fits, so every piece lies on the upper edge of its class and a full bin has no padding at all. Which bin a piece
falls into depends on nothing but the number of earlier pieces of its class in the same task: each task fills its own bins, and
nothing is shuffled. The bins that are open when a task ends (one a class at most) hold m pieces of 2^i tokens; they
are cut into sequences of powers of two of them, which need no padding either.

A document's ids are those of a tokenizer file, without special tokens, followed by ``end``. A null text is an empty one
and has that id alone. Repeated rows are documents of their own. An empty table gives an empty table. A task holds at
most one capacity of ids for each class, and the ids of one slice of texts or of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cellsift.llm.common import ship
from cellsift.llm.word_bpe import WordEncoder

ship(__name__)

#: Sequences of a task are numbered below this.
_TASK_BITS = 40
#: Pieces in one batch of results.
_ROWS = 4096


def cuts(length: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: whole capacities, then falling powers of two."""
    whole, rest = divmod(length, capacity)
    return [capacity] * whole + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


class Bins:
    """The open bins of a task, one a class; full ones are handed out with their numbers."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def add(self, length: int, row: tuple) -> list[tuple]:
        """``row`` joins its class; gives ``(row, sequence, offset)`` of a bin that is now full, or nothing."""
        bin_ = self.open.setdefault(length, [])
        bin_.append(row)
        if len(bin_) * length < self.capacity:
            return []
        del self.open[length]
        return self._numbered(length, bin_)

    def rest(self) -> Iterator[tuple]:
        """What is left, in sequences of a power of two of pieces."""
        for length, rows in sorted(self.open.items(), reverse=True):
            at = 0
            for size in cuts(len(rows), self.capacity):
                yield from self._numbered(length, rows[at : at + size])
                at += size
        self.open = {}

    def _numbered(self, length: int, rows: list[tuple]) -> list[tuple]:
        number, self.next = self.next, self.next + 1
        return [(row, number, i * length) for i, row in enumerate(rows)]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """One row a piece: ``id_column, start, length, ids, doc_tokens, sequence_id, offset``; a map without a shuffle.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, ``start`` counts the document's ids before them,
    ``doc_tokens`` all its ids. ``tokenizer`` is the path of a file, read on the driver; its size does not grow with the data.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shared.value)
        bins = Bins(capacity, TaskContext.get().partitionId() << _TASK_BITS)
        last, full, kind = np.array([end], np.uint32), [], None
        for batch in batches:
            kind = batch.schema.field("id").type
            keys = batch.column("id").to_pylist()
            for key, ids in zip(keys, encoder.encode(batch.column("text")), strict=True):
                ids = np.concatenate([ids, last])
                data, start = ids.astype("<u4").tobytes(), 0
                for length in cuts(len(ids), capacity):
                    piece = (key, start, length, data[4 * start : 4 * (start + length)], len(ids))
                    full += bins.add(length, piece)
                    start += length
                if len(full) >= _ROWS:
                    yield _batch(full, kind)
                    full = []
        full += bins.rest()
        if full:
            yield _batch(full, kind)

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    key, start, length, ids, tokens = zip(*[r[0] for r in rows], strict=True)
    arrays = [pa.array(key, kind), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
              pa.array(tokens, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
