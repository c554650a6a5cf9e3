"""Context-triggered piecewise hashing: fingerprints of texts that stay alike when a part of the text changes.

A hash rolls over windows of eight UTF-8 bytes. Where its lowest k bits are zero a piece ends, so a changed passage
moves only the boundaries inside it. The block size is 2^k, with the smallest k that leaves at most 64 boundaries.
Every piece gives two base64 characters, a hash of all windows that end in it. The fingerprint is
``block:pieces:pieces at twice the block``.

Likeness is one minus the share of pieces that an edit by insertions and deletions changes, at equal block sizes or at
neighbouring ones; farther ones give 0. Equal texts have equal fingerprints and likeness 1. Nulls count as empty
texts; an empty text is like no other. The longest text is worked through in blocks; its fingerprint has no other
length limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsift.llm.common import mixed, ship

ship(__name__)

PIECES = 64
_LEAST_LEVEL = 2
_WINDOW = 8
_BLOCK = 1 << 20
_BASE = 0x5851F42D4C957F2D
_POWERS = [np.uint64(pow(_BASE, 1 << i, 1 << 64)) for i in range(3)]
# The base64 alphabet.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Most ranges that neighbouring documents are dealt over; more tasks than that take more rows each.
RANGES = 2000

REPORT_SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint(text: str | None) -> str:
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    places, levels, sums, total = [], [], [], np.uint64(0)
    for a in range(0, len(raw), _BLOCK):
        begin = max(0, a - _WINDOW + 1)
        h = raw[begin : a + _BLOCK].astype(np.uint64) + np.uint64(1)
        for i, power in enumerate(_POWERS):
            step = 1 << i
            h[step:] += power * h[:-step].copy() if len(h) > step else np.uint64(0)
        h = mixed(h[a - begin :])
        running = np.cumsum(h) + total
        total = running[-1]
        at = np.flatnonzero((h & np.uint64((1 << _LEAST_LEVEL) - 1)) == 0)
        low = h[at]
        places.append(at + a)
        levels.append(np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)))
        sums.append(running[at])
    if not places:
        return f"{1 << _LEAST_LEVEL}::"
    places, levels, sums = np.concatenate(places), np.concatenate(levels), np.concatenate(sums)
    level = _LEAST_LEVEL
    while np.count_nonzero(levels >= level) > PIECES:
        level += 1
    parts = [_signature(places, levels, sums, total, len(raw), k) for k in (level, level + 1)]
    return f"{1 << level}:{parts[0]}:{parts[1]}"


def _signature(places, levels, sums, total, n: int, level: int) -> str:
    cut = levels >= level
    ends = sums[cut]
    if not cut.any() or places[cut][-1] < n - 1:
        ends = np.append(ends, total)
    values = mixed(np.diff(ends, prepend=np.uint64(0))) >> np.uint64(52)
    return "".join(_LETTERS[v >> 6] + _LETTERS[v & 63] for v in values.tolist())


def likeness(a: str | None, b: str | None) -> float | None:
    """Likeness of two fingerprints, 0 to 1; null if either is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    (block_a, one_a, two_a), (block_b, one_b, two_b) = a.split(":"), b.split(":")
    if block_a == block_b:
        return max(_alike(one_a, one_b), _alike(two_a, two_b))
    if int(block_b) == 2 * int(block_a):
        return _alike(two_a, one_b)
    if int(block_a) == 2 * int(block_b):
        return _alike(one_a, two_b)
    return 0.0


def _alike(a: str, b: str) -> float:
    """1 - edit distance / length of both, by the longest common subsequence, many places of a row at once."""
    n, m = len(a) // 2, len(b) // 2
    if not n or not m:
        return 0.0
    masks: dict[str, int] = {}
    for i in range(n):
        piece = a[2 * i : 2 * i + 2]
        masks[piece] = masks.get(piece, 0) | (1 << i)
    row = full = (1 << n) - 1
    for j in range(m):
        if mask := masks.get(b[2 * j : 2 * j + 2]):
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return 2 * (n - row.bit_count()) / (n + m)


def fingerprints(docs: DataFrame, text_column: str = "text", out_column: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every text."""

    @F.pandas_udf("string")
    def of(texts):
        return texts.map(fingerprint)

    of = of.asNondeterministic()  # computed once, wherever the column is used
    return docs.withColumn(out_column, of(F.col(f"`{text_column}`").cast("string")))


def edit_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning, and how alike they are.

    The next document is that of the next smaller id, and the first one after the last; nulls come last, rows with
    one id follow each other by text. The last half of the code points (rounded down) gives way to as many from the next
    document's beginning, or to all of it. A single document is its own next.

    One shuffle of the texts: ids are cut into ranges at quantiles, each range is sorted in a task, and the first document of a
    range also goes to the range before it, which ends with it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    ranges = max(1, min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fractions = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("id", fractions or [0.5], F.lit(20 * ranges))).first()[0] or []
    bounds = sorted(set(bounds)) if fractions else []
    kind = rows.schema["id"].dataType
    limits = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else None
    place = F.lit(0) if limits is None else F.size(F.filter(limits, lambda b: b > F.col("id")))
    place = F.when(F.col("id").isNull(), len(bounds)).otherwise(place).cast("int")

    # A row for each range, of which there are at most RANGES.
    firsts = rows.select("id").groupBy(place.alias("range")).agg(F.max("id").alias("first_id")).orderBy("range").collect()
    ends = [(a.range, b.first_id) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    guests = spark.createDataFrame(ends, f"host int, first_id {kind.simpleString()}")
    dealt = (
        rows.withColumn("range", place)
        .join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("first_id")), "left")
        .select("id", "text", F.explode(F.array(_seat("range", False), _seat("host", True))).alias("seat"))
        .where(F.col("seat.range").isNotNull())
        .select("seat.range", "seat.guest", "id", "text")
    )
    order = [F.col("range"), F.col("guest"), F.col("id").desc_nulls_last(), F.col("text")]
    sorted_rows = dealt.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order)
    reported = sorted_rows.mapInArrow(_report, f"id {kind.simpleString()}, {REPORT_SCHEMA}")
    return reported.withColumnRenamed("id", id_column)


def _seat(column: str, guest: bool):
    return F.struct(F.col(column).alias("range"), F.lit(guest).alias("guest"))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        ids, out = [], []
        for range_, guest, id_, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            text = text or ""
            if guest and last is not None and last[0] == range_ and last[1]:
                continue  # only the first guest ends a range
            mark = fingerprint(text)
            if last is not None and last[0] == range_:
                ids.append(last[2])
                out.append(_row(last[3], last[4], text, mark))
            last = (range_, guest, id_, text, mark)
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["id", *[c.split()[0] for c in REPORT_SCHEMA.split(", ")]]
        arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(2).type), *arrays], names)


def _row(text: str, mark: str, following: str, following_mark: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_mark = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return len(text), digest, mark, edited_mark, likeness(mark, edited_mark), likeness(mark, following_mark)
