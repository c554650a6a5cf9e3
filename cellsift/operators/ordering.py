"""Global order at scale: running numbers and row ranges without one task per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellsift.session import written

#: Columns of our own beside a user's; no user column begins like this.
_OWN = "__cellsift_"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its task in the lower 33 bits


def number_rows(
    df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), name: str = "row_no"
) -> DataFrame:
    """1, 2, 3, … per group in a total order.

    Rows are range-partitioned by group and order, so a group may span any number of tasks and a hot one is split like
    any other range. Each task knows the place of its rows; a small table of counts per task and group shifts them.
    A column of the input that has the new one's name is replaced. The input is stored first, because finding the ranges reads it twice; the stored row id splits runs of equal rows.
    """
    group = list(group)
    columns = [c for c in df.columns if c != name]
    df = written(df.withColumn(_OWN + "id", F.monotonically_increasing_id()), "rows")
    keys = [F.col(f"`{k}`") if isinstance(k, str) else k for k in (*group, *order, _OWN + "id")]
    placed = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_OWN + "place", F.monotonically_increasing_id())
    )
    placed = written(placed, "ordered", compact=False).withColumn(_OWN + "task", F.shiftright(_OWN + "place", _LOCAL_BITS))
    spans = placed.groupBy(*group, _OWN + "task").agg(F.min(_OWN + "place").alias(_OWN + "first"), F.count("*").alias(_OWN + "n"))
    before = W.partitionBy(*group).orderBy(_OWN + "task").rowsBetween(W.unboundedPreceding, -1)
    shifts = spans.select(
        *[F.col(f"`{g}`").alias(f"{_OWN}g{i}") for i, g in enumerate(group)],
        F.col(_OWN + "task").alias(_OWN + "shift_task"),
        (F.coalesce(F.sum(_OWN + "n").over(before), F.lit(0)) - F.col(_OWN + "first") + 1).alias(_OWN + "shift"),
    )
    same = F.col(_OWN + "task") == F.col(_OWN + "shift_task")
    for i, g in enumerate(group):
        same = same & F.col(f"`{g}`").eqNullSafe(F.col(f"{_OWN}g{i}"))
    return placed.join(shifts, same).select(
        *[F.col(f"`{c}`") for c in columns], (F.col(_OWN + "place") + F.col(_OWN + "shift")).alias(name)
    )


def row_range(df: DataFrame, key: str | Sequence[str], start: int = 0, count: int | None = None) -> DataFrame:
    """Skip ``start`` rows in key order and keep the next ``count``; ``count=None`` keeps the rest.

    Only the key is ordered and numbered. The table itself is filtered by the keys at the two ends, which its source can
    apply while it reads. The key must be unique and never null, or no two runs need agree on the rows: else this raises.
    """
    key = [key] if isinstance(key, str) else list(key)
    if count is None and start == 0:
        return df
    if count is not None and count <= 0:
        return df.limit(0)
    names = [f"_k{i}" for i in range(len(key))]
    keys = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)])
    numbered = number_rows(keys, names, name="_row_no")
    last = None if count is None else start + count
    # One row before the range, its first two and its last two: repeated keys show at the ends, where they matter.
    places = {start, start + 1, start + 2} | (set() if last is None else {last, last + 1})
    ends = {r["_row_no"]: [r[n] for n in names] for r in numbered.where(F.col("_row_no").isin(*places)).collect()}
    nulls = reduce(Column.__or__, [F.col(n).isNull() for n in names])
    if numbered.where(nulls).limit(1).count():
        raise ValueError(f"a row range needs a key without nulls: {key}")
    for a, b in ((start, start + 1), *([(last, last + 1)] if last is not None else ())):
        if a in ends and b in ends and ends[a] == ends[b]:
            raise ValueError(f"a row range needs a unique key: {key}")
    if start + 1 not in ends:
        return df.limit(0)
    out = df.where(_compared(df, key, ends[start + 1], "above"))
    if last is not None and last in ends:
        out = out.where(_compared(df, key, ends[last], "below"))
    return out


def _compared(df: DataFrame, key: Sequence[str], values: Sequence[object], side: str) -> Column:
    """Rows at or above (below) a key, column by column."""
    condition = F.lit(True)
    for k, v in reversed(list(zip(key, values, strict=True))):
        c, end = F.col(f"`{k}`"), F.lit(v).cast(df.schema[k].dataType)
        beyond = c > end if side == "above" else c < end
        condition = beyond | ((c == end) & condition)
    leading, end = F.col(f"`{key[0]}`"), F.lit(values[0]).cast(df.schema[key[0]].dataType)
    return (leading >= end if side == "above" else leading <= end) & condition
