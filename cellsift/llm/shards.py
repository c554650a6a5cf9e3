"""Documents into shards of nearly equal bytes, equal texts together: the minimax partition of an ordered row of
groups.

Groups of equal texts stand in the order of their SHA-256, their rows by id. The smallest capacity is searched for
which a greedy filling, shard after shard in that order, needs no more shards than there are; then the row is cut
there. A third of all rows may be copies of one text: the running sums are taken over ranges of rows, not of groups.

The size of a document is the UTF-8 length of its text plus one; a null text counts as an empty one and shares its
group. Repeated rows are rows of their own. Null ids come first in their group. With fewer groups than shards, shards
stay empty. An empty table gives an empty table. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cellsift.llm.common import staged

#: Capacities that are tried side by side; one job advances all of them by one shard.
TRIED_AT_ONCE = 32
_PLACE_BITS = 33  # monotonically_increasing_id keeps a row's place in its task in the lower 33 bits


def ordered_sums(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Adds ``position`` from 0 and ``reach``, the sum of ``size`` up to and with the row, in a total order.

    Rows are dealt into ranges of the order. Each range knows its own sums; those of whole ranges, one row a task, shift them.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(placed.withColumn("_place", F.monotonically_increasing_id()), "shard-ranges")
    placed = placed.withColumn("_range", F.shiftright("_place", _PLACE_BITS))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = placed.groupBy("_range").agg(F.sum(size).alias("_size"), F.count("*").alias("_rows")).select(
        "_range",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_size_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
    )
    inside = W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.withColumn("_sum", F.sum(size).over(inside)).withColumn("_row", F.row_number().over(inside))
    return summed.join(F.broadcast(shifts), "_range").select(  # as many rows as the shuffle has tasks
        *rows.columns,
        (F.col("_rows_before") + F.col("_row") - 1).alias("position"),
        (F.col("_size_before") + F.col("_sum")).alias("reach"),
    )


def smallest_capacity(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that ``shards`` shards need, and the ends at which they are cut.

    ``ends`` holds ``end``, the sum of all sizes up to and with a group, and ``size``, the group's own.
    """
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, [0] * shards
    low = max(largest, -(-total // shards))  # no smaller one can do
    high = -(-total // shards) + largest  # this one always does
    while low < high:
        step = max(1, -(-(high - low) // (TRIED_AT_ONCE + 1)))
        tried = list(range(low, high, step))[:TRIED_AT_ONCE]
        cuts = greedy_cuts(ends, tried, shards, total)
        good = [c for c, cut in zip(tried, cuts, strict=True) if cut[-1] == total]
        bad = [c for c in tried if c not in good]
        low, high = max([low - 1, *bad]) + 1, min([high, *good])
    return high, greedy_cuts(ends, [high], shards, total)[0]


def greedy_cuts(ends: DataFrame, capacities: list[int], shards: int, total: int) -> list[list[int]]:
    """For each capacity the last group end within reach, shard after shard."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(shards):
        starts = [cut[-1] if cut else 0 for cut in cuts]
        reached = [
            F.max(F.when(F.col("end") <= start + c, F.col("end"))) for start, c in zip(starts, capacities, strict=True)
        ]
        # Parquet passes over row groups outside the window.
        seen = ends.where((F.col("end") > min(starts)) & (F.col("end") <= max(map(sum, zip(starts, capacities, strict=True)))))
        found = seen.agg(*reached).first() if min(starts) < total else starts
        for cut, start, end in zip(cuts, starts, found, strict=True):
            cut.append(max(start, end or 0))
    return cuts


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, size, text_crc32, shard, slot`` for every row; slots of a shard are numbered from 0 without gaps."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("mark"),
    )
    summed = staged(ordered_sums(staged(rows, "shard-sizes"), ["mark", "id"], "size"), "shard-sums")
    groups = summed.groupBy("mark").agg(F.max("reach").alias("end"), F.sum("size").alias("size"))
    ends = staged(groups.select("end", "size").repartitionByRange("end").sortWithinPartitions("end"), "shard-groups")
    _, cuts = smallest_capacity(ends, shards)
    within = [F.col("reach") <= cut for cut in cuts[:-1]]
    firsts = summed.agg(F.lit(0), *[F.count_if(w) for w in within]).first()
    number = sum(((~w).cast("int") for w in within), F.lit(0))
    first = F.element_at(F.array(*[F.lit(n).cast("long") for n in firsts]), F.col("shard") + 1)
    placed = summed.withColumn("shard", number).withColumn("slot", F.col("position") - first)
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", "shard", "slot")
