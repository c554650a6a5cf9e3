"""A scan whose catalogue is a table: detectors meet texts by a join, and no detector comes to the driver.

Each detector's pattern is spelled for Java, and the longest literal no match can do without is found, by tasks over the catalogue;
where a set of a few characters goes on with it, in each of its spellings. Literals are posted under their grams: up to 16
characters the whole literal, then the next shorter step. Each keeps the one gram that the fewest texts hold. A text meets only
the detectors whose gram it holds, and only then the pattern runs, taken from its column: around the gram, if a match is bounded and
depends on nothing around it, else over the whole text. Detectors without a literal of three characters are posted under the empty gram, which every text holds: whoever writes them asks for every text.

Nearly all grams of a text are nobody's. Those of the catalogue are marked in a bitmap of bounded size, which goes to every
task; a text gives out the grams that the bitmap lets pass. It may let others pass, and the join drops these.

The plan is the same for ten detectors and for millions. Texts are written once under a number; grams, pairs and detectors travel by number, and
a text is shuffled once, to its pairs. Whether the index is small enough to be broadcast is for adaptive execution to
find out; else a gram that many texts hold is a skewed key, which it splits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

import cellsift.catalog
from cellsift.catalog import group_count, java_pattern, literal_choices
from cellsift.functions.matching import ASCII_FLAGS, ODD_LETTERS, UNICODE_FLAGS
from cellsift.functions.text import sample_text, tidy_matches
from cellsift.session import written

# Executors need not have the package.
for _module in (__name__, cellsift.catalog.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

#: Lengths of grams. A literal is posted under grams of the longest that it has.
STEPS = (*range(3, 17), 20, 24, 32, 40, 48, 64)
SHORT = STEPS[0]
_EVERY = ""
_ADDED = ("pattern_name", "matches", "total_exposed", "sample_text")
#: Bits of the bitmap for each gram, the least and the most there are (as powers of two), and those that one task puts together in a piece.
BITS_A_GRAM, _LEAST, _MOST, _PIECE = 64, 10, 28, 19
#: A pattern runs around so many places of its gram at most; where there are more, over the whole text.
_NEAR = 32
#: Characters that are hashed at a time.
_SLAB = 1 << 16
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def spelled(catalog: DataFrame, name: str = "pattern_name", pattern: str = "pattern") -> DataFrame:
    """``pattern_name, pattern, groups, literals, width`` of a table of named Python patterns, for Java: see ``literal_choices``.

    Rows without a name or a pattern are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = batch.column(1).to_pylist()
            java = [java_pattern(p) for p in patterns]
            literals, widths = zip(*map(literal_choices, patterns), strict=True) if patterns else ((), ())
            columns = [batch.column(0), pa.array(java, pa.string()), pa.array(map(group_count, java), pa.int32())]
            columns += [pa.array(literals, pa.list_(pa.string())), pa.array(widths, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["pattern_name", "pattern", "groups", "literals", "width"])

    rows = catalog.select(F.col(f"`{name}`").cast("string").alias("n"), F.col(f"`{pattern}`").cast("string").alias("p"))
    rows = rows.where("n is not null and p is not null")
    return rows.mapInArrow(run, "pattern_name string, pattern string, groups int, literals array<string>, width int")


def posted(detectors: DataFrame) -> DataFrame:
    """``det, literal, gram`` of all grams of each literal that is long enough."""
    size = F.array_max(F.filter(F.array(*map(F.lit, STEPS)), lambda n: n <= F.length("literal")))
    grams = F.transform(F.sequence(F.lit(1), F.length("literal") - F.col("size") + 1), lambda i: F.substr("literal", i, F.col("size")))
    long = detectors.where(F.length("literal") >= SHORT).select("det", "literal", size.alias("size"))
    return long.select("det", "literal", F.explode(F.array_distinct(grams)).alias("gram"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base, modulo 2**64, and their inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return out[0], out[1]


def _slots(hashes: np.ndarray, size: int, log2: int, which: int) -> np.ndarray:
    """The first or second bit of grams of one size."""
    return (((hashes + np.uint64(size)) * np.uint64(_MIX[which])) >> np.uint64(64 - log2)).view(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _bitmap(grams: DataFrame) -> tuple[int, bytes, list[int]]:
    """Size (as a power of two) and bits of the bitmap for a column ``gram``, and the lengths that grams have."""
    counts = grams.groupBy(F.length("gram").alias("size")).count().collect()  # a row a step at most
    log2 = min(max((BITS_A_GRAM * sum(r["count"] for r in counts)).bit_length(), _LEAST), _MOST)
    piece = min(log2, _PIECE)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = _powers(STEPS[-1])[0]
        for batch in batches:
            by_size: dict[int, list[str]] = {}
            for gram in batch.column(0).to_pylist():
                by_size.setdefault(len(gram), []).append(gram)
            for size, same in by_size.items():
                hashes = (_codes("".join(same)).reshape(-1, size) * power[:size]).sum(axis=1, dtype=np.uint64)
                slots = np.unique(np.concatenate([_slots(hashes, size, log2, i) for i in (0, 1)]))
                yield pa.RecordBatch.from_arrays([pa.array(slots >> piece), pa.array(slots & ((1 << piece) - 1))], ["piece", "bit"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            of, bit = (batch.column(i).to_numpy() for i in (0, 1))
            for k in np.unique(of).tolist():
                mine = bit[of == k]
                np.bitwise_or.at(found.setdefault(k, np.zeros((1 << piece) // 8, np.uint8)), mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for k, part in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["piece", "bits"])

    marked = grams.select("gram").mapInArrow(bits, "piece long, bit long").repartition("piece")
    out = bytearray((1 << log2) // 8)
    for r in marked.mapInArrow(pieces, "piece long, bits binary").collect():
        out[r.piece * len(r.bits) : (r.piece + 1) * len(r.bits)] = r.bits
    return log2, bytes(out), sorted(r["size"] for r in counts)


def _folded(text: str) -> str:
    """Lower case; letters that equal ASCII ones when case is ignored become these, so that the length stays."""
    if not text.isascii():
        for odd, plain in zip(ODD_LETTERS, "sii", strict=True):
            text = text.replace(odd, plain)
    return text.lower()


def grams_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, gram, at``: the distinct grams of the folded texts of ``id, value`` that are among ``wanted(gram)``, and a few others,
    with the places where they are; null if these are more than ``_NEAR``."""
    log2, bits, sizes = _bitmap(wanted)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def hits(joined: str, table: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, len(joined), _SLAB):
            codes = _codes(joined[at : at + _SLAB + STEPS[-1] - 1])
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * power[: len(codes)], out=sums[1:])
            for size in sizes:
                n = min(_SLAB, len(codes) - size + 1)
                if n > 0:
                    hashes, found = (sums[size : size + n] - sums[:n]) * inverse[:n], np.arange(n)
                    for i in (0, 1):
                        slots = _slots(hashes, size, log2, i)
                        some = np.flatnonzero(table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
                        hashes, found = hashes[some], found[some]
                    yield size, found + at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (power, inverse) = np.frombuffer(shared.value, np.uint8), _powers(_SLAB + STEPS[-1])
        for batch in batches:
            ids, texts, first = batch.column(0).to_pylist(), [_folded(t) for t in batch.column(1).to_pylist()], 0
            while first < len(texts):
                # Short texts share a slab; what reaches from one into the next is no gram.
                last, n = first, 0
                while last < len(texts) and n < _SLAB:
                    n, last = n + len(texts[last]), last + 1
                joined, ends = "".join(texts[first:last]), np.cumsum([len(t) for t in texts[first:last]])
                out: dict[tuple[int, str], list[int]] = {}
                for size, at in hits(joined, table, power, inverse):
                    row = np.searchsorted(ends, at, "right")
                    inside = at + size <= ends[row]
                    for r, p in zip(row[inside].tolist(), at[inside].tolist(), strict=True):
                        places = out.setdefault((r, joined[p : p + size]), [])
                        if len(places) <= _NEAR:
                            places.append(p - (int(ends[r - 1]) if r else 0))
                places = pa.array([p if len(p) <= _NEAR else None for p in out.values()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[first + r] for r, _ in out], pa.int64()), pa.array([g for _, g in out], pa.string()), places], ["id", "gram", "at"]
                )
                first = last

    return rows.select("id", "value").mapInArrow(run, "id long, gram string, at array<int>")


def indexed(detectors: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, det``: for each detector of ``det, literal`` the gram of its literal that the fewest of ``grams`` (one row a text and
    gram) hold; detectors whose literal has a gram that no text holds are left out, those without a literal are under the empty one.
    A detector may come with several literals, a row each."""
    own = posted(detectors)
    counted = grams.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = own.join(counted, "gram", "left").groupBy("det", "literal").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("gram"))).alias("best")
    )
    plain = detectors.where(F.col("literal").isNull() | (F.length("literal") < SHORT))
    return rarest.where("best.texts > 0").select("best.gram", "det").union(plain.select(F.lit(_EVERY).alias("gram"), "det")).distinct()


def _around(text: Column, at: Column, width: Column) -> Column:
    """The parts of a text that hold all that is less than ``width`` characters from sorted places; parts that meet are one.

    Every match of ``width`` characters at most that holds what is at a place is in its part, with all that it could have taken.
    """
    apart = lambda a, b: b - a > 2 * width
    first = F.filter(at, lambda p, i: (i == 0) | apart(F.get(at, i - 1), p))
    last = F.filter(at, lambda p, i: (i == F.size(at) - 1) | apart(p, F.get(at, i + 1)))
    begin = lambda p: F.greatest(p - width, F.lit(0))
    return F.zip_with(first, last, lambda a, b: F.substr(text, begin(a) + 1, b + width - begin(a)))


def scan_with_table(
    cells: DataFrame,
    catalog: DataFrame,
    text: str = "value",
    *,
    name: str = "pattern_name",
    pattern: str = "pattern",
    redacted: bool = False,
    group_mode: str = "whole",
    unicode: bool = True,
) -> DataFrame:
    """The findings of ``scan`` for detectors kept as rows ``(name, pattern)`` in Python syntax: one row a cell and detector that matched.

    All columns of ``cells`` but ``text`` are carried along, unless they have the name of one that is added. Names may
    repeat: each row of the catalogue is a detector. An empty catalogue finds nothing.
    """
    if group_mode not in ("whole", "first"):
        raise ValueError(f"group_mode is 'whole' or 'first', not {group_mode!r}")
    carried = [c for c in cells.columns if c != text and c not in _ADDED]
    value = F.col(f"`{text}`").cast("string")
    # One struct holds what is carried, so its names meet none of ours.
    cell = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("_"))
    rows = cells.where(value.isNotNull() & (value != "")).select(cell.alias("cell"), value.alias("value"))
    rows = written(rows.withColumn("id", F.monotonically_increasing_id()), "table-scan", compact=False)
    detectors = written(spelled(catalog, name, pattern).withColumn("det", F.monotonically_increasing_id()), "detectors")

    literals = detectors.select("det", F.explode_outer("literals").alias("literal"))
    grams = written(grams_of(rows, posted(literals).select("gram")), "text-grams")
    index = written(indexed(literals, grams), "detector-index")
    every = rows.select("id", F.lit(_EVERY).alias("gram")).join(index.where(F.col("gram") == _EVERY), "gram")
    every = every.select("id", "det", F.array().cast("array<int>").alias("at"), F.lit(True).alias("whole"))
    # A text may hold several literals of a detector.
    some = grams.join(index.where(F.col("gram") != _EVERY), "gram").groupBy("id", "det").agg(
        F.array_sort(F.flatten(F.collect_list("at"))).alias("at"), F.bool_or(F.col("at").isNull()).alias("whole")
    )
    held = some.union(every).join(detectors, "det").join(rows, "id")
    # The literal must be there; one too short for a gram has not been looked for yet.
    plain = F.lower(F.translate("value", "".join(ODD_LETTERS), "sii"))
    there = F.exists("literals", lambda literal: F.contains(plain, literal))
    held = held.where(F.when(F.col("whole") & (F.size("literals") > 0), there).otherwise(True))

    regex = F.concat(F.lit(UNICODE_FLAGS if unicode else ASCII_FLAGS), F.col("pattern"))
    group = F.when(F.col("groups") == 1, 1).otherwise(0) if group_mode == "first" else F.lit(0)
    matches = lambda where: F.regexp_extract_all(where, regex, group)
    entire = F.col("whole") | F.col("width").isNull() | (F.size("at") > _NEAR)
    matches = F.when(entire, matches(F.col("value"))).otherwise(F.flatten(F.transform(_around(F.col("value"), F.col("at"), F.col("width")), matches)))
    # A generator runs the pattern once for what it keeps; a filter and a projection would each run it.
    found = held.select("cell", "pattern_name", "value", F.explode(F.filter(F.array(matches), lambda m: F.size(m) > 0)).alias("matches"))
    return (
        found.select("cell", "pattern_name", tidy_matches(F.col("matches"), redacted).alias("matches"), sample_text(F.col("value"), redacted).alias("sample_text"))
        .select(*[F.col(f"cell.`{c}`") for c in carried], "pattern_name", "matches", F.size("matches").alias("total_exposed"), "sample_text")
    )
