"""Near duplicates: MinHash signatures, an inverted join on signature coordinates, exact links, connected components.

1. A document's set holds its distinct word shingles: words are runs of bytes that are not ASCII white space, A-Z
   lower-cased; a text with fewer words than a shingle has its whole sequence as the one shingle. Documents with equal
   sets are one class, which its smallest id stands for.
2. Each class has a MinHash signature and is posted under its coordinate-value pairs. Pairs that one class alone holds
   are dropped. Two classes at the wanted similarity share at least ``match threshold`` coordinates, but for a chance
   below ``MISS``, so a class with fewer shared pairs has no partner and is skipped; of the others only a prefix is
   joined, the rarest pairs without the last ``threshold - 1``: two classes that share enough meet in the prefix.
3. Classes that meet under a pair count their collisions. In a task the pairs of classes above the threshold only join
   trees, and each class of a tree is tied to its smallest, so that a group of thousands of near copies makes
   thousands of rows, not millions. Large posting lists are cut into blocks, every two of which meet in a task of
   their own. The components of these edges are the clusters.
4. The full sets of a cluster's classes meet again, in blocks, and all intersections are counted by matrix products of
   presence rows. Links are exact; what leaves the task ties each class of a tree to its smallest, and the components
   are the answer.

Only classes that share a cluster move their sets, and no pair is dropped or capped. A link whose signatures agree in
too few coordinates is still found if its classes share a cluster through others.

Null texts and texts without words have an empty set, are linked with nothing and are their own component. Rows of one
id should be equal; the smallest of repeated ids stands for itself. A row without an id is a class of its own set, but
never stands for one that has ids; a component without any id is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellsift.llm.common import SliceHasher, mixed, runs, ship, slices, staged
from cellsift.llm.components import Forest, components

ship(__name__)

#: MinHash coordinates, and the chance to miss a link at the wanted similarity by its signature alone.
COORDINATES = 64
MISS = 1e-6
#: Most classes of a posting list or of a cluster whose sets meet in one block; larger ones are cut.
POSTING_BLOCK = 1024
CLUSTER_BLOCK = 256
_JOIN = np.uint64(0x9FB21C651E98DF25)


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that a link at ``percent`` reaches with a chance of at least ``1 - miss``."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(1, t)
    return coordinates


# --- sets and signatures of texts


class Shingler:
    """Shingle hashes of many texts at once."""

    def __init__(self, words: int):
        self.words = words
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.words_of = SliceHasher()

    def sets(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        if not len(raw):
            yield from (np.zeros(0, np.uint64) for _ in range(len(offsets) - 1))
            return
        starts, ends = runs(~self.white[raw], offsets)
        self.words_of.over(self.lower[raw])
        hashes = self.words_of.hashes(starts, ends)
        bounds = np.searchsorted(starts, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield self._shingles(hashes[a:b])

    def _shingles(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        width = min(self.words, n)
        h = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            h = (h ^ words[i : n - width + 1 + i]) * _JOIN
            h ^= h >> np.uint64(32)
        return np.unique(h)


def signature_factors(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:coordinates] | np.uint64(1), seeds[coordinates:]


def signature(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest 32-bit value of each coordinate's hash over the set."""
    out = np.empty(len(factors[0]), np.uint32)
    for i, (a, b) in enumerate(zip(*factors, strict=True)):
        out[i] = ((hashes * a + b) >> np.uint64(32)).min()
    return out


def sketches(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """``id, n_shingles, mark, values``: size of the set, its digest and its signature; these two null for empty sets."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, factors = Shingler(words), signature_factors(coordinates)
        for batch in batches:
            for at, raw, offsets in slices(batch, 1):
                sizes, marks, values = [], [], []
                for hashes in shingler.sets(raw, offsets):
                    sizes.append(len(hashes))
                    marks.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                    values.append(signature(hashes, factors).view(np.int32) if len(hashes) else None)
                ids = batch.column(0).slice(at, len(sizes))
                arrays = [ids, pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(values, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "mark", "values"])

    return docs.mapInArrow(run, f"id {kind}, n_shingles long, mark binary, values array<int>")


# --- clusters: classes that signatures connect


def shared_pairs(classes: DataFrame, threshold: int) -> DataFrame:
    """``(rep, shared, met)``: the class's coordinate-value pairs that other classes hold too, rarest first, where it has enough
    of them; ``met`` is the prefix under which it is joined, with the length of each posting list."""
    posts = classes.select("rep", F.posexplode("values").alias("place", "value")).select(
        "rep", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("pair")
    )
    lists = posts.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    held = posts.join(lists, "pair").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("held"))
    enough = held.where(F.size("held") >= threshold)
    return enough.select(
        "rep", F.col("held.pair").alias("shared"), F.slice("held", 1, F.size("held") - threshold + 1).alias("met")
    )


def candidate_edges(shared: DataFrame, threshold: int, coordinates: int = COORDINATES) -> DataFrame:
    """``(a, b)``: for each posting list, or two of its blocks, what ties the classes that collide often enough."""
    kind = shared.schema["rep"].dataType.simpleString()
    met = shared.select("rep", "shared", F.explode("met").alias("m")).select("rep", "shared", "m.pair", "m.n")
    blocked = in_blocks(met, ["pair"], "n", POSTING_BLOCK)
    partitions = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["pair", "left", "right"]
    dealt = blocked.select(*keys, "block", "rep", "shared").repartition(partitions, *keys).sortWithinPartitions(*keys, "rep")

    def edges(group: dict[str, list]) -> list[tuple]:
        rows = np.repeat(np.arange(1, len(group["rep"]) + 1, dtype=np.int64)[:, None] * -1, coordinates, axis=1)
        for i, pairs in enumerate(group["shared"]):
            pairs = np.array(pairs, np.int64)
            rows[i, pairs >> 32] = pairs & 0xFFFFFFFF
        block = np.array(group["block"])
        left = np.flatnonzero(block == group["left"][0])
        right = np.flatnonzero(block == group["right"][0])
        tree = Forest(len(rows))
        for a in range(0, len(left), 64):
            mine = left[a : a + 64]
            counts = np.zeros((len(mine), len(right)), np.int16)
            for c in range(coordinates):
                counts += rows[mine, c][:, None] == rows[right, c]
            x, y = np.nonzero(counts >= threshold)
            tree.add(mine[x], right[y])
        return [(group["rep"][i], group["rep"][j]) for i, j in tree.edges()]

    return grouped_edges(dealt, 3, edges, kind)


def in_blocks(rows: DataFrame, keys: list[str], size: str, most: int) -> DataFrame:
    """Adds ``block, left, right``: a group of up to ``most`` rows is one block that meets itself; a larger one is cut into
    blocks by a hash of ``rep``, and each row goes to all meetings of its block with the others and with itself."""
    blocks = F.ceil(F.col(size) / most).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", *keys), blocks).cast("int")).withColumn("_blocks", blocks)
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    rows = rows.withColumn("_other", F.explode(others))
    return rows.select(
        *[c for c in rows.columns if c not in ("_blocks", "_other")],
        F.least("block", "_other").alias("left"),
        F.greatest("block", "_other").alias("right"),
    )


def grouped_edges(dealt: DataFrame, keys: int, edges, kind: str) -> DataFrame:
    """Calls ``edges`` on each run of rows with equal first columns and gives its pairs as ``(a, b)``."""
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, rows, out = None, {}, []
        made = pa.array([], pa.int64()).type
        for batch in batches:
            made = batch.schema.field(names.index("rep")).type
            columns = {name: batch.column(i).to_pylist() for i, name in enumerate(names)}
            runs = list(zip(*[columns[k] for k in names[:keys]], strict=True))
            at = 0
            while at < len(runs):
                end = at + 1
                while end < len(runs) and runs[end] == runs[at]:
                    end += 1
                if runs[at] != open_key:
                    out += edges(rows) if rows and len(rows["rep"]) > 1 else []
                    open_key, rows = runs[at], {name: [] for name in names}
                for name in names:
                    rows[name] += columns[name][at:end]
                at = end
            if len(out) > 10_000:
                yield _pairs(out, made)
                out = []
        out += edges(rows) if rows and len(rows["rep"]) > 1 else []
        yield _pairs(out, made)

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], ["a", "b"])


# --- exact links within clusters


def exact_edges(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b)``: what ties the classes of each cluster that exact links join."""
    kind = docs.schema["id"].dataType.simpleString()
    sized = clusters.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    members = clusters.join(sized, "component").select(F.col("node").alias("id"), "component", "n")
    # Texts meet their clusters by a shuffle at every size: the members are a share of all documents.
    wanted = docs.join(members.hint("merge"), "id").select("component", "n", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at, raw, offsets in slices(batch, 3):
                sets = [h.tobytes() for h in shingler.sets(raw, offsets)]
                arrays = [batch.column(i).slice(at, len(sets)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(sets, pa.binary())], ["component", "n", "rep", "hashes"])

    sets = wanted.mapInArrow(run, f"component {kind}, n long, rep {kind}, hashes binary")
    blocked = in_blocks(sets, ["component"], "n", CLUSTER_BLOCK)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["component", "left", "right"]
    dealt = blocked.select(*keys, "block", "rep", "hashes").repartition(partitions, *keys).sortWithinPartitions(*keys, "rep")

    def edges(group: dict[str, list]) -> list[tuple]:
        sets = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        block = np.array(group["block"])
        left, right = np.flatnonzero(block == group["left"][0]), np.flatnonzero(block == group["right"][0])
        tree = Forest(len(sets))
        x, y = linked(sets, left, right, percent)
        tree.add(x, y)
        return [(group["rep"][i], group["rep"][j]) for i, j in tree.edges()]

    return grouped_edges(dealt, 3, edges, kind)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of left and right whose sets have ``100 * intersection >= percent * union``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    # A shingle of one set adds to no intersection; one of all sets adds one to each.
    some = (counts > 1) & (counts < len(sets))
    numbers = np.where(some, np.cumsum(some) - 1, -1)
    owners = np.repeat(np.arange(len(sets)), sizes)
    codes = numbers[codes]
    owners, codes = owners[codes >= 0], codes[codes >= 0]
    order = np.argsort(codes, kind="stable")
    owners, codes = owners[order], codes[order]
    shared = np.full((len(left), len(right)), int((counts == len(sets)).sum()), np.float64)
    place = np.full(len(sets), -1)
    place_right = place.copy()
    place[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    for a in range(0, int(some.sum()), 4096):
        lo, hi = np.searchsorted(codes, [a, a + 4096])
        part, who = codes[lo:hi] - a, owners[lo:hi]
        rows = np.zeros((len(left), 4096), np.float32)
        columns = np.zeros((len(right), 4096), np.float32)
        mine = place[who] >= 0
        rows[place[who[mine]], part[mine]] = 1
        mine = place_right[who] >= 0
        columns[place_right[who[mine]], part[mine]] = 1
        shared += rows @ columns.T
    union = sizes[left][:, None] + sizes[right][None] - shared
    x, y = np.nonzero(100 * shared >= percent * union)
    return left[x], right[y]


# --- the whole


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
                    coordinates: int = COORDINATES) -> DataFrame:
    """``id_column, n_shingles, component_id`` for every row; ``component_id`` is the smallest id that links lead to."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    threshold = match_threshold(percent, coordinates)
    sketched = staged(sketches(rows, words, coordinates), "near-sketches")
    classes = staged(
        sketched.where(F.col("mark").isNotNull() & F.col("id").isNotNull())
        .groupBy("mark").agg(F.min(F.struct("id", "values")).alias("c"))
        .select("mark", F.col("c.id").alias("rep"), F.col("c.values").alias("values")),
        "near-classes",
    )
    shared = staged(shared_pairs(classes, threshold), "near-shared")
    clusters = components(staged(candidate_edges(shared, threshold, coordinates), "near-candidates"))
    links = components(staged(exact_edges(rows, clusters, words, percent), "near-links"))
    found = classes.join(links, F.col("rep") == F.col("node"), "left").select(
        F.col("mark").alias("_mark"), F.coalesce("component", "rep").alias("_component")
    )
    joined = sketched.drop("values").join(found, F.col("mark") == F.col("_mark"), "left")
    return joined.select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("_component", "id").alias("component_id")
    )
