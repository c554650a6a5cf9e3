"""Approximate nearest neighbours by an inverted multi-index.

Vectors are brought to length one and cut into two halves, each with a code book of its own (k-means on a bounded
sample). A vector lies in the cell of its two nearest centroids. A query takes pairs of centroids in the order of
their summed distance, by a heap, until the cells visited hold the wanted share of all vectors, and ranks what lies in
them by the exact cosine.

The index holds every distinct vector once, with the smallest ids that share it; equal vectors are equally near, so no
more of them can be among the nearest. Cells of one first centroid form a posting list, cut into blocks; queries are
cut into blocks too, and a task multiplies one block of queries by one of vectors, hides the cells that a query did
not visit, and gives the best of each query.

Vectors that are null, of length zero, of another dimension than most, or with null or non-finite components take no
part, neither as query nor as neighbour. Ties go to the smaller id. Equal rows are neighbours of their own ids only;
rows of one id should be equal. With fewer vectors than asked for, all are returned. An empty table, or one without
queries, gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellsift.llm.common import mixed, ship, staged

ship(__name__)

#: Distinct vectors, those with the smallest hash of their components, that code books are learnt from. They come to the driver.
SAMPLE = 16_384
#: Centroids of each half; cells are their square.
CENTROIDS = 64
#: Share of all vectors that the cells visited by a query hold at least. Found by measuring recall on vectors without structure,
#: where the index helps least; clustered data do with a tenth of it.
SHARE = 0.45
ROUNDS = 15
VECTOR_BLOCK = 4096
QUERY_BLOCK = 2048
SALTS = 16


class Books:
    """Centroids of the two halves."""

    def __init__(self, sample: np.ndarray, centroids: int):
        unit = _unit(sample)
        self.split = sample.shape[1] // 2
        self.centroids = [_kmeans(h, centroids) for h in (unit[:, : self.split], unit[:, self.split :])]

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        unit = _unit(vectors)
        halves = unit[:, : self.split], unit[:, self.split :]
        return [
            np.maximum((h**2).sum(1)[:, None] - 2 * h @ c.T + (c**2).sum(1), 0)
            for h, c in zip(halves, self.centroids, strict=True)
        ]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(d.argmin(1) for d in self.distances(vectors))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # lengths of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    order = np.argsort(mixed(np.arange(len(distinct), dtype=np.uint64) + np.uint64(1)), kind="stable")
    centers = distinct[order[:k]].copy()
    for _ in range(ROUNDS):
        nearest = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(centers))
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def visited(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs of centroids in the order of their summed distance until their cells hold ``wanted`` vectors."""
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, out, held = [(first[by_first[0]] + second[by_second[0]], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(by_first[i]), int(by_second[j])
        held += int(counts[cell])
        if counts[cell]:
            out.append(cell)
        if j + 1 < len(second):
            heapq.heappush(heap, (first[by_first[i]] + second[by_second[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[by_first[i + 1]] + second[by_second[0]], i + 1, 0))
    return out


def distinct_vectors(vectors: DataFrame, keep: int, id_column: str, vector_column: str) -> DataFrame:
    """``(rep, ids, vec)``: every distinct valid vector with the ``keep`` smallest ids that hold it; ``rep`` is the first."""
    cell = F.col(f"`{vector_column}`").cast("array<double>")
    fine = F.forall(cell, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(cell, lambda x: x != 0)
    valid = vectors.where(F.col(f"`{id_column}`").isNotNull() & cell.isNotNull() & fine).select(
        F.col(f"`{id_column}`").alias("id"), cell.alias("vec")
    )
    sizes = valid.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    valid = valid.where(F.size("vec") == (sizes[0].d if sizes else 0))
    # A copied vector may fill a third of the table: its ids are cut down in many tasks before they meet in one.
    salted = W.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    first = valid.distinct().withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= keep).drop("rank")
    ranked = W.partitionBy("vec").orderBy("id")
    first = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= keep)
    listed = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return listed.select(F.col("ids")[0].alias("rep"), "ids", "vec")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
           share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """``query_id, rank, <id_column>, score``: the ``k`` nearest found of every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    id_kind = vectors.schema[id_column].dataType.simpleString()
    index = staged(distinct_vectors(vectors, k + 1, id_column, vector_column), "ann-vectors")
    hashed = F.xxhash64("vec")
    sample = index.orderBy(hashed, "rep").select("vec").limit(SAMPLE).collect()
    schema = f"query_id {id_kind}, rank int, {id_column} {id_kind}, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    books = Books(np.array([r.vec for r in sample], np.float64), centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                first, second = books.cells(np.stack(batch["vec"]))
                yield batch.assign(first=first.astype(np.int32), second=second.astype(np.int32))

    cell_schema = f"rep {id_kind}, ids array<{id_kind}>, vec array<double>, first int, second int"
    assigned = staged(index.mapInPandas(assign, cell_schema), "ann-cells")
    counts = np.zeros((centroids, centroids), np.int64)
    for r in assigned.groupBy("first", "second").count().collect():  # the square of the centroids
        counts[r.first, r.second] = r["count"]
    wanted = max(k + 1, int(np.ceil(share * counts.sum())))

    # An id whose vector many share may not be among the ids kept, so queries find theirs by vector.
    cell = F.col(f"`{vector_column}`").cast("array<double>")
    asked = vectors.where(is_query).select(F.col(f"`{id_column}`").alias("query_id"), cell.alias("vec")).distinct()
    asked = staged(asked.join(index.select("rep", "vec"), "vec").select("query_id", "rep"), "ann-queries")
    wanted_vectors = asked.select("rep").distinct().join(assigned.select("rep", "vec"), "rep")
    number = wanted_vectors.count()
    query_blocks = max(1, -(-number // QUERY_BLOCK))
    vector_blocks = [max(1, -(-int(n) // VECTOR_BLOCK)) for n in counts.sum(1)]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            if len(batch):
                vecs = np.stack(batch["vec"])
                for rep, vec, a, b in zip(batch["rep"], vecs, *books.distances(vecs), strict=True):
                    cells: dict[int, list[int]] = {}
                    for i, j in visited(a, b, counts, wanted):
                        cells.setdefault(i, []).append(j)
                    rows += [(rep, vec, i, js) for i, js in cells.items()]
            yield pd.DataFrame(rows, columns=["rep", "vec", "first", "seconds"])

    probes = wanted_vectors.mapInPandas(probe, f"rep {id_kind}, vec array<double>, first int, seconds array<int>")
    blocks_of = F.element_at(F.array(*[F.lit(n) for n in vector_blocks]), F.col("first") + 1)
    probes = probes.select(
        "first", F.explode(F.sequence(F.lit(0), blocks_of - 1)).alias("block"),
        F.pmod(F.xxhash64("rep"), F.lit(query_blocks)).cast("int").alias("part"), "rep", "vec", "seconds",
    )
    lists = assigned.select(
        "first", F.pmod(F.xxhash64("rep"), blocks_of).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), "rep", "vec", "second",
    )
    keys = ["first", "block", "part"]
    best = k + 1  # the query's own vector may be among them

    def rank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "rep", "score"]
        if not len(asking) or not len(held):
            return pd.DataFrame([], columns=columns)
        held = held.sort_values("rep", kind="stable")  # equal scores then stay in the order of ids
        v, second, reps = np.stack(held["vec"]), held["second"].to_numpy(), held["rep"].to_numpy()
        out = []
        for a in range(0, len(asking), 256):
            part = asking.iloc[a : a + 256]
            seen = np.zeros((len(part), centroids), bool)
            for row, seconds in enumerate(part["seconds"]):
                seen[row, seconds] = True
            scores = np.where(seen[:, second], _cosines(np.stack(part["vec"]), v), -np.inf)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :best]
            rows = np.repeat(np.arange(len(part)), order.shape[1])
            out.append(pd.DataFrame({
                "query": part["rep"].to_numpy()[rows], "rep": reps[order.ravel()], "score": scores[rows, order.ravel()]
            }))
        found = pd.concat(out)
        return found[np.isfinite(found["score"])]

    near = probes.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(rank, f"query {id_kind}, rep {id_kind}, score double")
    top = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = near.withColumn("place", F.row_number().over(top)).where(F.col("place") <= best)
    named = near.join(index.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("found"))
    listed = staged(named.groupBy("query").agg(F.collect_list(F.struct("score", "found")).alias("near")), "ann-near")
    ranked = F.array_sort("near", lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
                          .when(a["found"] < b["found"], -1).when(a["found"] > b["found"], 1).otherwise(0))
    listed = listed.select(F.col("query").alias("rep"), ranked.alias("near"))
    others = F.slice(F.filter("near", lambda x: x["found"] != F.col("query_id")), 1, k)
    return asked.join(listed, "rep").select("query_id", F.posexplode(others).alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.found").alias(id_column), "hit.score"
    )


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines in double precision; rows are scaled by powers of two first, which changes no digit."""
    q, v = (x * np.exp2(-np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (q, v))
    return (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1))
