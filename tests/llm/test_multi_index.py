"""The traversal against a full sort, results and recall against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsift.llm import multi_index as m
from cellsift.llm.queries import op1_multi_index


def brute(rows, asked, k):
    """All (query, rank, id, score) over rows of (id, vector)."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    out = {}
    for q in asked:
        if q in good:
            c = [(-(good[q] @ v) / np.linalg.norm(good[q]) / np.linalg.norm(v), i) for i, v in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in c)[:k]]
    return out


def collected(df, name="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r[name], round(r.score, 12)))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_visits_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(12), rng.random(9), rng.integers(0, 4, (12, 9))
    order = sorted(((a[i] + b[j], i, j) for i in range(12) for j in range(9)))
    want, held = [], 0
    for _, i, j in order:
        if held >= 60:
            break
        held += counts[i, j]
        if counts[i, j]:
            want.append((i, j))
    assert m.visited(a, b, counts, 60) == want
    assert len(m.visited(a, b, counts, 10**9)) == np.count_nonzero(counts)


def test_all_cells_give_the_exact_answer(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 6)).tolist()
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[7]) for i in range(60)]  # a hot vector
    rows += [(2000, [0.0] * 6), (2001, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] + [1.0] * 5)]
    rows += [(2004, [float("inf")] + [1.0] * 5), (2005, [2 * x for x in vectors[9]]), (None, vectors[3]), rows[5], rows[5], (2006, [1.0])]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(5)
    asked = {i for i, _ in rows if i is not None and i % 10 == 0 or i == 7}
    want = brute([r for r in rows if r[0] != 2006], asked, 5)
    is_query = (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 7)
    assert collected(m.search(frame, is_query, share=1.0, centroids=8)) == {
        q: [(i, round(s, 12)) for i, s in near] for q, near in want.items()
    }
    monkeypatch.setattr(m, "VECTOR_BLOCK", 10)
    monkeypatch.setattr(m, "QUERY_BLOCK", 7)
    assert collected(m.search(frame, is_query, share=1.0, centroids=8)).keys() == want.keys()
    got = collected(m.search(frame, is_query, share=1.0, centroids=8))
    assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(0, None)], [(0, [0.0, 0.0]), (1, [1.0, 1.0])]])
def test_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert m.search(frame, F.col("vec_id") % 50 == 0).collect() == []


def test_fewer_than_asked_for(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = collected(m.search(frame, F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == [1, 2]


def test_query_has_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = collected(op1_multi_index(spark, sf))
    assert got.keys() == want.keys() and all(len(got[q]) == 5 for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
