"""Whitening against a plain eigen decomposition of the exact covariance."""

import math

import numpy as np
import pytest

from cellsift.llm import whitening as w
from cellsift.llm.queries import op11_chebyshev_whitening


def plain(vectors, scale=64, shift=1_000_000):
    """Integer rows, exact deviations, eigenvalues and vectors, and the whitened rows."""
    x = [[math.floor(scale * float(c)) + shift for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    moved = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    centred = np.array(moved, np.float64) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return [sum(c * c for c in row) for row in moved], values[::-1], parts[:, ::-1], centred


def check(vectors, got, components):
    deviations, values, parts, centred = plain(vectors)
    k = min(components, int((values > w.NOTHING * values[0]).sum()))
    assert all(len(r.whitened) == k for r in got.values())
    for i, r in got.items():
        assert r.deviation == deviations[i]
    mine = np.array([got[i].whitened for i in sorted(got)])
    want = centred @ parts[:, :k] / np.sqrt(values[:k])
    want *= np.sign((mine * want).sum(axis=0))
    return np.abs(mine - want).max(), values[:k] / values.sum()


@pytest.mark.parametrize("decay", [0.0, 0.3, 3.0])
def test_against_plain(spark, decay):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    vectors = (rng.standard_normal((900, 40)) * (1 + np.arange(40)) ** -decay) @ turn * 3 + 7
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").repartition(3)
    out, model = w.whiten(frame, 12)
    off, shares = check(vectors, {r.vec_id: r for r in out.collect()}, 12)
    gap = -np.diff(model.values).max()
    assert off < 1e-8 + 100 * np.finfo(float).eps * model.values[0] / gap  # the plain vectors are no better than that
    assert np.allclose(model.values / model.trace, shares, rtol=1e-10)
    assert model.identity_error < 1e-9 and model.residual < w.RESIDUAL


def test_block_is_smaller_than_the_space_and_passes_are_few():
    rng = np.random.default_rng(5)
    d = 400
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.uniform(0.9, 1.1, d))[::-1]
    v = (turn * values) @ turn.T
    seen = []

    def times(q):
        seen.append(q.shape[1])
        return v @ q

    found, vectors, residual = w.leading_pairs(times, d, 32)
    assert max(seen) == 48 and len(seen) < 400
    assert np.allclose(found, values[:32], atol=1e-12) and residual < 1e-11
    assert np.abs(np.abs((turn[:, :32] * vectors).sum(axis=0)) - 1).max() < 1e-10


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((50, 3)).tolist()
    rows = [(i, v) for i, v in enumerate(good)] + [(7, good[7]), (None, good[1])]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [math.nan, 0.0, 1.0]), (93, [math.inf, 0.0, 1.0]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    out, model = w.whiten(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), 32)
    found = out.collect()
    assert model.centre.n == 52 and len(found) == 52 and {r.vec_id for r in found} == {None, *range(50)}
    assert all(len(r.whitened) == 3 for r in found)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_varies(spark, rows):
    out, _ = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 32)
    assert out.collect() == [] and out.columns == ["vec_id", "deviation", "whitened"]


def test_directions_without_variance_give_no_component(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-50, 50, (300, 3)).astype(float)
    vectors = np.hstack([base, base[:, :1] + base[:, 1:2], np.zeros((300, 60))])
    out, model = w.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), 32)
    assert len(model.values) == 3 and model.identity_error < 1e-9
    off, _ = check(vectors, {r.vec_id: r for r in out.collect()}, 32)
    assert off < 1e-8


def test_integers_beyond_64_bits():
    x = np.array([[5, -3], [1 << 51, 2], [9, 1 << 50]], np.int64)
    n = 10**6
    centre = w.Centre.of(n, [123456789, -5], [int(c) for c in x.min(axis=0)], [int(c) for c in x.max(axis=0)])
    want = [[n * int(a) - 123456789, n * int(b) + 5] for a, b in x]
    assert centre.times_n(x).tolist() == want
    sums = [sum(v * v for v in row) for row in want]
    assert centre.deviations(x) == [s if s < 1 << 63 else None for s in sums]


def test_many_tasks(spark, monkeypatch):
    vectors = np.random.default_rng(4).standard_normal((200, 5))
    monkeypatch.setattr(w, "FAN", 1)
    x = spark.createDataFrame([(i, [int(c * 64) + 10 for c in v]) for i, v in enumerate(vectors)], "id long, x array<long>").repartition(6)
    assert np.allclose(w.fit(x, 5).values, np.linalg.eigvalsh(np.cov(np.trunc(vectors.T * 64), bias=True))[::-1])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    ids = sorted(rows)
    found = op11_chebyshev_whitening(spark, folder).toPandas()
    deviations, values, parts, centred = plain([rows[i] for i in ids])
    assert len(found) == 32 * len(ids) and set(found.n) == {len(ids)}
    wide = found.pivot(index="vec_id", columns="component", values="whitened")
    want = centred @ parts[:, :32] / np.sqrt(values[:32])
    want *= np.sign((wide.to_numpy() * want).sum(axis=0))
    assert np.abs(wide.to_numpy() - want).max() < 1e-8
    assert found.groupby("vec_id").deviation.first().tolist() == deviations
    explained = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, (values / values.sum())[:32], rtol=1e-10)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
