"""Weights against their definition, passes against a plain dealing by the same weights."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellsift.llm import mixing as m
from cellsift.llm.queries import op8_temperature_mixing

SF = "/root/testdata/sf0.001"


def test_temperature():
    tokens = [9000, 500, 300, 200]
    alpha, weights, budget = m.temperature(tokens, 0.8, None)
    assert 0 < alpha < 1 and abs(m.entropy(weights) - 0.8 * math.log(4)) < 1e-6
    assert all(w * budget >= t * (1 - 1e-9) for w, t in zip(weights, tokens))
    alpha, weights, _ = m.temperature(tokens, None, None)
    low, high = m.entropy([t / 10_000 for t in tokens]), math.log(4)
    assert alpha < 1 and abs(m.entropy(weights) - (low + high) / 2) < 1e-6
    alpha, weights, budget = m.temperature(tokens, 0.8, 2.0)
    repeats = [w * budget / t for w, t in zip(weights, tokens)]
    assert max(repeats) <= 2.0 + 1e-3 and max(repeats) > 1.99 and abs(repeats[0] - 1) < 1e-3
    assert m.temperature(tokens, None, None, entropy_gain=None)[0] == 1.0
    assert abs(m.temperature(tokens, 1.0, None)[0]) < 1e-3
    assert m.temperature(tokens, 0.9, 1.5, budget=100_000)[0] == 1.0  # no alpha can keep ten passes under 1.5
    assert m.temperature([5, 0], 0.9, 2.0)[1] == [1.0, 0.0]
    assert m.temperature([0], 0.9, 2.0) == (1.0, [0.0], 0)
    assert m.temperature([], 0.9, 2.0) == (1.0, [], 0)


def check(rows, mixed, **goals):
    """Whole passes for all, part of one more, and no source over its budget or under it by more than a document."""
    tokens = Counter()
    longest = Counter()
    for _, source, text in rows:
        n = len((text or "").split())
        tokens[source] += n
        longest[source] = max(longest[source], n)
    names = list(tokens)
    _, weights, budget = m.temperature([tokens[s] for s in names], **goals)
    dealt, passes = Counter(), Counter()
    for r in mixed:
        dealt[r.source] += r.tokens
        passes[r.source, r["pass"], r.doc_id] += 1
    documents = Counter((s, i) for i, s, _ in rows)
    for s, w in zip(names, weights):
        if not tokens[s]:
            continue
        assert w * budget - longest[s] <= dealt[s] <= w * budget + 1e-6
        whole = int((w * budget + 1e-6) // tokens[s])
        for (source, i), n in documents.items():
            if source == s:
                assert all(passes[s, p, i] == n for p in range(whole))
                assert passes[s, whole, i] <= n and not passes[s, whole + 1, i]


@pytest.mark.parametrize("goals", [{}, {"repeats": 4.0}, {"entropy_gain": None}, {"entropy_share": 0.97}, {"budget": 900}, {"budget": 12_000, "repeats": None}])
def test_mix(spark, goals, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_DOCUMENTS", 9)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * (i % 9)) for i in range(300)]
    rows += [(900 + i, None, "null source") for i in range(5)] + [(None, "s1", "null id"), (5, "s1", None), (6, "void", "")]
    rows += [(1, "hot", "w ")] * 3
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, source string, text string, weight double").repartition(3)
    mixed = m.mix(docs, **goals)
    assert mixed.columns == ["doc_id", "source", "text", "tokens", "weight", "pass", "position"]
    check(rows, mixed.collect(), **goals)
    order(rows, mixed.collect())


def order(rows, mixed):
    """Every pass has its own order of blocks and documents, and the last one is a beginning of its order."""
    passes = {}
    for r in mixed:
        passes.setdefault((r.source, r["pass"]), {})[r.doc_id] = r.position
    sizes = {}
    for i, source, _ in rows:
        sizes.setdefault(source, set()).add(i)
    for (source, number), places in passes.items():
        if len(sizes[source]) < 20:
            continue
        ids = sorted(places, key=lambda i: (places[i], i is not None, i or 0))
        assert len(set(places.values())) == len(places)
        blocks = [places[i] >> 40 for i in ids]
        assert blocks == sorted(blocks) and set(blocks) <= set(range(1 << 16)) and ids != sorted(sizes[source], key=lambda i: i or 0)
        if number:
            earlier = passes[source, number - 1]
            both = [i for i in ids if i in earlier]
            assert len(both) < 12 or both != sorted(both, key=lambda i: earlier[i])


def test_blocks_are_permuted(spark):
    for k in (0, 1, 2, 3, 6, 10):
        rows = spark.range(1 << k).select("id", *[m.block_place(F.col("id"), F.lit(p), F.lit(1 << k).cast("long")).alias(f"p{p}") for p in range(4)]).collect()
        orders = [[r[f"p{p}"] for r in rows] for p in range(4)]
        assert all(sorted(o) == list(range(1 << k)) for o in orders)
        assert k < 3 or len({tuple(o) for o in orders}) == 4


def bisected(tokens, gain=0.5, repeats=2.0):
    """Weights by a plain search for the exponent."""
    shares = [t / sum(tokens) for t in tokens]

    def weights(alpha):
        powers = [s**alpha for s in shares]
        return [p / sum(powers) for p in powers]

    def repeated(w):
        return max(x / s for x, s in zip(w, shares)) / min(x / s for x, s in zip(w, shares))

    def h(w):
        return -sum(x * math.log(x) for x in w)

    goal = h(shares) + gain * (math.log(len(shares)) - h(shares))
    steps = [i / 20_000 for i in range(20_001)]
    alpha = max(a for a in steps if h(weights(a)) >= goal - 1e-12)
    return next((a for a in steps if a >= alpha and repeated(weights(a)) <= repeats), 1.0)


def test_empty_table(spark):
    assert m.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    mixed = op8_temperature_mixing(spark, SF).collect()
    check(rows, mixed)
    order(rows, mixed)
    tokens = Counter()
    for _, source, text in rows:
        tokens[source] += len((text or "").split())
    alpha = m.temperature(list(tokens.values()))[0]
    assert abs(alpha - bisected(list(tokens.values()))) < 2e-4 and alpha < 1  # the exponent binds on the given table
    assert {r["pass"] for r in mixed} >= {0, 1}
    assert {i for i, _, _ in rows} == {r.doc_id for r in mixed}
