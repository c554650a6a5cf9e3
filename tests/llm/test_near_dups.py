"""Sets, links and components against brute force; the join against all pairs."""

import random
import re

import numpy as np
import pytest

from cellsift.llm import near_dups as nd
from cellsift.llm.common import text_bytes
from cellsift.llm.components import Forest, components
from cellsift.llm.queries import op9_coordinate_join


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    """(id, size of the set, smallest id reachable), by all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and None not in (i, j) and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sets():
    import pyarrow as pa

    texts = [None, "", " \t\n", "one", "A b", "a B\x0bc", "é É x", "a b c a b c", "a\xa0b c", "x" * 9000 + " y z", "a b c d", "b c d"]
    sets = list(nd.Shingler(3).sets(*text_bytes(pa.array(texts))))
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    for i, t in enumerate(texts):
        for j, u in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(shingles(t, 3) & shingles(u, 3))


def test_linked_counts_all_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.choice(60, rng.integers(1, 40), replace=False).astype(np.uint64)) for _ in range(80)]
    left, right = np.arange(0, 50), np.arange(20, 80)
    for percent in (20, 50, 100):
        x, y = nd.linked(sets, left, right, percent)
        want = {
            (i, j) for i in left for j in right
            if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))
        }
        assert set(zip(x.tolist(), y.tolist())) == want


def test_threshold():
    for percent in (80, 85):
        t = nd.match_threshold(percent)
        rng = np.random.default_rng(1)
        assert (rng.binomial(nd.COORDINATES, percent / 100, 1_000_000) < t).mean() < 1e-4
        assert t > nd.COORDINATES / 2


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for base in range(12):
        words = [word() for _ in range(rng.choice([5, 40, 150]))] + (passage if base % 2 else [])
        for copy in range(rng.choice([1, 3, 12])):
            edited = list(words)
            for _ in range(copy % 5):
                edited[rng.randrange(len(edited))] = word()
            rows.append((i * 7 % 1009, " ".join(edited)))
            i += 1
    rows += [(2000 + k, " ".join(words).upper()) for k in range(60)]  # copies but for case
    rows += [(3000, None), (3001, ""), (3002, "one"), (3003, "One"), (3004, "one two"), (None, "one"), (3005, " "), (3006, None)]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, n, percent, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_shingles int, mark string").repartition(4)
    # A row without an id belongs to the rows that have its set and an id.
    want = [(None, 1, 3002) if r[0] is None else r for r in brute(rows, n, percent)]
    assert found(nd.near_duplicates(docs, n, percent)) == want
    monkeypatch.setattr(nd, "POSTING_BLOCK", 3)
    monkeypatch.setattr(nd, "CLUSTER_BLOCK", 4)
    assert found(nd.near_duplicates(docs, n, percent)) == want


def test_empty_and_unlinked(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert found(nd.near_duplicates(docs)) == [(1, 2, 1), (2, 0, 2)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400),) * 2]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    tree = Forest(600)
    tree.add(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    want = {i: i for pair in edges if pair[0] != pair[1] for i in pair} | {i: root for root, i in tree.edges()}
    df = spark.createDataFrame([(b, a) for a, b in edges] + edges[:9], "a long, b long").repartition(3)
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op9_coordinate_join(spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
