"""Shards against a plain search over the same row of groups."""

import hashlib
import zlib

import pytest

from cellsift.llm import shards as s
from cellsift.llm.queries import op7_minimax_shards


def plain(rows, shards):
    """The smallest largest shard, by trying every capacity."""
    groups = {}
    for _, text in rows:
        raw = (text or "").encode()
        mark = hashlib.sha256(raw).digest()
        groups[mark] = groups.get(mark, 0) + len(raw) + 1
    sizes = [groups[m] for m in sorted(groups)]
    capacity = max([0, *sizes])
    while True:
        n, held = 1, 0
        for size in sizes:
            n, held = (n + 1, size) if held + size > capacity else (n, held + size)
        if n <= shards:
            return capacity
        capacity += 1


def check(rows, placed, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in placed) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by_text, held, slots = {}, {}, {}
    texts = {str(i): t or "" for i, t in rows}
    for r in placed:
        assert 0 <= r.shard < shards
        by_text.setdefault(texts[str(r.doc_id)], set()).add(r.shard)
        held[r.shard] = held.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if rows:
        assert max(held.values()) == plain(rows, shards)


CASES = {
    "mixed": [(i, "w" * (i * 37 % 101)) for i in range(150)] + [(None, None), (150, ""), (7, "w" * 57), (7, "w" * 57)],
    "hot": [(i, "same text") for i in range(60)] + [(100 + i, f"é{i}" * (i + 1)) for i in range(40)],
    "few": [(1, "a"), (2, "bb")],
    "one": [(i, "all") for i in range(9)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_minimax(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int").repartition(4)
    for n in (1, 3, 8):
        check(rows, s.shard(docs, n).collect(), n)


def test_searching_in_small_steps_finds_the_same(spark, monkeypatch):
    sizes = [i * 7919 % 97 + 1 for i in range(200)]
    ends = spark.createDataFrame([(sum(sizes[: i + 1]), x) for i, x in enumerate(sizes)], "end long, size long")
    want = s.smallest_capacity(ends, 7)
    monkeypatch.setattr(s, "TRIED_AT_ONCE", 2)
    assert s.smallest_capacity(ends, 7) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    placed = op7_minimax_shards(spark, sf).collect()
    check(rows, placed, 8)
    assert {(r.law, r.grown_shard) for r in placed} == {("bytes", None)}
