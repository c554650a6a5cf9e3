"""The burst trie against plain dicts of prefixes."""

import hashlib
import random
import zlib

import pytest

from cellsift.llm import prefix_trie as p
from cellsift.llm.queries import op13_burst_trie


def sequences(rows, group=100):
    """Rebuilt conversations from rows ``(conv, turn, role, text)``."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, _mark(role, text), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - abs(c) % group * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _mark(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.md5(str(len(role)).encode() + b":" + role + text).digest()


def plain(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(sequences[c]) == len(k))))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return _sorted(out)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r))


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


def random_rows(seed, convs, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, convs):
        for turn in range(rng.randint(0, longest)):
            rows.append((c * 7, turn, rng.choice(["user", None]), rng.choice(words)))
    return rows


CASES = {
    "mixed": random_rows(1, 150, ["a", "bb", "é", None, ""], 7),
    "one text": random_rows(2, 120, ["same"], 9),
    "copies": [(c, t, "user", f"t{t}") for c in range(300, 400) for t in range(8)] + [(1, 0, "user", "t0")],
    "odd": [(None, 1, "user", "x"), (5, None, None, None), (5, 1, "u", "v"), (5, 1, "u", "v"), (5, 1, "u", "w"), (7, 3, "", ""), (107, 0, "a", "b")],
    "one": [(42, 1, "user", "x")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize(("size", "burst"), [(1024, 1024), (3, 4)])
def test_against_plain(spark, name, size, burst):
    got = p.shared_prefixes(frame(spark, CASES[name]), size=size, burst=burst).collect()
    assert _sorted(map(tuple, got)) == plain(sequences(CASES[name]))


def test_empty(spark):
    assert p.shared_prefixes(frame(spark, [])).collect() == []


def test_deep_conversations_that_part_late(spark):
    """Two conversations of many segments that differ in a turn of the last one, and a copy of one of them."""
    turns = [f"turn {i}" for i in range(50)]
    rows = [(c, i, "user", t if (c, i) != (2, 44) else "other") for c in (1, 2, 3) for i, t in enumerate(turns)]
    got = p.build(_numbered(spark, rows), spark.createDataFrame([(c,) for c in (1, 2, 3, 9)], "conv long"), size=4, burst=3)
    own = {c: [("user", t) for _, _, _, t in sorted(r for r in rows if r[0] == c)] for c in (1, 2, 3)} | {9: []}
    assert _sorted(map(tuple, got.collect())) == plain(own)


def _numbered(spark, rows):
    return p.numbered_turns(frame(spark, rows)).select("conv", "place", "mark", "length")


def test_a_common_first_turn_bursts(spark):
    """Containers of one turn id are cut by the next one: no task sweeps more than a container."""
    rows = [(c * 100, t, "user", "hello" if t == 0 else f"{c % 40} {t}" if t == 1 else f"{c} {t}") for c in range(400) for t in range(4)]
    turns = _numbered(spark, rows)
    cut = p.segments(turns, 1024)
    boxes = cut.select("conv", "marks", "lengths")
    assert boxes.count() == 400
    found = p.build(turns, turns.select("conv").distinct(), burst=50).collect()
    assert _sorted(map(tuple, found)) == plain({c * 100: [("user", x[3]) for x in rows if x[0] == c * 100] for c in range(400)})


def test_classes(spark, monkeypatch):
    monkeypatch.setattr(p, "CHUNK", 3)
    rows = [(i, 1, 2, 3) for i in range(40)] + [(100 + i, i % 2, 0, 1) for i in range(9)]
    got = {(r.one, r.two, r.n): (r.conv, r.c, bytes(r.ends).hex()) for r in p.classes(spark.createDataFrame(rows, "conv long, one long, two long, n long").repartition(4)).collect()}
    want = {}
    for conv, *key in rows:
        want.setdefault(tuple(key), []).append(conv)
    assert got == {k: (min(v), len(v), hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest()) for k, v in want.items()}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _sorted(map(tuple, op13_burst_trie(spark, folder).collect())) == plain(sequences(rows))
