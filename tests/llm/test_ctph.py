"""Fingerprints against their definition, the report of edits against plain Python."""

import hashlib

from cellsift.llm import ctph
from cellsift.llm.queries import op4_piecewise_hash


def plain(rows):
    """The report, with documents put in order on the spot."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for (i, text, *_), (_, following, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [ctph.fingerprint(t) for t in (text, edited, following)]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(text), digest, *marks[:2], ctph.likeness(marks[0], marks[1]), ctph.likeness(marks[0], marks[2])))
    return sorted(out, key=str)


def test_likeness():
    text = "".join(f"word{i * i} " for i in range(2000))
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(text)) == 1.0
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(text.replace("word400 ", "other "))) > 0.9
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint("y" + text)) > 0.9
    assert ctph.likeness(ctph.fingerprint(text), ctph.fingerprint(text[::-1])) < 0.2
    assert ctph.likeness(ctph.fingerprint(""), ctph.fingerprint(None)) == 1.0
    assert ctph.likeness(ctph.fingerprint(""), ctph.fingerprint("a")) == 0.0
    assert ctph.likeness(None, ctph.fingerprint("a")) is None


def test_edit_distance_is_that_of_insertions_and_deletions():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        return row[-1]

    cut = lambda s: [s[i : i + 2] for i in range(0, len(s), 2)]
    for a, b in (("AABBCC", "AACC"), ("AABBAABB", "BBAABBAA"), ("AA", "BB"), ("AABBCCDDEE", "CCAAEEBBDD")):
        assert ctph._alike(a, b) == 1 - slow(cut(a), cut(b)) / (len(cut(a)) + len(cut(b)))


def test_blocks_change_nothing(monkeypatch):
    texts = ["".join(f"{i * 7919 % 1009}-é " for i in range(n)) for n in (0, 1, 3, 40, 900)]
    want = [ctph.fingerprint(t) for t in texts]
    assert all(len(w.split(":")[1]) <= 2 * (ctph.PIECES + 1) for w in want)
    monkeypatch.setattr(ctph, "_BLOCK", 64)
    assert [ctph.fingerprint(t) for t in texts] == want


def test_report(spark):
    rows = [(i * 3, f"{'ab cd %d ' % i * (i % 7 * 30)}é😀", 1) for i in range(60)]
    rows += [(None, "no id", 1), (15, None, 1), (15, "same id", 1), (15, "same id", 1), (21, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int").repartition(7)
    assert sorted(map(tuple, ctph.edit_report(docs).collect()), key=str) == plain(rows)


def test_few_rows(spark):
    for rows in ([], [(4, "alone")], [(None, "alone")], [(7, "x" * 50)] * 3, [(1, None), (2, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, ctph.edit_report(docs).collect()), key=str) == plain(rows)


def test_fingerprints_column(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in ctph.fingerprints(docs).collect()}
    assert got == {1: ctph.fingerprint("a b"), 2: "4::"}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_piecewise_hash(spark, sf).collect()), key=str) == plain(docs)
