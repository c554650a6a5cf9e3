"""Runs send each alert once, also when they are repeated or break off."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cellsift.operators.ledger import Ledger


def alerts(spark, *names):
    return spark.createDataFrame([(f"{hash_of(n)}", f"message {n}") for n in names], "msg_hash string, message string")


def hash_of(name):
    return hashlib.sha256(name.encode()).hexdigest()


def hashes(df):
    return sorted(r.msg_hash for r in df.collect())


def of(*names):
    return sorted(map(hash_of, names))


@pytest.mark.parametrize("compact_after", [1, 2, 50])
def test_each_alert_once(spark, tmp_path, compact_after):
    book = Ledger(spark, str(tmp_path / "book"), compact_after)
    assert hashes(book.send(alerts(spark, "a", "b", "a"), 1)) == of("a", "b")
    assert hashes(book.send(alerts(spark, "b", "c"), 2)) == of("c")
    assert hashes(book.send(alerts(spark, "b", "c"), 2)) == of("c")  # repeated
    assert hashes(book.send(alerts(spark, "a", "b", "c"), 4)) == []
    assert hashes(book.send(alerts(spark, "d", "a"), 5)) == of("d")
    assert hashes(book.all_sent()) == of("a", "b", "c", "d")
    assert sorted((r.run, r.msg_hash) for r in book.all_sent().collect())[:2] == [(1, h) for h in of("a", "b")]


def test_a_run_that_breaks_off(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), 3)
    book.send(alerts(spark, "a"), 1)
    book.send(alerts(spark, "b"), 2)
    (tmp_path / "outbox" / "run=2" / "_SUCCESS").unlink()  # as if it had stopped before its commit
    assert hashes(book.send(alerts(spark, "b", "c"), 3)) == of("b", "c")
    assert hashes(book.all_sent()) == of("a", "b", "c")


def test_bases(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), 2)
    for run in range(1, 8):
        book.send(alerts(spark, f"n{run}", "n1"), run)
    assert sorted(p.name for p in (tmp_path / "base").iterdir()) == ["upto=4", "upto=6"]
    # A lookup opens the folders of its own hashes alone, and the outboxes since.
    known = book._known(alerts(spark, "n2"), 6, 8)
    assert {f.split("/")[-2] for f in known.select(F.input_file_name().alias("f")).toPandas().f} <= {f"bucket={hash_of('n2')[:2]}", "run=7"}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and hash_of("n2")[:2] in plan
    assert hashes(book.send(alerts(spark, "n2"), 2)) == of("n2")  # settled: as it was
    with pytest.raises(ValueError, match="settled"):
        book.send(alerts(spark, "x"), 0)


def test_empty(spark, tmp_path):
    book = Ledger(spark, str(tmp_path))
    assert hashes(book.all_sent()) == []
    assert hashes(book.send(alerts(spark), 1)) == [] and hashes(book.send(alerts(spark, "a"), 2)) == of("a")
