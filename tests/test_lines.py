"""Files read by line against files read whole."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from cellsift import scan, scan_connection
from cellsift.sources.files import file_cells, read_files
from cellsift.sources.lines import PLACE, file_lines, scan_lines

CATALOG = {"ticket": r"[A-Z]{2}-[0-9]{4}", "word": r"secret\w*"}


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def shown(df):
    return sorted((r.file_path.rsplit("/", 1)[1], r.pattern_name, tuple(r.matches), r.total_exposed) for r in df.collect())


def test_the_same_findings_as_of_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(1)
    for n, end in ((3000, "\n"), (50, "\r\n"), (20, "\r")):
        lines = [f"line {i} AB-{draw.randrange(900):04d} secret{draw.randrange(40)} " + "x" * draw.randrange(40) for i in range(n)]
        (tmp_path / f"f{n}.txt").write_bytes(end.join(lines).encode())
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "long.log").write_text("y" * 50_000 + " ab-0001 " + "z" * 50_000)  # a line longer than many ranges
    (tmp_path / "odd.txt").write_bytes(b"\xff AB-7777 \xc3\nno\n\n\nAB-7777 AB-7776")
    (tmp_path / "b+c %41.txt").write_text("AB-1234")
    lines = file_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 30
    whole = scan(file_cells(read_files(spark, str(tmp_path))), "value", CATALOG)
    by_line = scan_lines(lines, CATALOG)
    assert shown(by_line) == shown(whole) and len(shown(whole)) == 9
    assert set(by_line.columns) == {"file_path", "member_path", "file_size", "modified_time", *whole.columns[2:]} - set(PLACE)
    assert sorted(r.file_path for r in by_line.collect()) == sorted(r.file_path for r in whole.collect())
    odd = {r.pattern_name: r for r in by_line.where(F.col("file_path").endswith("odd.txt")).collect()}["ticket"]
    assert odd.matches == ["AB-7776", "AB-7777"] and odd.sample_text == "\ufffd AB-7777 \ufffd" and odd.file_size == 32
    first = by_line.where(F.col("file_path").endswith("f3000.txt")).select("sample_text").distinct().collect()
    assert len(first) == 1 and first[0][0].startswith("line 0 ")


def test_files_too_large_for_a_row(spark, tmp_path, small_ranges):
    (tmp_path / "a.txt").write_text("nothing here\n" * 2000 + "AB-0001\n" + "AB-0002\n" * 2000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10000")
    try:
        assert scan(file_cells(read_files(spark, str(tmp_path))), "value", CATALOG).count() == 0
        assert shown(scan_lines(file_lines(spark, str(tmp_path)), CATALOG)) == [("a.txt", "ticket", ("AB-0001", "AB-0002"), 2)]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_exclusion_kinds_and_packed_text(spark, tmp_path):
    for name in ("keep/a.txt", "node_modules/b.txt", "keep/c.log", "keep/d.png", "keep/node_modules.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("AB-0001")
    (tmp_path / "keep" / "e.gz").write_bytes(gzip.compress(b"AB-0002\nAB-0003"))
    lines = file_lines(spark, str(tmp_path), ["node_modules", ".log"])
    assert shown(scan_lines(lines, CATALOG)) == [("a.txt", "ticket", ("AB-0001",), 1), ("e.gz", "ticket", ("AB-0002", "AB-0003"), 2)]
    one = str(tmp_path / "keep" / "node_modules.txt")
    assert file_lines(spark, one, ["node_modules"]).count() == 1  # a path that is one file is always read
    assert file_lines(spark, one, ["node_modules"], objects=True).count() == 0
    assert file_lines(spark, str(tmp_path), glob="*.log").count() == 1


def test_redacted_values_of_different_lines_are_one(spark, tmp_path):
    (tmp_path / "a.txt").write_text("AB-0001\nAB-1001\nCB-0001")
    found = scan_lines(file_lines(spark, str(tmp_path)), CATALOG, redacted=True).collect()
    whole = scan(file_cells(read_files(spark, str(tmp_path))), "value", CATALOG, redacted=True).collect()
    assert [r.matches for r in found] == [r.matches for r in whole] and found[0].total_exposed == len(found[0].matches) < 3


def test_connection(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("AB-0001\n\nAB-0002\nsecretive")
    (tmp_path / "in" / "b.txt").write_text("AB-0003")
    profile = {"path": str(tmp_path / "in")}
    for kind in ("fs", "s3"):
        whole, lines = (scan_connection(spark, {"sources": {kind: {"p": {**profile, "by_line": by}}}}, catalog=CATALOG) for by in (False, True))
        assert lines.columns == whole.columns
        key = lambda r: (r.file_path, r.pattern_name, r.matches, r.data_source, r.profile, r.host, r.bucket, r.file_size, r.modified_time)
        assert sorted(map(key, lines.collect()), key=str) == sorted(map(key, whole.collect()), key=str) and whole.count() == 3
    stopped = {"sources": {"s3": {"p": {**profile, "by_line": True}}}, "options": {"quick_exit": True, "max_matches": 1}}
    assert {r.file_path.rsplit("/", 1)[1] for r in scan_connection(spark, stopped, catalog=CATALOG).collect()} == {"a.txt"}
    with pytest.raises(ValueError, match="no cache"):
        scan_connection(spark, {"sources": {"fs": {"p": {**profile, "by_line": True, "cache": str(tmp_path / "c")}}}})
