"""A scan that stops, and a scan of changed files: what is not needed is never opened."""

import os

import pytest
from pyspark.sql import functions as F

from cellsift.operators.early_exit import scan_until
from cellsift.operators.scan import quick_exit, scan
from cellsift.plans.scan_plan import scan_connection
from cellsift.sources.files import listed_key, object_cells, read_changed, read_objects

NAMES = ["a b.txt", "a+b.txt", "a%20c.txt", "aé.txt", "b.txt", *(f"f{i:02}.txt" for i in range(20))]


@pytest.fixture
def folder(tmp_path):
    for i, name in enumerate(NAMES):
        (tmp_path / name).write_text(f"mail{i}@example.org and {i} more mail{i}@example.net" if i % 3 == 0 else "nothing")
    return tmp_path


def find(files):
    return scan(object_cells(files), "value", {"mail": r"[a-z0-9]+@[a-z.]+", "digits": r"[0-9]+ more"})


UNIT = ("bucket", "file_path")


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 7, 100])
@pytest.mark.parametrize("first", [1, 2, 50])
def test_same_rows_as_the_whole_scan(spark, folder, limit, first):
    files = read_objects(spark, str(folder))
    want = quick_exit(find(files), limit, unit=UNIT)
    got = scan_until(files, listed_key(), find, limit, UNIT, first)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_files_behind_the_line_are_never_opened(spark, folder):
    files = read_objects(spark, str(folder))
    in_order = sorted(NAMES)

    def only_the_first_are_left(part):
        for name in in_order[8:]:
            (folder / name).unlink(missing_ok=True)  # the listing still names them; opening one would fail
        return find(part)

    found = scan_until(files, listed_key(), only_the_first_are_left, 3, UNIT, first=2)
    hits = [name for name in in_order if NAMES.index(name) % 3 == 0]
    assert {os.path.basename(r.file_path) for r in found.collect()} == set(hits[:2])
    with pytest.raises(Exception, match="(?i)not exist|FAILED_READ_FILE"):
        find(files).collect()


def test_connection_stops_too(spark, folder):
    connection = {"sources": {"s3": {"one": {"path": str(folder)}}}, "options": {"quick_exit": True, "max_matches": 2}}
    found = scan_connection(spark, connection, catalog={"mail": r"[a-z0-9]+@[a-z.]+"}).collect()
    assert len(found) == 2 and {r.profile for r in found} == {"one"}


def test_empty_folder_and_nothing_found(spark, folder, tmp_path_factory):
    files = read_objects(spark, str(folder))
    assert scan_until(files, listed_key(), lambda f: find(f).where(F.lit(False)), 2, UNIT, 1).collect() == []
    assert scan_until(files.where(listed_key() == "no such key"), listed_key(), find, 2, UNIT).collect() == []


def test_only_changed_files_are_opened(spark, folder):
    nothing = spark.createDataFrame([], "path string, tag string")
    _, seen = read_changed(spark, str(folder), nothing)
    seen = spark.createDataFrame(seen.collect(), seen.schema)
    for name in ("a b.txt", "f03.txt", "[x]*{y}?.txt"):  # an old one, a middle one and a new one with signs of a pattern
        (folder / name).write_text(f"changed {name} 12")
    fresh, new = read_changed(spark, str(folder), seen)
    assert sorted(os.path.basename(p).replace("%20", " ") for p in fresh.inputFiles()) == sorted(["a b.txt", "f03.txt", "%5Bx%5D*%7By%7D%3F.txt"])
    assert {os.path.basename(r.file_path) for r in object_cells(fresh).collect()} == {"a b.txt", "f03.txt", "[x]*{y}?.txt"}
    again, none = read_changed(spark, str(folder), seen.union(new.select("path", "tag")))
    assert again.collect() == [] and none.count() == 0
