"""Columns of users that are named like ours."""

import io
import zipfile

from pyspark.sql import functions as F

from cellsift.operators.ordering import number_rows
from cellsift.operators.scan import any_hit, quick_exit, scan
from cellsift.sources.files import file_cells, read_files, unread_parts
from cellsift.sources.tables import table_cells

CATALOG = {"key": r"key=\w+", "digits": r"\d+"}
NAMES = ["_id", "_value", "_folded", "_odd", "_gate0", "_place", "_task", "_n", "_rank", "_before", "_scope", "matches", "pattern_name", "pattern_names",
         "sample_text", "total_exposed", "row no", "a.b"]


def frame(spark):
    rows = [(i, "key=a 12" if i % 2 else "none", *[f"{n} {i}" for n in NAMES]) for i in range(6)]
    return spark.createDataFrame(rows, ["no", "value", *NAMES])


def test_scan(spark):
    added = ["pattern_name", "matches", "total_exposed", "sample_text"]
    found = scan(frame(spark), "value", CATALOG)
    assert found.columns == ["no", *[n for n in NAMES if n not in added], *added]
    rows = found.where("pattern_name = 'key'").orderBy("no").collect()
    assert [(r.no, r.matches, r._id, r["a.b"], r._value) for r in rows] == [(i, ["key=a"], f"_id {i}", f"a.b {i}", f"_value {i}") for i in (1, 3, 5)]
    assert scan(frame(spark), "value", CATALOG, keep=("value", "matches")).columns == ["value", *added]


def test_any_hit_and_quick_exit(spark):
    assert any_hit(frame(spark), "value", CATALOG).orderBy("no").collect() == frame(spark).where("no % 2 = 1").orderBy("no").collect()
    found = frame(spark).drop("a.b")
    assert quick_exit(found, 2, unit=("no",)).orderBy("no").collect() == found.where("no < 2").orderBy("no").collect()


def test_number_rows(spark):
    got = number_rows(frame(spark), [F.col("no").desc()], name="_place").orderBy("no").collect()
    assert [(r._place, r._id, r._task) for r in got] == [(6 - i, f"_id {i}", f"_task {i}") for i in range(6)]


def test_table_without_columns_and_ids_named_like_cells(spark):
    df = spark.createDataFrame([(1, "x")], "value int, b string")
    assert table_cells(df, "t", ["b"], ["value", "b"]).collect() == []
    assert table_cells(df, "t", ["b"], ["value", "b"]).columns == ["b", "table", "column", "value"]
    cells = table_cells(df, "t", ["value", "b"])
    assert cells.columns == ["b", "table", "column", "value"] and {(r.column, r.value) for r in cells.collect()} == {("value", "1"), ("b", "x")}


def test_presentations_are_reported(spark, tmp_path):
    (tmp_path / "slides.pptx").write_bytes(b"anything")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("inner.pptx", b"x")
        z.writestr("inner.txt", "text")
    (tmp_path / "box.zip").write_bytes(packed.getvalue())
    files = read_files(spark, str(tmp_path))
    assert {(r.file_path.rsplit("/", 1)[1], r.member_path) for r in unread_parts(files).collect()} == {("slides.pptx", None), ("box.zip", "inner.pptx")}
    assert [r.value for r in file_cells(files).collect()] == ["text"]
