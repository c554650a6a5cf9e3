import io
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cellsift.operators.incremental import append_manifest, changed_objects
from cellsift.operators.scan import scan
from cellsift.sources.archives import MAX_DEPTH, extract
from cellsift.sources.documents import json_cells, key_value_cells, record_cells, scan_collections
from cellsift.sources.drive import FOLDER_TYPE, NATIVE_TYPES, drive_cells, drive_listing, drive_unread
from cellsift.sources.files import file_cells, file_metadata, listing, object_cells, oversize_files, read_changed, read_files, skipped_files, unread_parts, with_file_metadata
from cellsift.sources.literal import literal_cells
from cellsift.sources.tables import catalog_reader, catalog_tables, folder_tables, jdbc_options, pick_tables, scan_tables, table_cells

NUMBERS = {"digits": "[0-9]+"}


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- tables ---------------------------------------------------------------------------------------------------------


def test_cells_skip_empty_values(spark):
    df = spark.createDataFrame([(1, "x", 0, None), (2, "", 5, True), (0, "0", 7, False)], "id int, s string, n int, b boolean")
    assert rows(table_cells(df, "t", ["id"]), "id", "table", "column", "value") == sorted(
        [(1, "t", "id", "1"), (1, "t", "s", "x"), (2, "t", "id", "2"), (2, "t", "n", "5"), (2, "t", "b", "True"), (0, "t", "s", "0"), (0, "t", "n", "7")]
    )


def test_cells_of_odd_column_names(spark):
    df = spark.createDataFrame([("v", "w")], ["a b.c", "value"])
    assert rows(table_cells(df, "t"), "column", "value") == [("a b.c", "v"), ("value", "w")]


def test_excluded_columns_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "keep", "drop")], "id int, a string, secret string").write.parquet(path)
    cells = table_cells(spark.read.parquet(path), "t", exclude_columns=["secret", "absent"])
    plan = cells._jdf.queryExecution().toString()
    assert "secret" not in plan.split("ReadSchema")[-1]
    assert rows(cells, "column", "value") == [("a", "keep"), ("id", "1")]


def test_row_range(spark):
    df = spark.range(2000).select(F.col("id"), F.col("id").cast("string").alias("s"))
    cells = table_cells(df, "t", exclude_columns=["id"], order_by="id", limit_start=10, limit_end=5)
    assert [v for _, v in rows(cells, "column", "value")] == ["10", "11", "12", "13", "14"]
    with pytest.raises(ValueError):
        table_cells(df, "t", limit_end=5)


def test_table_choice(spark):
    assert pick_tables(["a", "b", "c"], ["c", "a", "x"]) == ["a", "c"]
    assert pick_tables(["a", "b"], []) == ["a", "b"]
    read = []

    def reader(name):
        read.append(name)
        return spark.range(1, 3)

    cells = scan_tables(["a", "b"], reader, ["b"], data_source="mysql", profile="p", host="h", database="d")
    assert read == ["b"]
    assert rows(cells, "data_source", "profile", "host", "database", "table", "column", "value") == [
        ("mysql", "p", "h", "d", "b", "id", "1"),
        ("mysql", "p", "h", "d", "b", "id", "2"),
    ]
    with pytest.raises(ValueError):
        scan_tables(["a"], reader, ["b"])


def test_jdbc_options():
    o = jdbc_options("jdbc:x", "t", "id", (1, 100), 8, {"user": "u"})
    assert o["partitionColumn"] == "id" and o["numPartitions"] == "8" and o["lowerBound"] == "1" and o["user"] == "u"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "id")


# --- documents, pairs, literals -------------------------------------------------------------------------------------


def test_json_fields(spark):
    body = '{"a":0,"b":"0","c":null,"d":{"x":[1]},"e":[],"f":false,"g":"t","i":{},"j":0.0,"k":true,"l":"","n":17}'
    df = spark.createDataFrame([("1", body), ("2", "{}"), ("3", "not json"), ("4", "[1]")], "id string, body string")
    assert rows(json_cells(df, "body", "id"), "doc_id", "field", "value") == [
        ("1", "b", "0"),
        ("1", "d", '{"x":[1]}'),
        ("1", "g", "t"),
        ("1", "k", "true"),
        ("1", "n", "17"),
    ]


def test_collections(spark, tmp_path):
    path = tmp_path / "people.json"
    path.write_text('{"_id":"p1","name":"n1","address":{"zip":"12345"},"tags":[],"age":0}\n{"_id":"p2","age":7}\n')
    cells = scan_collections(
        ["people", "other"], lambda n: record_cells(spark.read.json(str(path)), "_id"), ["people"], host="h", database="d"
    )
    assert rows(cells, "collection", "doc_id", "field", "value") == [
        ("people", "p1", "_id", "p1"),
        ("people", "p1", "address", '{"zip":"12345"}'),
        ("people", "p1", "name", "n1"),
        ("people", "p2", "_id", "p2"),
        ("people", "p2", "age", "7"),
    ]


def test_pairs(spark):
    df = spark.createDataFrame(
        [(bytearray(b"k1"), bytearray("é1".encode())), (bytearray(b"k2"), bytearray(b"")), (bytearray(b"k3"), bytearray(b"\xff9"))],
        "key binary, value binary",
    )
    assert rows(key_value_cells(df), "key", "value") == [("k1", "é1"), ("k3", "\ufffd9")]


def test_literals(spark):
    found = scan(literal_cells(spark, {"p1": "call 123", "p2": "none", "p3": ""}), "value", {**NUMBERS, "word": "call"})
    assert rows(found, "profile", "pattern_name", "data_source") == [("p1", "digits", "text"), ("p1", "word", "text")]


# --- files ----------------------------------------------------------------------------------------------------------


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def tarred(members, mode):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, body in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    return out.getvalue()


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DOCX = zipped(
    {
        "word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>11</w:t><w:tab/>'
        "<w:t>x</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>22</w:t></w:r></w:p></w:body></w:document>"
    }
)
XLSX = zipped(
    {
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>shared</t></si><si><r><t>rich</t></r><r><t>text</t></r></si></sst>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{S}"><sheetData><row><c t="s"><v>1</v></c><c/><c><v>33</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet xmlns="{S}"><sheetData><row><c t="b"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c>'
        '<c><f>A1+1</f><v>4</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>',
    }
)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree files")
    inner = zipped({"deep.txt": b"5 deep", "photo.png": b"7", "note.docx": DOCX})
    files = {
        "plain.txt": b"1 plain",
        "name with space & + %.txt": b"2 space",
        "bad.bin": b"\xff 3 \xfe",
        "empty.txt": b"",
        "skip.log": b"4 log",
        "sub/keep.txt": b"6 sub",
        "node_modules/lib/code.txt": b"8 lib",
        "a.zip": zipped({"in.txt": b"9 zip", "inner.zip": inner}),
        "b.tar": tarred({"t.txt": b"10 tar"}, "w"),
        "c.TAR.GZ": tarred({"g.txt": b"12 gz"}, "w:gz"),
        "broken.zip": b"13 not a zip",
        "doc.DOCX": DOCX,
        "sheet.xlsx": XLSX,
        "slides.pptx": zipped({"ppt/slides/slide1.xml": b"<a>14</a>"}),
        "photo.jpg": b"15 jpg",
        "paper.pdf": b"16 pdf",
    }
    for name, body in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(base)


def names(df, base):
    return sorted(os.path.relpath(r[0], base) for r in df.select("file_path").collect())


def test_tree(spark, tree):
    cells = file_cells(read_files(spark, tree, [".log", "node_modules"]))
    got = {
        (os.path.relpath(r["file_path"], tree), r["member_path"]): r["value"] for r in cells.collect()
    }
    word = "one 11\tx\n\n22\n"
    assert got == {
        ("plain.txt", None): "1 plain",
        ("name with space & + %.txt", None): "2 space",
        ("bad.bin", None): "\ufffd 3 \ufffd",
        ("sub/keep.txt", None): "6 sub",
        ("a.zip", "in.txt"): "9 zip",
        ("a.zip", "inner.zip/deep.txt"): "5 deep",
        ("a.zip", "inner.zip/note.docx"): word,
        ("b.tar", "t.txt"): "10 tar",
        ("c.TAR.GZ", "g.txt"): "12 gz",
        ("doc.DOCX", None): word,
        ("sheet.xlsx", None): "True\nin\n=A1+1\nshared\nrichtext\n33\n",
    }


def test_exclusion(spark, tree):
    everything = names(listing(read_files(spark, tree)), tree)
    assert len(everything) == 15  # Spark does not deliver empty files
    kept = names(listing(read_files(spark, tree, [".log", "node_modules", "plain", "space & + %"])), tree)
    assert set(everything) - set(kept) == {"skip.log", "node_modules/lib/code.txt", "plain.txt", "name with space & + %.txt"}
    # a pattern in the path of the base folder drops whole sub-folders but no file of the base itself
    base_name = os.path.basename(tree)
    kept = names(listing(read_files(spark, tree, [base_name])), tree)
    assert set(everything) - set(kept) == {"sub/keep.txt", "node_modules/lib/code.txt"}
    one = os.path.join(tree, "skip.log")
    assert names(listing(read_files(spark, one, [".log"])), tree) == ["skip.log"]


def test_excluded_files_are_never_opened(spark, tree):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "0")
    try:
        # Nothing fits a row any more, so nothing is opened, and what was passed over is listed.
        assert file_cells(read_files(spark, tree, [])).collect() == []
        assert oversize_files(spark, tree).count() == 15
        patterns = [".", "node_modules"]
        assert file_cells(read_files(spark, tree, patterns)).collect() == []
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_skipped_and_metadata(spark, tree):
    files = read_files(spark, tree)
    assert [(os.path.basename(p), k) for p, k in rows(skipped_files(files), "file_path", "file_kind")] == [
        ("paper.pdf", "pdf"),
        ("photo.jpg", "image"),
    ]
    meta = {os.path.basename(r["file_path"]): r for r in file_metadata(files).collect()}
    found = with_file_metadata(scan(file_cells(files), "value", {"n": "plain"}), files).first()
    assert (found["file_size"], found["modified_time"]) == (7, meta["plain.txt"]["modified_time"])
    assert meta["plain.txt"]["file_size"] == 7 and len(meta["plain.txt"]["modified_time"]) == 19


def test_unreadable_parts_are_rows(spark, tree):
    errors = extract(read_files(spark, tree, glob="*.zip")).where("error IS NOT NULL")
    got = {(os.path.basename(r["path"]), r["member_path"]) for r in errors.collect()}
    assert got == {("broken.zip", None), ("a.zip", "inner.zip/photo.png")}


def test_nesting_ends(spark):
    body = b"1"
    for _ in range(MAX_DEPTH + 1):
        body = zipped({"n.zip": body})
    df = spark.createDataFrame([("x.zip", bytearray(body))], "path string, content binary")
    [row] = extract(df).collect()
    assert "nested deeper" in row["error"]


def test_objects(spark):
    df = spark.createDataFrame(
        [
            ("s3a://bucket/a/b.txt", bytearray(b"1 x")),
            ("s3a://bucket/tmp/c.txt", bytearray(b"2 x")),
            ("gs://other/z.zip", bytearray(zipped({"m.txt": b"3"}))),
        ],
        "path string, content binary",
    )
    assert rows(object_cells(df, ["tmp/"]), "bucket", "file_path", "value") == [("bucket", "a/b.txt", "1 x"), ("other", "z.zip", "3")]


def test_changed_objects(spark, tmp_path):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, tag string")
    seen = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1")], "path string, tag string")
    assert rows(changed_objects(now, seen), "path") == [("b",), ("c",)]
    assert rows(changed_objects(now, seen, rescan=True), "path", "is_new") == [("a", False), ("b", True), ("c", True)]
    path = str(tmp_path / "manifest")
    append_manifest(changed_objects(now, seen), path)
    assert changed_objects(now, spark.read.parquet(path).union(seen)).count() == 0


def test_drive(spark):
    manifest = spark.createDataFrame(
        [
            ("1", "a.txt", "u1", "root", "text/plain"),
            ("2", "doc", "u1", "root", NATIVE_TYPES[0]),
            ("3", "folder", "u1", "root", FOLDER_TYPE),
            ("4", "b.txt", "u2", "root", "text/plain"),
            ("5", "c.txt", "u1", "sub", "text/plain"),
        ],
        "file_id string, file_name string, owner string, parent string, mime string",
    )
    whole = [("1", "a.txt", "a.txt"), ("2", "doc", "doc-runtime.pdf"), ("4", "b.txt", "b.txt"), ("5", "c.txt", "c.txt")]
    assert rows(drive_listing(manifest), "file_id", "file_name", "stored_name") == whole
    assert rows(drive_listing(manifest, "root"), "file_id", "file_name", "stored_name") == whole[:3]
    assert rows(drive_listing(manifest, "root", users=["u1"], exclude_patterns=[".pdf"]), "file_id", "user") == [("1", "u1")]
    users = spark.createDataFrame([("u2",), ("u3",)], "user string")
    assert rows(drive_listing(manifest, users=users), "file_id", "user") == [("4", "u2")]
    files = spark.createDataFrame([("file:/d/1/a.txt", bytearray(b"42"))], "path string, content binary")
    assert rows(drive_cells(drive_listing(manifest), files), "file_id", "file_name", "value") == [("1", "a.txt", "42")]
    assert rows(drive_unread(drive_listing(manifest)), "file_id", "file_kind") == [("2", "pdf")]


def test_drive_files_of_one_name_stay_apart(spark):
    manifest = spark.createDataFrame(
        [("1", "r.txt", "a", "root", "text/plain", None), ("2", "r.txt", "b", "root", "text/plain", None),
         ("3", "notes", "c", "root", NATIVE_TYPES[0], "file:/d/exported/notes.txt")],
        "file_id string, file_name string, owner string, parent string, mime string, path string",
    )
    files = spark.createDataFrame(
        [("file:/d/1/r.txt", bytearray(b"one")), ("file:/d/2/r.txt", bytearray(b"two")), ("file:/d/exported/notes.txt", bytearray(b"three"))],
        "path string, content binary",
    )
    listing = drive_listing(manifest, users=["a", "b", "c"])
    got = rows(drive_cells(listing, files), "file_id", "user", "file_name", "value")
    assert got == [("1", "a", "r.txt", "one"), ("2", "b", "r.txt", "two"), ("3", "c", "notes", "three")]
    assert drive_unread(listing).count() == 0


def test_a_file_too_large_for_a_row_does_not_end_the_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "large.txt").write_text("2" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        assert rows(file_cells(read_files(spark, str(tmp_path))), "value") == [("1",)]
        assert rows(oversize_files(spark, str(tmp_path)), "length") == [(5000,)]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_what_cannot_be_read_is_listed(spark):
    files = spark.createDataFrame([("file:/d/a.zip", bytearray(b"no zip")), ("file:/d/b.txt", bytearray(b"1"))], "path string, content binary")
    assert rows(unread_parts(files), "file_path") == [("/d/a.zip",)]


def test_tables_of_the_named_database(spark, tmp_path):
    try:
        for name, value in (("db_a", "here"), ("db_b", "there")):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{tmp_path}/{name}'")
            spark.createDataFrame([(value,)], "v string").write.saveAsTable(f"{name}.people")
        spark.range(1).createOrReplaceTempView("people")
        spark.sql("USE db_a")
        assert catalog_tables(spark, "db_b") == ["people"]
        assert rows(catalog_reader(spark, "db_b")("people"), "v") == [("there",)]
        assert rows(catalog_reader(spark)("people"), "v") == [("here",)]
    finally:
        spark.catalog.dropTempView("people")
        spark.sql("USE default")
        for name in ("db_a", "db_b"):
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_tables_of_a_folder(spark, tmp_path):
    for name in ("x", "y"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "_log").mkdir()
    assert folder_tables(spark, str(tmp_path), ".parquet") == ["x", "y"]


def test_files_of_other_kinds_stay_closed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1")
    (tmp_path / "b.zip").write_bytes(zipped({"m.txt": b"2"}))
    (tmp_path / "film.MP4").write_bytes(b"x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        assert rows(file_cells(read_files(spark, str(tmp_path))), "value") == [("1",), ("2",)]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_only_changed_files_are_opened(spark, tmp_path):
    folder, manifest = tmp_path / "in", str(tmp_path / "manifest")
    folder.mkdir()
    for name, age in (("old.txt", 3000), ("mid.txt", 2000)):
        (folder / name).write_text(f"first {name}")
        os.utime(folder / name, (1_700_000_000 - age,) * 2)
    nothing = spark.createDataFrame([], "path string, tag string")
    fresh, seen = read_changed(spark, str(folder), nothing)
    assert rows(file_cells(fresh), "value") == [("first mid.txt",), ("first old.txt",)]
    append_manifest(seen, manifest)

    (folder / "new.txt").write_text("x")
    os.utime(folder / "new.txt", (1_700_000_000,) * 2)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5")
    try:
        fresh, seen = read_changed(spark, str(folder), spark.read.parquet(manifest))
        assert rows(file_cells(fresh), "value") == [("x",)]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    append_manifest(seen, manifest)
    fresh, seen = read_changed(spark, str(folder), spark.read.parquet(manifest))
    assert fresh.count() == seen.count() == 0

    # changed in place, with an old time stamp: found by its tag although newer files were seen
    (folder / "old.txt").write_text("second")
    os.utime(folder / "old.txt", (1_700_000_000 - 2500,) * 2)
    fresh, _ = read_changed(spark, str(folder), spark.read.parquet(manifest))
    assert rows(file_cells(fresh), "value") == [("second",)]
