"""A catalogue held in a table finds what the same catalogue as a dict does; the SQL table function, too."""

import pytest
from pyspark.sql import functions as F

from cellsift.functions.sql import register_scan
from cellsift.catalog import literal_choices
from cellsift.operators.catalog_join import grams_of, indexed, scan_with_table
from cellsift.operators.scan import scan
from cellsift.operators.report import severity_totals

CATALOG = {
    "mail": r"[a-z0-9.]+@[a-z0-9.]+",
    "digits": r"[0-9]+",
    "kelvin": r"kelvin-[a-z]{2}",
    "key": r"key=(?P<v>\w+)",
    "either": r"(?:alpha|beta)\d",
    "short": r"ab\d?",
    "two groups": r"(sec)(ret)s?",
    "quote": "it's \"x\"",
    "back": r"a\\b",
    "never": r"zzzz-not-there",
}
TEXTS = [
    "a@b.c and KEY=Va1 and alpha1 beta2", "Kelvin-ab kelvin-cd", "ſecret secrets SECRET", "12 12 13 ab ab7 AB", "it's \"x\" a\\b", "", None, "none", "é" * 50 + "key=é",
    "İt's \"x\"",
]


def cells(spark):
    rows = [(i, t, "m", "v") for i, t in enumerate(TEXTS)] + [(None, "key=1", "m", "v"), (0, TEXTS[0], "m", "v")]
    return spark.createDataFrame(rows, "id long, text string, matches string, value string").repartition(3)


def as_rows(df):
    return sorted(map(str, df.select("id", "pattern_name", "matches", "total_exposed", "sample_text").collect()))


@pytest.mark.parametrize("options", [{}, {"group_mode": "first"}, {"redacted": True}, {"unicode": False}])
def test_like_the_dict(spark, options):
    table = spark.createDataFrame(list(CATALOG.items()) + [(None, "x"), ("y", None)], "pattern_name string, pattern string")
    found = scan_with_table(cells(spark), table, "text", **options)
    assert found.columns == ["id", "value", "pattern_name", "matches", "total_exposed", "sample_text"]
    want = scan(cells(spark).select("id", "text"), "text", CATALOG, **options)
    assert as_rows(found) == as_rows(want) and found.count() > 8


def test_patterns_run_around_their_grams(spark):
    """Like over whole texts: at either end, where matches touch or repeat often, with anchors and without bounds."""
    catalog = {
        "ends": "wonder[.,]", "any": "wonder.", "tail": "wonder[a-z]{0,3}x?", "head": "(?:ab){0,2}wonder", "edge": r"\bwonder\b", "start": "^wonder", "open": "wonder.*",
        "long": "a-literal-that-is-longer-than-any-of-the-steps-there-are-for-grams-of-it[ab]",
    }
    texts = [
        "wonder.", "Wonder,wonder.wonder", "wonderwonder,", "ababwonder wonderabcxx", "xwonder, 😀é wonder. wonder", "won der.", "İWonder.ſ",
        "wonder. " * 40 + "Wonder, wOnder.", "." * 70000 + "wonder," + "é" * 70000 + "wonder.", " A-literal-that-is-longer-than-any-of-the-steps-there-are-for-grams-of-itB",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    table = spark.createDataFrame(list(catalog.items()), "pattern_name string, pattern string")
    for options in ({}, {"unicode": False}):
        assert as_rows(scan_with_table(rows, table, "text", **options)) == as_rows(scan(rows, "text", catalog, **options))


def test_literals_go_on_with_small_sets():
    assert literal_choices("wonder[.,]") == (("wonder,", "wonder."), 7)
    assert literal_choices("wonder[^.,]x") == (("wonder",), 8) and literal_choices("wonder[a-c]")[0] == ("wonder",)
    assert literal_choices(r"wonder\b") == (("wonder",), None) and literal_choices("wonder.*") == (("wonder",), None)
    assert literal_choices("(?=x)wonder")[1] is None and literal_choices("[.,]") == ((), 1) and literal_choices("(") == ((), None)


def test_texts_give_out_only_grams_of_the_catalogue(spark):
    """One detector's grams are few, however long the texts: before, each text gave out all it has."""
    texts = spark.createDataFrame([(i, f"some wonder, and the number {i} " * 20) for i in range(200)], "id long, value string")
    found = grams_of(texts, spark.createDataFrame([("wonder,",), ("and the number 7",)], "gram string"))
    got = [(r.id, r.gram, r["at"]) for r in found.collect() if r.gram in ("wonder,", "and the number 7")]
    assert len(got) == 200 + 11 and found.count() < 250 and all(len(at) == 20 and at[0] in (5, 13) for _, _, at in got)


def test_empty_sides(spark):
    table = spark.createDataFrame(list(CATALOG.items()), "pattern_name string, pattern string")
    assert scan_with_table(cells(spark), table.limit(0), "text").collect() == []
    assert scan_with_table(cells(spark).limit(0), table, "text").collect() == []


def test_other_names_and_repeated_detectors(spark):
    table = spark.createDataFrame([("d", "[0-9]+"), ("d", "[0-9]+"), ("d", "key")], "a string, b string")
    found = scan_with_table(cells(spark), table, "text", name="a", pattern="b").where("id = 3")
    assert [r.matches for r in found.collect()] == [["12", "13", "7"]] * 2


def test_a_detector_keeps_its_rarest_gram(spark):
    detectors = spark.createDataFrame([(1, "commonrare"), (2, "gone-gone"), (3, None), (4, "ab"), (5, "abc")], "det long, literal string")
    grams = spark.createDataFrame([(i, "commo") for i in range(5)] + [(i, "nrare") for i in range(2)] + [(1, "ommon"), (1, "abc")] + [(i, "monra") for i in range(4)], "id long, gram string")
    got = {(r.det, r.gram) for r in indexed(detectors, grams).collect()}
    # Grams that no text holds rule a detector out.
    assert got == {(3, ""), (4, ""), (5, "abc")}


@pytest.mark.parametrize("redacted", [False, True])
def test_table_function(spark, redacted):
    register_scan(spark, "find_all", CATALOG, redacted=redacted)
    cells(spark).createOrReplaceTempView("find_cells")
    found = spark.sql("SELECT c.id, f.* FROM find_cells AS c, LATERAL find_all(c.text) AS f")
    assert as_rows(found) == as_rows(scan(cells(spark).select("id", "text"), "text", CATALOG, redacted=redacted))
    assert "Python" not in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_totals_tell_nulls_from_sums(spark):
    rows = [("s3", "a", "Low", 1), ("s3", "a", None, 2), ("s3", None, "Low", 3), ("fs", "a", "Low", 4)]
    found = spark.createDataFrame(rows, "data_source string, pattern_name string, severity string, total_exposed int")
    got = {(r.level, r.data_source, r.pattern_name, r.severity): (r.findings, r.total_exposed) for r in severity_totals(found).collect()}
    assert got[7, None, None, None] == (4, 10) and got[3, "s3", None, None] == (3, 6) and got[5, None, "a", None] == (3, 7)
    assert got[1, "s3", "a", None] == (2, 3) and got[0, "s3", "a", None] == (1, 2) and got[5, None, None, None] == (1, 3)
    assert severity_totals(found.where(F.lit(False))).where("level < 7").count() == 0
