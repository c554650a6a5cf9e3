import datetime as dt
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from cellsift.functions.sql import register
from cellsift.functions.text import BLANKS, decode_utf8, printed, redact, sample_text, strip_blanks, tidy_matches, truthy


def starred(s: str) -> str:
    """What redaction means: keep both ends, star out the middle half."""
    quarter = len(s) // 4
    if len(s) < 3:
        return s
    left = len(s) // 2 - quarter
    return s[:left] + "*" * (2 * quarter) + s[left + 2 * quarter :]


def column(spark, values, expression):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "i int, s string")
    return [r[1] for r in df.select("i", expression(F.col("s"))).orderBy("i").collect()]


def test_redact_lengths(spark):
    texts = ["é😀a b"[: n % 6] + "x" * n for n in range(61)] + [" ab ", "  ", "ünïcödé text"]
    assert column(spark, texts, redact) == [starred(t) for t in texts]
    register(spark)
    spark.createDataFrame(list(enumerate(texts)), "i int, s string").createOrReplaceTempView("redact_texts")
    in_sql = spark.sql("SELECT redact(s) FROM redact_texts ORDER BY i").collect()
    assert [r[0] for r in in_sql] == [starred(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=60), min_size=20, max_size=60))
def test_redact_and_strip_properties(spark, texts):
    out = column(spark, texts, redact)
    assert [len(o) for o in out] == [len(t) for t in texts]
    assert out == [starred(t) for t in texts]
    assert column(spark, texts, strip_blanks) == [t.strip() for t in texts]


def test_blanks_are_pythons():
    assert set(BLANKS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_redaction_comes_before_distinct(spark):
    df = spark.createDataFrame([(["abcdefgh", "abXXXXgh", " abcdefgh ", "abcdefgh"],)], "m array<string>")
    plain, redacted = df.select(tidy_matches(F.col("m")), tidy_matches(F.col("m"), True)).first()
    assert plain == ["abXXXXgh", "abcdefgh"]
    # blanks count when the middle is found, so the padded value keeps other letters
    assert redacted == sorted({starred(s).strip() for s in ["abcdefgh", "abXXXXgh", " abcdefgh "]})


def test_sample(spark):
    texts = ["x" * 49, "é" * 51, "😀" * 60, ""]
    assert column(spark, texts, sample_text) == [t[:50] for t in texts]
    assert column(spark, texts, lambda c: sample_text(c, True)) == [starred(t[:50]) for t in texts]


def test_decode(spark):
    raw = [b"plain", "ünï".encode(), b"\xff\xfeab", b"a\xc3", b"\xe2\x82x", b"\xf0\x9f\x98", b""]
    rows = [(i, bytearray(b)) for i, b in enumerate(raw)]
    got = spark.createDataFrame(rows, "i int, b binary").select("i", decode_utf8(F.col("b"))).orderBy("i").collect()
    assert [r[1] for r in got] == [b.decode("utf-8", errors="replace") for b in raw]


def test_printed_like_python(spark):
    floats = [0.5, 1.0, 12345678.0, 1e7, 1e15, 1e16, 1.5e300, 1e-3, 1e-4, 1.25e-5, 123456.789, -2.5e-7, 9.99e15, 0.1 + 0.2]
    floats += [float("inf"), float("-inf"), float("nan"), -12345678.25, 2.5e-4]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(floats)], "i int, f double")
    got = [r[0] for r in df.orderBy("i").select(printed(F.col("f"), T.DoubleType())).collect()]
    assert got == [str(f) for f in floats]

    stamps = [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 120000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, t timestamp_ntz")
    got = [r[0] for r in df.orderBy("i").select(printed(F.col("t"), T.TimestampNTZType())).collect()]
    assert got == [str(s) for s in stamps]


SCALARS = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("dec", T.DecimalType(10, 2)),
        T.StructField("b", T.BooleanType()),
        T.StructField("dt", T.DateType()),
        T.StructField("bin", T.BinaryType()),
        T.StructField("a", T.ArrayType(T.LongType())),
        T.StructField("m", T.MapType(T.StringType(), T.LongType())),
    ]
)


def test_truth_and_print_by_type(spark):
    full = ("0", 5, 1.5, Decimal("1.50"), True, dt.date(2024, 5, 6), bytearray(b"x\xff"), [1, 2], {"k": 1})
    empty = ("", 0, 0.0, Decimal("0.00"), False, None, bytearray(b""), [], {})
    df = spark.createDataFrame([full, empty, (None,) * 9], SCALARS)
    truth = df.select(*[truthy(F.col(f.name), f.dataType).alias(f.name) for f in SCALARS]).collect()
    assert all(truth[0]) and not any(truth[1]) and not any(truth[2])
    shown = df.select(*[printed(F.col(f.name), f.dataType).alias(f.name) for f in SCALARS]).first()
    assert tuple(shown) == ("0", "5", "1.5", "1.50", "True", "2024-05-06", "x\ufffd", "[1,2]", '{"k":1}')
