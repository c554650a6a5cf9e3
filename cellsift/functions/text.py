"""Column functions on text: printing, truth, decoding, redaction, tidying of match lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

SAMPLE_CHARS = 50

# The blanks a trim removes (Unicode white space and the four ASCII separators).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def redact(c: Column) -> Column:
    """Star out the middle half of a string; strings under three characters stay as they are."""
    n = F.length(c)
    quarter = F.floor(n / 4).cast("int")
    start = F.floor(n / 2).cast("int") - quarter
    starred = F.concat(F.left(c, start), F.repeat(F.lit("*"), 2 * quarter), F.substr(c, start + 2 * quarter + 1))
    return F.when(n < 4, c).otherwise(starred)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def tidy_matches(matches: Column, redacted: bool = False) -> Column:
    """Redact, then trim, then keep distinct values in sorted order. The order of the steps decides the count.

    Equal matches stay equal under both steps, so repeats are dropped once before them too.
    """
    matches = F.array_distinct(matches)
    if redacted:
        matches = F.transform(matches, redact)
    return F.sort_array(F.array_distinct(F.transform(matches, strip_blanks)))


def sample_text(c: Column, redacted: bool = False) -> Column:
    head = F.substring(c, 1, SAMPLE_CHARS)
    return redact(head) if redacted else head


def decode_utf8(c: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(c.cast("string"))


def truthy(c: Column, dtype: T.DataType) -> Column:
    """False for null, empty text and containers, zero and false; such cells are never scanned."""
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(dtype, T.BinaryType):
        return c.isNotNull() & (F.octet_length(c) > 0)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def printed(c: Column, dtype: T.DataType) -> Column:
    """Any value as text. Nested values print as JSON; floats, booleans and timestamps the way Python prints them."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BinaryType):
        return decode_utf8(c)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _printed_float(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        s = c.cast("string")
        return F.when(F.contains(s, F.lit(".")), F.rpad(s, 26, "0")).otherwise(s)
    if isinstance(dtype, _NESTED):
        return F.to_json(c)
    return c.cast("string")


def _printed_float(c: Column) -> Column:
    """Shortest form, positional from 1e-4 up to 1e16 and scientific with a two-digit exponent outside."""
    s = c.cast("string")
    size = F.abs(c)
    plain = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    exponent = F.substring_index(s, "E", -1)
    digits = F.regexp_replace(exponent, "^-", "")
    scientific = F.concat(
        mantissa,
        F.when(exponent.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e-3) & (size < 1e7), s)
        .when((size >= 1e-4) & (size < 1e16), F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))
        .otherwise(scientific)
    )
