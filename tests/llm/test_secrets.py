"""Trigram queries against matches, spans against plain Python."""

import hashlib
import re

import pytest

from cellsift.llm import secrets as s
from cellsift.llm.queries import op10_trigram_secrets
from cellsift.llm.trigrams import query

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    """The three base kinds word for word."""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def all_spans(text):
    out = base_spans(text)
    for i, r in list(enumerate(s.RULES))[len(s.BASE) :]:
        out += [(m.start(), i, m.end(), r.kind) for m in re.finditer(r.pattern, text)]
    return sorted(out)


def key(*parts):
    return "".join(parts)  # so that no token stands in this file as a whole


TEXTS = [
    None,
    "",
    "nothing here",
    "Password: hunter22 and PASSWD='abcdef' secret = x token=short1",
    "api_key: token: abcdef1234 apikey=\"zzzzzz\" API_KEY = 'q.w-e+r/t=y'",
    "token=secret=abcdefgh",
    "tok oke ken password pass word",
    "é😀 token: ábc token: abcdef😀",
    key("AKIA", "ABCDEFGHIJKLMNOP") + " " + key("AKIA", "AKIA", "BCDEFGHIJKLMNOP") + " AKIAshort",
    "deadbeefdeadbeefdeadbeef 0123456789abcdef0123456789ABCDEF " + "f" * 23,
    key("ghp", "_") + "a1" * 18 + " " + key("xox", "b-") + "1234567890-ab " + key("AI", "za") + "B" * 35,
    key("sk_", "live_") + "9" * 20 + " -----BEGIN " + "RSA PRIVATE KEY----- -----BEGIN " + "PRIVATE KEY-----",
    key("ey", "J") + "a" * 12 + "." + key("ey", "J") + "b" * 12 + "." + "c" * 12,
    "token=" + "a" * 30 + "\n" + "token: abcdef " * 300,
    "x" * 30_000 + " password=verylong " + "y" * 30_000,
]


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abcd", ("and", ("abc", "bcd"))),
        ("abc|xyz", ("or", ("abc", "xyz"))),
        ("[0-9a-f]{24,}", True),
        ("a?bcd", "bcd"),
        ("ab.cd", True),
        ("(ab)+c", "abc"),
        ("x{3}", "xxx"),
        ("abc*", True),
        ("abc|ab", True),
        ("AKIA[A-Z0-9]{16,}", ("and", ("AKI", "KIA"))),
    ],
)
def test_query(pattern, want):
    assert query(pattern) == want


def holds(q, text):
    if isinstance(q, bool):
        return q
    if isinstance(q, str):
        return q in text
    return (all if q[0] == "and" else any)(holds(x, text) for x in q[1])


def test_every_match_meets_its_query():
    for rule in s.RULES:
        q = query(rule.pattern, rule.ignore_case)
        for text in TEXTS:
            for m in re.finditer(rule.java, text or ""):
                assert holds(q, m[0].lower() if rule.ignore_case else m[0])
    for pattern in ("a(b|cd)?e+f", "(x|yz){2,3}w", "a[bc]d[^e]fgh", r"q\.r\x41b", "(?:ab|abc)(d|e)f*ghi"):
        for text in ("aef", "abef", "acdeeef", "yzyzw", "xyzxw", "abdxfgh", "q.rAb", "abdghi", "abceffghi"):
            if re.search(pattern, text):
                assert holds(query(pattern), text)


def test_unread_patterns_raise():
    for pattern in ("(?=a)b", "(a", r"\p{L}"):
        with pytest.raises(ValueError):
            query(pattern)


def test_spans(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x"), (3, TEXTS[4], "x"), (3, TEXTS[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    found = s.find(docs, keep=("text",)).withColumn("clean", s.redact(s.F.coalesce("text", s.F.lit("")), s.F.col("spans"))).collect()
    assert len(found) == len(rows)
    for r in found:
        text = r.text or ""
        want = all_spans(text)
        assert [tuple(x) for x in r.spans] == want
        clean, at = [], 0
        for a, _, b, kind in want:
            if a >= at:
                clean += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        assert r.clean == "".join(clean) + text[at:]


def test_empty_table_and_rules_without_trigrams(spark):
    assert s.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "f" * 30)], "doc_id long, text string")
    assert [tuple(x) for x in s.find(docs, [s.BASE[2]]).first().spans] == [(0, 0, 30, "hex")]


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_trigram_secrets(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = base_spans(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == i for x in base) for i in range(3))
        spell = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(spell(base).encode()).hexdigest()
        assert r.spans == spell(all_spans(docs[r.doc_id]))
