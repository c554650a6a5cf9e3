"""Secrets in whole texts by an inverted index of trigrams.

From each rule's pattern follows a Boolean query of trigrams that every match holds. Documents are posted under the
trigrams that the queries name; the postings of a document meet as bits, and the queries are evaluated on them. Only
rules whose query holds are verified on a document, by their pattern. Rules without mandatory trigrams are tried on
all documents.

A span is ``kind:start:end`` in code points, the end exclusive; spans of one kind never overlap, those of two kinds
may. Matches that fail a rule's least length are dropped, but what they cover is passed over. Nulls count as empty
texts and have no spans. Ids are meant to be unique: rows of one id share the postings, and each is verified on its
own text. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cellsift.llm.trigrams import Query, query, trigrams


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; group ``group`` must have ``least`` characters or more."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


# Shapes of the three base kinds and of published token formats. A run of hex digits or of an access key's
# characters is matched whole, so its least length is part of the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)
_BITS = 62


class Index:
    """The trigrams that the rules' queries name, each a bit of a row of numbers."""

    def __init__(self, rules: Sequence[Rule]):
        self.queries = [query(r.pattern, r.ignore_case) for r in rules]
        named = dict.fromkeys(
            (t, rule.ignore_case) for rule, q in zip(rules, self.queries, strict=True) for t in trigrams(q)
        )
        self.places = {key: i for i, key in enumerate(named)}
        self.words = -(-len(self.places) // _BITS)

    def postings(self, docs: DataFrame) -> DataFrame:
        """``(id, gram)``: a row for each document and trigram it holds; ``docs`` has ``id`` and ``text``."""
        folded = F.lower("text")
        held = [F.when((folded if fold else F.col("text")).contains(t), F.lit(i)) for (t, fold), i in self.places.items()]
        return docs.select("id", F.explode(F.array_compact(F.array(*held))).alias("gram"))

    def candidates(self, docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """``(id, rules)`` for documents that a query admits; bit i of ``rules`` stands for rule i."""
        bit = F.expr(f"shiftleft(1L, gram % {_BITS})")
        posted = self.postings(docs).select("id", (F.col("gram") / _BITS).cast("int").alias("word"), bit.alias("bit"))
        words = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(0)).alias(f"w{w}") for w in range(self.words)]
        met = posted.groupBy("id").agg(*words)
        admitted = [
            F.when(self._holds(q, r.ignore_case), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            for i, (q, r) in enumerate(zip(self.queries, rules, strict=True))
            if q is not True
        ]
        return met.select("id", reduce(Column.bitwiseOR, admitted).alias("rules")).where("rules <> 0")

    def _holds(self, q: Query, fold: bool) -> Column:
        if isinstance(q, str):
            place = self.places[q, fold]
            return F.col(f"w{place // _BITS}").bitwiseAND(F.lit(1 << place % _BITS).cast("long")) != 0
        op = Column.__and__ if q[0] == "and" else Column.__or__
        return reduce(op, [self._holds(x, fold) for x in q[1]])


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule: lengths of the text between matches and of the matches, added up."""
    java = F.lit(rule.java)
    between, whole = F.split(text, rule.java, -1), F.regexp_extract_all(text, java, 0)
    tested = F.regexp_extract_all(text, java, rule.group) if rule.group else whole
    lengths = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))),
        tested,
        lambda s, t: F.struct(s["b"].alias("b"), s["m"].alias("m"), (F.length(t) >= rule.least).alias("good")),
    )
    kind = "struct<start:int,number:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(done: Column, s: Column) -> Column:
        a = done["at"] + s["b"]
        span = F.struct(a.alias("start"), F.lit(number).alias("number"), (a + s["m"]).alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(s["good"], F.concat(done["found"], F.array(span))).otherwise(done["found"])
        return F.struct((a + s["m"]).alias("at"), found.cast(f"array<{kind}>").alias("found"))

    return F.aggregate(lengths, start, step, lambda done: done["found"])


def find(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text",
         keep: Sequence[str] = (), out_column: str = "spans") -> DataFrame:
    """``id_column``, the columns ``keep`` and ``out_column``: an array of ``start, number, end, kind`` by start, then rule."""
    if len(rules) > _BITS:
        raise ValueError(f"at most {_BITS} rules at once")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    index = Index(rules)
    kept = [c for c in keep if c != id_column]
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), text.alias("_text"), *[F.col(f"`{c}`") for c in kept])
    if index.places:
        posted = index.candidates(docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text")), rules)
        posted = posted.select(F.col("id").alias("_posted"), F.col("rules").alias("_rules"))
        rows = rows.join(posted, F.col("_id").eqNullSafe(F.col("_posted")), "left")
    else:
        rows = rows.withColumn("_rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    found = []
    for i, (rule, q) in enumerate(zip(rules, index.queries, strict=True)):
        tried = F.lit(True) if q is True else F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << i).cast("long")) != 0
        found.append(F.when(tried & F.col("_text").rlike(rule.java), _spans(F.col("_text"), rule, i)).otherwise(none))
    return rows.select(
        F.col("_id").alias(id_column), *[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat(*found)).alias(out_column)
    )


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        mark = F.concat(F.lit("["), s["kind"], F.lit("]"))
        parts = F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(gap, mark))).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), parts.alias("parts"))

    def end(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)
