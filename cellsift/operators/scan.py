"""The detector scan over a DataFrame of cells, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellsift.catalog import Catalog, Detector, as_catalog
from cellsift.functions.matching import ODD_LETTERS, flagged, hits, scan_text
from cellsift.functions.text import redact, sample_text, tidy_matches
from cellsift.session import written

#: Columns of our own beside a user's; no user column begins like this.
_OWN = "__cellsift_"
_FOLDED = _OWN + "folded"
_ODD = _OWN + "odd"
_ADDED = ("pattern_name", "matches", "total_exposed", "sample_text")

#: Above this many rows per scope Spark no longer limits a ranked window before its shuffle.
_GROUP_LIMIT = 1000
_SALTS = 256


class _Gates:
    """Cheap conditions computed once per cell, so that a detector's regex runs only where it can match.

    Prechecks and the lower-cased text come first; the gates built on them stop at the first that fails.
    """

    def __init__(self, text: str, detectors: Sequence[Detector], unicode: bool):
        self.text, self.unicode = F.col(f"`{text}`"), unicode
        self._folded, self._odd = F.col(_FOLDED), F.col(_ODD)
        self.first: dict[str, Column] = {}
        self.second: dict[str, Column] = {}
        self._prechecks: dict[str, Column] = {}
        self._gates: dict[tuple, Column] = {}
        for d in detectors:
            key = (d.prechecks, d.literals)
            if (d.prechecks or d.literals) and key not in self._gates:
                name = f"{_OWN}gate{len(self._gates)}"
                self.second[name] = self._condition(d)
                self._gates[key] = F.col(name)

    def __call__(self, d: Detector) -> Column | None:
        return self._gates.get((d.prechecks, d.literals))

    def _condition(self, d: Detector) -> Column:
        parts = [self._precheck(p) for p in d.prechecks]
        if d.literals:
            parts.append(reduce(Column.__or__, [self._holds(literal) for literal in d.literals]))
        return reduce(Column.__and__, parts)

    def _precheck(self, pattern: str) -> Column:
        if pattern not in self._prechecks:
            name = f"{_OWN}precheck{len(self._prechecks)}"
            self.first[name] = self.text.rlike(flagged(pattern, self.unicode))
            self._prechecks[pattern] = F.col(name)
        return self._prechecks[pattern]

    def _holds(self, literal: str) -> Column:
        if literal.lower() == literal.upper():
            return self.text.contains(literal)
        if _FOLDED not in self.first:
            self.first[_FOLDED] = F.lower(self.text)
            if self.unicode:
                self.first[_ODD] = reduce(Column.__or__, [self.text.contains(letter) for letter in ODD_LETTERS])
        found = self._folded.contains(literal)
        return self._odd | found if self.unicode else found


def scan(
    cells: DataFrame,
    text: str = "value",
    catalog: Catalog = None,
    *,
    redacted: bool = False,
    group_mode: str = "whole",
    unicode: bool = True,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per cell and detector that matched.

    All columns but ``text`` (or just ``keep``) are carried along; ``pattern_name``, ``matches``, ``total_exposed``
    and ``sample_text`` are added, and replace columns of these names. The plan is a map over the input: no shuffle, no join,
    no Python.
    """
    detectors = as_catalog(catalog)
    if not detectors:
        raise ValueError("an empty catalogue finds nothing")
    carried = [c for c in (keep if keep is not None else cells.columns) if c != text or keep is not None]
    carried = [c for c in carried if c not in _ADDED]
    # What is carried goes under numbers, so that its names meet none of ours.
    carried_cols = [F.col(f"{_OWN}{i}") for i in range(len(carried))]
    given = [F.col(f"`{c}`").alias(f"{_OWN}{i}") for i, c in enumerate(carried)]
    named = [F.col(f"{_OWN}{i}").alias(c) for i, c in enumerate(carried)]
    value = _OWN + "value"

    gates = _Gates(value, detectors, unicode)
    found = hits(F.col(value), detectors, group_mode, unicode, gates)
    content = F.col(f"`{text}`").cast("string")
    cells = cells.where(content.isNotNull() & (content != "")).select(*given, content.alias(value))
    if gates.first:
        cells = cells.withColumns(gates.first)
    cells = cells.select(
        *carried_cols,
        value,
        sample_text(F.col(value), redacted).alias("sample_text"),
        *[c.alias(n) for n, c in gates.second.items()],
    )
    return (
        cells.select(*carried_cols, "sample_text", F.inline(found))
        .select(*carried_cols, F.explode("pattern_names").alias("pattern_name"), "matches", "sample_text")
        .select(*carried_cols, "pattern_name", tidy_matches(F.col("matches"), redacted).alias("matches"), "sample_text")
        .select(*named, "pattern_name", "matches", F.size("matches").alias("total_exposed"), "sample_text")
    )


def scan_pattern(
    cells: DataFrame, name: str, text: str = "value", catalog: Catalog = None, **options: object
) -> DataFrame:
    """Scan with the one named detector of a catalogue."""
    chosen = [d for d in as_catalog(catalog) if d.name == name]
    if not chosen:
        raise KeyError(name)
    return scan(cells, text, chosen, **options)


def redact_document(
    cells: DataFrame, text: str = "value", catalog: Catalog = None, unicode: bool = True, out: str = "redacted"
) -> DataFrame:
    """Adds the text with every match starred out, wherever its characters occur.

    The distinct matches of all detectors are replaced one after the other, longest first, so that a match inside another
    does not spoil it. A text without matches stays as it is; null stays null.
    """
    c = F.col(f"`{text}`").cast("string")
    found = F.flatten(F.transform(scan_text(c, catalog, unicode=unicode), lambda h: h["matches"]))
    keys = F.transform(F.array_distinct(found), lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))
    ordered = F.array_sort(F.filter(keys, lambda k: F.length(k["m"]) > 0))
    starred = F.aggregate(ordered, c, lambda done, k: F.replace(done, k["m"], redact(k["m"])))
    return cells.withColumn(out, F.when(c.isNotNull(), F.coalesce(starred, c)))


def any_hit(cells: DataFrame, text: str = "value", catalog: Catalog = None, unicode: bool = True) -> DataFrame:
    """The cells in which at least one detector matches, as they are."""
    detectors = as_catalog(catalog)
    gates = _Gates(text, detectors, unicode)
    condition = F.lit(False)
    for d in detectors:
        found, gate = F.col(f"`{text}`").rlike(flagged(d.pattern, unicode)), gates(d)
        condition = condition | (found if gate is None else gate & found)
    out = cells.where(F.col(f"`{text}`") != "")
    for stage in (gates.first, gates.second):
        out = out.withColumns(stage) if stage else out
    return out.where(condition).select(*[F.col(f"`{c}`") for c in cells.columns])


def quick_exit(
    findings: DataFrame,
    max_matches: int = 1,
    scope: tuple[str, ...] = (),
    unit: tuple[str, ...] = (),
    newest_first: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Stop a scope once ``max_matches`` findings are in; the unit that crosses the line keeps all its findings.

    ``scope`` is what is stopped (a bucket, a channel), ``unit`` what is read in one go (an object, a message), read
    in the order of the unit columns. Every unit here holds a finding, so at most ``max_matches`` units per scope can
    be kept. Only that many rows of a scope ever meet in one task: tasks rank and cut their own units first.
    Findings are read twice, so they are stored first unless ``stored`` says they already are.
    """
    if max_matches < 1:
        return findings.limit(0)
    if not stored:
        findings = written(findings, "findings")
    one_scope = not scope
    scopes = scope or (_OWN + "scope",)
    if one_scope:
        findings = findings.withColumn(_OWN + "scope", F.lit(0))
    order = [F.col(c).desc() if newest_first else F.col(c).asc() for c in unit]

    units = findings.groupBy(*scopes, *unit).agg(F.count("*").alias(_OWN + "n"))
    if max_matches > _GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*unit), F.lit(_SALTS))
        salted = W.partitionBy(*scopes, _OWN + "salt").orderBy(*order)
        units = units.withColumn(_OWN + "salt", salt).withColumn(_OWN + "rank", F.row_number().over(salted))
        units = units.where(F.col(_OWN + "rank") <= max_matches).drop(_OWN + "salt", _OWN + "rank")
    ranked = W.partitionBy(*scopes).orderBy(*order)
    kept = (
        units.withColumn(_OWN + "rank", F.row_number().over(ranked))
        .where(F.col(_OWN + "rank") <= max_matches)
        .withColumn(_OWN + "before", F.sum(_OWN + "n").over(ranked.rowsBetween(W.unboundedPreceding, -1)))
        .where(F.coalesce(_OWN + "before", F.lit(0)) < max_matches)
        .select(*scopes, *unit)
    )
    same = None
    kept_side, found_side = kept.alias("kept"), findings.alias("found")
    for c in (*scopes, *unit):
        equal = F.col(f"found.`{c}`").eqNullSafe(F.col(f"kept.`{c}`"))
        same = equal if same is None else same & equal
    out = found_side.join(kept_side, same, "left_semi")
    return out.drop(_OWN + "scope") if one_scope else out
