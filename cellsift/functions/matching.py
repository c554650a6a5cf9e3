"""Column functions that run a detector catalogue over one text column."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from cellsift.catalog import Catalog, Detector, as_catalog, group_count

#: Case is always ignored and ``.`` stops at ``\n`` only. Unicode mode adds Unicode case, digits and blanks.
UNICODE_FLAGS = "(?iudU)"
ASCII_FLAGS = "(?id)"

#: Characters that equal ASCII letters when case is ignored but are not lower-cased to them.
ODD_LETTERS = ("ſ", "ı", "İ")


def flagged(pattern: str, unicode: bool = True) -> str:
    return (UNICODE_FLAGS if unicode else ASCII_FLAGS) + pattern


def all_matches(text: Column, detector: Detector, group_mode: str = "whole", unicode: bool = True) -> Column:
    """Every non-overlapping match of one detector.

    ``group_mode="first"`` returns the first capture group of a detector that has exactly one, else the whole match.
    """
    if group_mode not in ("whole", "first"):
        raise ValueError(f"group_mode is 'whole' or 'first', not {group_mode!r}")
    group = 1 if group_mode == "first" and group_count(detector.pattern) == 1 else 0
    return F.regexp_extract_all(text, F.lit(flagged(detector.pattern, unicode)), F.lit(group))


def hits(
    text: Column,
    detectors: Iterable[Detector],
    group_mode: str = "whole",
    unicode: bool = True,
    gate: Callable[[Detector], Column | None] = lambda d: None,
) -> Column:
    """``array<struct<pattern_names, matches>>`` with one element per distinct pattern that matched.

    Detectors that share a pattern share one regex evaluation; ``gate`` gives a condition without which a detector
    need not run.
    """
    by_pattern: dict[str, list[Detector]] = {}
    for d in detectors:
        by_pattern.setdefault(d.pattern, []).append(d)
    none = F.array().cast("array<string>")
    found = []
    for same in by_pattern.values():
        matches = all_matches(text, same[0], group_mode, unicode)
        condition = gate(same[0])
        if condition is not None:
            matches = F.when(condition, matches).otherwise(none)
        names = F.array(*[F.lit(d.name) for d in same])
        found.append(F.struct(names.alias("pattern_names"), matches.alias("matches")))
    return F.filter(F.array(*found), lambda h: F.size(h["matches"]) > 0)


def gates_of(text: Column, unicode: bool = True) -> Callable[[Detector], Column | None]:
    """Conditions without which a detector cannot match, for use inside one expression."""
    folded = F.lower(text)
    odd = reduce(Column.__or__, [text.contains(letter) for letter in ODD_LETTERS])

    def holds(literal: str) -> Column:
        found = folded.contains(literal)  # first, so that the folded text is computed once for all detectors
        return found | odd if unicode and literal.lower() != literal.upper() else found

    def gate(d: Detector) -> Column | None:
        parts = [reduce(Column.__or__, [holds(literal) for literal in d.literals])] if d.literals else []
        parts += [text.rlike(flagged(p, unicode)) for p in d.prechecks]
        return reduce(Column.__and__, parts) if parts else None

    return gate


def scan_text(
    text: Column | str, catalog: Catalog = None, redacted: bool = False, group_mode: str = "whole", unicode: bool = True
) -> Column:
    """All findings of one text as ``array<struct<pattern_name, matches, sample_text>>``, for use in any select."""
    from cellsift.functions.text import sample_text, tidy_matches

    c = F.col(text) if isinstance(text, str) else text
    sample = sample_text(c, redacted)
    return F.flatten(
        F.transform(
            hits(c, as_catalog(catalog), group_mode, unicode, gates_of(c, unicode)),
            lambda h: F.transform(
                h["pattern_names"],
                lambda name: F.struct(
                    name.alias("pattern_name"),
                    tidy_matches(h["matches"], redacted).alias("matches"),
                    sample.alias("sample_text"),
                ),
            ),
        )
    )
