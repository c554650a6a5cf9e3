"""Boolean trigram queries from regular expressions: a condition on trigrams that every text with a match meets.

A query is True, a trigram, or ``("and" | "or", queries)``. Of each part of a pattern it is known which strings it matches, where
these are few, or else how its matches may begin and end and which trigrams they hold. Read are literals, escapes,
classes, groups, ``|``, ``* + ? {m,n}`` with lazy forms, ``.`` and the anchors ``^ $ \\b``; anything else raises.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

#: More strings than this are not told apart; the query only gets weaker.
MOST_STRINGS = 24
#: Larger character classes count as any character.
MOST_LETTERS = 12

Query = bool | str | tuple


@dataclass(frozen=True)
class Part:
    """``exact`` strings if they are few, else None with the possible ``heads`` and ``tails`` and what all matches hold."""

    exact: frozenset[str] | None
    heads: frozenset[str] = frozenset([""])
    tails: frozenset[str] = frozenset([""])
    needs: Query = True


def both(op: str, queries: list[Query]) -> Query:
    """Simplified conjunction or disjunction."""
    flat: dict[Query, None] = {}
    for q in queries:
        if q is (op == "or"):
            return q
        if q is (op == "and"):
            continue
        for x in q[1] if isinstance(q, tuple) and q[0] == op else (q,):
            flat[x] = None
    if not flat:
        return op == "and"
    if op == "or":  # a condition that holds wherever another one does adds nothing
        parts = {x: frozenset(x[1]) if isinstance(x, tuple) and x[0] == "and" else frozenset([x]) for x in flat}
        flat = {x: None for x in flat if not any(parts[y] < parts[x] for y in flat)}
    return next(iter(flat)) if len(flat) == 1 else (op, tuple(flat))


def _held(strings: frozenset[str]) -> Query:
    """What a text holds that holds one of the strings."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _loose(p: Part) -> Part:
    if p.exact is None:
        return p
    return Part(None, _cut(p.exact, False), _cut(p.exact, True), _held(p.exact))


def _cut(strings: frozenset[str], tail: bool) -> frozenset[str]:
    """Heads or tails of two characters: what a neighbour needs for trigrams across the seam."""
    short = frozenset(s[-2:] if tail else s[:2] for s in strings)
    return short if len(short) <= MOST_STRINGS else frozenset([""])


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    a_exact, b_exact = a.exact, b.exact
    a, b = _loose(a), _loose(b)
    seam = frozenset(x + y for x, y in product(a.tails, b.heads))
    heads, tails = a.heads, b.tails
    if a_exact is not None:
        heads = _cut(frozenset(x + y for x, y in product(a_exact, b.heads)), False) if len(a_exact) <= MOST_STRINGS else heads
    if b_exact is not None:
        tails = _cut(frozenset(x + y for x, y in product(a.tails, b_exact)), True)
    return Part(None, heads, tails, both("and", [a.needs, b.needs, _held(seam)]))


def _either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return Part(a.exact | b.exact)
    a, b = _loose(a), _loose(b)
    return Part(None, _cut(a.heads | b.heads, False), _cut(a.tails | b.tails, True), both("or", [a.needs, b.needs]))


_ANY = Part(None)
_EMPTY = Part(frozenset([""]))
# Escapes that stand for one character.
_SINGLE = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


class _Reader:
    def __init__(self, pattern: str, fold: bool):
        self.pattern, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def alternatives(self) -> Part:
        out = self.sequence()
        while self.take("|"):
            out = _either(out, self.sequence())
        return out

    def sequence(self) -> Part:
        out = _EMPTY
        while self.peek() and self.peek() not in "|)":
            out = _then(out, self.repeated())
        return out

    def repeated(self) -> Part:
        one = self.atom()
        while True:
            if self.take("*"):
                one = _ANY
            elif self.take("+"):
                one = self.times(one, 1, None)
            elif self.take("?"):
                one = _either(one, _EMPTY)
            elif self.peek() == "{":
                end = self.pattern.index("}", self.at)
                least, comma, most = self.pattern[self.at + 1 : end].partition(",")
                self.at = end + 1
                one = self.times(one, int(least or 0), int(most) if most else None if comma else int(least))
            else:
                return one

    def times(self, one: Part, least: int, most: int | None) -> Part:
        if least == 0:
            return _ANY
        out = one
        for _ in range(min(least, 4) - 1):
            out = _then(out, one)
        if least > 4 or most != least:  # more may follow
            out = _then(_then(out, _ANY), one) if least > 1 or one.exact is None else _more(one)
        return out

    def atom(self) -> Part:
        c = self.peek()
        self.at += 1
        if c == "(":
            if self.take("?"):
                if not self.take(":"):
                    raise ValueError(f"group is not read: {self.pattern}")
            inner = self.alternatives()
            if not self.take(")"):
                raise ValueError(f"group is not closed: {self.pattern}")
            return inner
        if c == "[":
            return self.letters()
        if c == ".":
            return _ANY
        if c in "^$":
            return _EMPTY
        if c == "\\":
            return self.escape()
        return self.single({c})

    def escape(self) -> Part:
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return self.single({chr(int(self.pattern[self.at - 2 : self.at], 16))})
        if c in "bB":
            return _EMPTY
        if c in "dDwWsS":
            return _ANY
        if c.isalnum() and c not in _SINGLE:
            raise ValueError(f"escape is not read: {self.pattern}")
        return self.single({_SINGLE.get(c, c)})

    def letters(self) -> Part:
        negated, found, first = self.take("^"), set(), True
        wide = negated
        while first or self.peek() != "]":
            first = False
            c = self.peek()
            self.at += 1
            if c == "\\":
                part = self.escape()
                wide |= part.exact is None
                c = next(iter(part.exact)) if part.exact else ""
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                end = self.pattern[self.at + 1]
                if end == "\\":
                    raise ValueError(f"range is not read: {self.pattern}")
                self.at += 2
                found.update(map(chr, range(ord(c), ord(end) + 1)))
            elif c:
                found.add(c)
        self.at += 1
        return _ANY if wide or len(found) > MOST_LETTERS else self.single(found)

    def single(self, chars: set[str]) -> Part:
        return Part(frozenset(c.lower() if self.fold else c for c in chars))


def _more(one: Part) -> Part:
    """One or more of a part with few strings."""
    loose = _loose(one)
    whole = all(len(s) >= 2 for s in one.exact)
    return Part(None, loose.heads if whole else _short(one), loose.tails if whole else _short(one), loose.needs)


def _short(one: Part) -> frozenset[str]:
    return frozenset([""]) if any(not s for s in one.exact) else frozenset(s[:1] for s in one.exact)


def query(pattern: str, ignore_case: bool = False) -> Query:
    """The trigram query of a pattern; with ``ignore_case`` its trigrams are lower-case, to be sought in lower-cased text."""
    reader = _Reader(pattern, ignore_case)
    part = reader.alternatives()
    if reader.at < len(pattern):
        raise ValueError(f"pattern is not read: {pattern}")
    return _loose(part).needs


def trigrams(q: Query) -> list[str]:
    if isinstance(q, bool):
        return []
    return [q] if isinstance(q, str) else list(dict.fromkeys(t for x in q[1] for t in trigrams(x)))
