"""Ids of whole texts by a vocabulary of words: a tokenizer file whose pieces never cross ASCII white space.

The library's own encoder keeps places, alignments and a string for every token. Only ids are wanted here, and most pieces
come again and again, so texts are cut in bulk and the library sees each distinct piece once:

* Runs of letters, single digits and runs of other signs are found in the bytes of many texts at once, after lower-casing; an
  apostrophe that stands alone takes its ``s t m d re ve ll`` along. This covers ASCII and the letters of U+00C0 to U+00FF, for
  which the file's normal forms change nothing but case.
* A word between ASCII white space that holds anything else, or the spelling of a special token, goes to the library as it is.

Equal slices get one number by a hash and are then compared byte by byte, so no collision can pass. What is known is forgotten when
it grows beyond ``KNOWN`` pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from cellsift.llm.common import SliceHasher, runs, ship, spans_of, text_bytes

ship(__name__)

#: So many bytes of texts are cut at once; a longer text is cut at white space.
SLICE_BYTES = 2 << 20
#: So many pieces are remembered, some 60 bytes each and their text and ids.
KNOWN = 400_000
_JOINED = 512  # new pieces that go to the library in one string

#: Pieces and words hold no ASCII white space.
_WORDS = re.compile(r"[^\t-\r ]+").findall
_OTHER, _LETTER, _DIGIT, _WHITE, _FOREIGN = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.full(256, _OTHER, np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    kinds[[32, *range(9, 14)]] = _WHITE
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = _LETTER
    lower[65:91] += 32
    kinds[128:] = _FOREIGN
    return kinds, lower


class WordEncoder:
    """Encodes slices of texts with a tokenizer file and remembers the pieces it has seen."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = self.library.pre_tokenizer
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # The library's marks for the end of a word tell where the ids of one piece end in a joined string.
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kinds, self.lower = _tables()
        self.hasher = SliceHasher()
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), none, none
        self.bytes, self.byte_starts, self.byte_lengths = np.zeros(0, np.uint8), none, none
        self.marks, self.entry = np.zeros(0, np.uint64), none

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row of a string column; nulls are empty texts."""
        raw, offsets = text_bytes(column)
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
            part = raw[offsets[a] : offsets[b]]
            if b == a + 1 and len(part) > SLICE_BYTES:
                yield np.concatenate([self._slice(p, np.array([0, len(p)]))[0] for p in _at_white_space(part)])
            else:
                ids, counts = self._slice(part, offsets[a : b + 1] - offsets[a])
                yield from np.split(ids, np.cumsum(counts)[:-1])
            a = b

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each has."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw, starts, ends, whole = self._cut(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        try:
            marks, first, number = self._distinct(raw, starts, ends)
            entries = self._entries(raw, marks, starts[first], ends[first], whole[first])[number]
            counts = self.lengths[entries]
            ids = self.ids[spans_of(self.starts[entries], counts)]
        except _Collision:
            ids, counts = self._one_by_one(raw, starts, ends, whole)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, lower-cased where pieces are cut, and starts, ends and whether a piece is a whole word for the library."""
        kinds = self.kinds[raw]
        # Letters of U+00C0 to U+00FF: a lead byte 0xC3 and its follower; the signs of multiplication and division are others.
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        follow = raw[lead + 1]
        kind = np.where((follow == 0x97) | (follow == 0xB7), _OTHER, _LETTER).astype(np.uint8)
        kinds[lead], kinds[lead + 1] = kind, kind
        low = self.lower[raw]
        upper = lead[(follow >= 0x80) & (follow <= 0x9E) & (follow != 0x97)] + 1
        low[upper] += 0x20

        odd = kinds == _FOREIGN
        for special in self.specials:
            odd[_find(raw, special)] = True
        words = None
        if odd.any():
            word_starts, word_ends = runs(kinds != _WHITE, offsets)
            seen = np.concatenate([[0], np.cumsum(odd)])
            foreign = seen[word_ends] > seen[word_starts]
            words = word_starts[foreign], word_ends[foreign]
            inside = spans_of(words[0], words[1] - words[0])
            kinds[inside] = _WHITE
            low[inside] = raw[inside]

        begins = np.ones(len(raw), bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        begins[offsets[1:-1][offsets[1:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        real = kinds[starts] != _WHITE
        starts, ends = self._contractions(low, kinds, offsets, starts[real], ends[real])
        whole = np.zeros(len(starts), bool)
        if words is not None:
            starts, ends = np.concatenate([starts, words[0]]), np.concatenate([ends, words[1]])
            whole = np.concatenate([whole, np.ones(len(words[0]), bool)])
            order = np.argsort(starts, kind="stable")
            starts, ends, whole = starts[order], ends[order], whole[order]
        return low, starts, ends, whole

    @staticmethod
    def _contractions(low, kinds, offsets, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """A lone apostrophe takes the letters of its contraction from the run that follows in the same text."""
        lone = (low[starts] == 39) & (ends - starts == 1)
        lone[:-1] &= (ends[:-1] == starts[1:]) & (kinds[starts[1:]] == _LETTER)
        lone[-1:] = False
        at = np.flatnonzero(lone)
        at = at[~np.isin(starts[at + 1], offsets)]
        if not len(at):
            return starts, ends
        first = low[starts[at + 1]]
        second = np.where(ends[at + 1] - starts[at + 1] > 1, low[np.minimum(starts[at + 1] + 1, len(low) - 1)], 0)
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = np.zeros(len(at), bool)
        for pair in (b"re", b"ve", b"ll"):
            two |= (first == pair[0]) & (second == pair[1])
        taken = np.where(one, 1, np.where(two, 2, 0))
        starts, ends = starts.copy(), ends.copy()
        ends[at] += taken
        starts[at + 1] += taken
        left = starts < ends
        return starts[left], ends[left]

    def _distinct(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes, a place where each stands, and for each slice the number of its hash."""
        self.hasher.over(raw)
        hashes = self.hasher.hashes(starts, ends)
        order = np.argsort(hashes)
        hashes = hashes[order]
        begins = np.ones(len(hashes), bool)
        begins[1:] = hashes[1:] != hashes[:-1]
        marks, first = hashes[begins], order[begins]
        number = np.empty(len(hashes), np.int64)
        number[order] = np.cumsum(begins) - 1
        like = first[number]
        if not _equal(raw, starts, ends - starts, raw, starts[like], (ends - starts)[like]).all():
            raise _Collision
        return marks, first, number

    def _entries(self, raw: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The entry of each distinct piece; new ones are learnt."""
        lengths = ends - starts
        known = self._known(marks)
        seen = known >= 0
        if len(self.lengths) + int((~seen).sum()) > KNOWN and len(self.lengths):
            self._forget()
            known, seen = np.full(len(marks), -1), np.zeros(len(marks), bool)
        old = known[seen]
        if not _equal(raw, starts[seen], lengths[seen], self.bytes, self.byte_starts[old], self.byte_lengths[old]).all():
            raise _Collision
        new = np.flatnonzero(~seen)
        if len(new):
            ids, counts = self._learnt(raw, starts[new], lengths[new], whole[new])
            known[new] = len(self.lengths) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            self.ids = np.concatenate([self.ids, ids])
            self.byte_starts = np.concatenate([self.byte_starts, len(self.bytes) + np.cumsum(lengths[new]) - lengths[new]])
            self.byte_lengths = np.concatenate([self.byte_lengths, lengths[new]])
            self.bytes = np.concatenate([self.bytes, raw[spans_of(starts[new], lengths[new])]])
            at = np.searchsorted(self.marks, marks[new])
            self.marks, self.entry = np.insert(self.marks, at, marks[new]), np.insert(self.entry, at, known[new])
        return known

    def _known(self, marks: np.ndarray) -> np.ndarray:
        if not len(self.marks):
            return np.full(len(marks), -1)
        at = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        return np.where(self.marks[at] == marks, self.entry[at], -1)

    def _learnt(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has, from the library."""
        ids, counts, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        for encode, mine in ((self._joined, np.flatnonzero(~whole)), (self._each, np.flatnonzero(whole))):
            for a in range(0, len(mine), _JOINED):
                part = mine[a : a + _JOINED]
                # The pieces side by side, each with a blank behind it.
                sizes = lengths[part]
                text = np.full(int(sizes.sum()) + len(part), 32, np.uint8)
                text[spans_of(np.cumsum(sizes + 1) - sizes - 1, sizes)] = raw[spans_of(starts[part], sizes)]
                found = encode(text.tobytes().decode(), len(part))
                ids.append(found[0])
                counts.append(found[1])
            places.append(mine)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        first = np.cumsum(counts) - counts
        order = np.argsort(np.concatenate(places), kind="stable")
        return ids[spans_of(first[order], counts[order])], counts[order]

    def _joined(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased pieces stay what they are when white space stands between them."""
        encoding = self.plain.encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(encoding.ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != n or cuts[-1] != len(ids):  # a vocabulary without marks for the end of a word
            return self._each(text, n)
        return ids, np.diff(cuts, prepend=0)

    def _each(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        words = _WORDS(text)
        lists = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.array(list(map(len, lists)), np.int64)
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts

    def _one_by_one(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where two pieces share a hash: the ids of all, told apart by their bytes, and nothing is kept."""
        numbers: dict[tuple[bytes, bool], int] = {}
        pieces = zip(starts.tolist(), ends.tolist(), whole.tolist(), strict=True)
        number = np.array([numbers.setdefault((bytes(raw[s:e]), w), len(numbers)) for s, e, w in pieces])
        parts = [self._learnt(raw, np.array([0]), np.array([len(p)]), np.array([w]))
                 for raw, p, w in ((np.frombuffer(p, np.uint8), p, w) for p, w in numbers)]
        ids, counts = np.concatenate([i for i, _ in parts]), np.concatenate([c for _, c in parts])
        at = np.cumsum(counts) - counts
        return ids[spans_of(at[number], counts[number])], counts[number]


class _Collision(Exception):
    """Two different pieces have the same hash."""


def _equal(a: np.ndarray, a_starts: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_starts: np.ndarray,
           b_lengths: np.ndarray) -> np.ndarray:
    """Whether slices hold the same bytes; one false for all if some do not."""
    if not np.array_equal(a_lengths, b_lengths):
        return np.zeros(1, bool)
    return np.array([np.array_equal(a[spans_of(a_starts, a_lengths)], b[spans_of(b_starts, b_lengths)])])


def _find(raw: np.ndarray, word: bytes) -> np.ndarray:
    """Places where ``word`` begins."""
    at = np.flatnonzero(raw[: max(0, len(raw) - len(word) + 1)] == word[0])
    for i in range(1, len(word)):
        at = at[raw[at + i] == word[i]]
    return at


def _at_white_space(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end behind ASCII white space; a part without any is as long as it is."""
    a = 0
    while a < len(raw):
        b = min(len(raw), a + SLICE_BYTES)
        while b < len(raw):
            white = np.flatnonzero((raw[b : b + SLICE_BYTES] == 32) | (raw[b : b + SLICE_BYTES] == 10))
            if len(white):
                b += int(white[0]) + 1
                break
            b = min(len(raw), b + SLICE_BYTES)
        yield raw[a:b]
        a = b
