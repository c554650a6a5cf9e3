"""Byte-level BPE: ids of whole texts, and bytes of ids.

A text is cut by the tokenizer's pattern; every piece is merged by the ranks of a vocabulary file. The distinct pieces
that are new to a task are sorted into length buckets. A bucket is a padded matrix of ids, one piece a row, beside a
matrix with the rank of each neighbouring pair. In each round every row merges its leftmost pair of minimum rank;
pairs are looked up in an open-addressing table, and rows without a pair to merge leave the matrix.

Pieces over ``WIDE`` bytes are merged by another exact way, one piece at a time: all places of the minimum rank merge in a
round where that gives what leftmost merges would.

Nulls count as empty texts, which have no ids. Equal texts have equal ids; repeated rows stay. An empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from cellsift.llm.common import ship, spans_of

ship(__name__)


_NONE = np.int64(1 << 40)
#: Pieces with more bytes than this are merged one by one.
WIDE = 512
#: A task forgets its pieces when they take about so many bytes; this bounds memory and changes no result.
KNOWN_BYTES = 24 << 20
_PIECE_COST = 180  # a dict entry, a string's head, two numbers and some ids
#: Rows of a matrix.
MATRIX_ROWS = 8192
#: So many characters are cut into pieces at once.
SLICE_CHARS = 1 << 20
#: And so many bytes of texts are one batch of results.
SLICE_BYTES = 4 << 20
#: So many ids are turned into bytes at once.
SLICE_IDS = 1 << 18


class Vocabulary:
    """Tokens by id, whole tokens by their bytes, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {
            (ranks[token[:i]] << 20) | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self._fill(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int64))

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, _NONE, np.int64)
        self.probes, at = 0, self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[at] == np.iinfo(np.uint64).max
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id and rank of each pair's merge, ``_NONE`` where there is none; negative ids are padding."""
        out = np.full(left.shape, _NONE, np.int64)
        real = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = (left.ravel()[real].astype(np.uint64) << np.uint64(20)) | right.ravel()[real].astype(np.uint64)
        at, flat = self._slot(keys), out.ravel()
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            flat[real[hit]] = self.values[at[hit]]
            go = ~hit & (there != np.iinfo(np.uint64).max)
            if not go.any():
                break
            real, keys, at = real[go], keys[go], (at[go] + 1) & self.mask
        return flat.reshape(left.shape)


def vocabulary(path: str) -> Vocabulary:
    """From a file of base64 tokens and ranks, read on the driver: a tokenizer's vocabulary does not grow with the data."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
           out_column: str | None = None) -> DataFrame:
    """``id_column`` and ``ids array<int>`` for every row; a map without a shuffle.

    With ``out_column`` the ids are decoded in the same pass, as ``decode`` would: one Python worker a task instead of two.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value, pattern)
        for batch in batches:
            for at, n in _row_slices(batch.column("text")):
                part = batch.slice(at, n)
                ids, sizes = cutter.encode([t or "" for t in part.column("text").to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                columns = [part.column("id"), listed]
                if out_column:
                    bounds = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                    columns.append(pa.array([_bytes_of(cutter.voc, ids[a:b]) for a, b in bounds], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "ids", "decoded"] if out_column else ["id", "ids"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + (", decoded binary" if out_column else "")
    return rows.mapInArrow(run, schema).toDF(id_column, "ids", *([out_column] if out_column else []))


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", out_column: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; all other columns stay. A null list gives null, an unknown id an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = encoded.columns
    at = names.index(ids_column)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_column, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        for batch in batches:
            lists = batch.column(at)
            parts = [None if ids is None else _bytes_of(voc, ids.values.to_numpy()) for ids in _lists(lists)]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], [*names, out_column])

    return encoded.mapInArrow(run, schema)


def _row_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of a few megabytes, or of one row."""
    ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield at, end - at
        at = end


def _lists(lists: pa.ListArray) -> Iterator[pa.ListScalar | None]:
    for ids in lists:
        yield ids if ids.is_valid else None


def _bytes_of(voc: Vocabulary, ids: np.ndarray) -> bytes:
    out = []
    for a in range(0, len(ids), SLICE_IDS):
        part = ids[a : a + SLICE_IDS]
        if part.min() < 0 or part.max() >= len(voc.lengths) or not voc.lengths[part].all():
            raise ValueError("an id is not in the vocabulary")
        out.append(voc.bytes[spans_of(voc.starts[part], voc.lengths[part])].tobytes())
    return b"".join(out)


class Cutter:
    """Encodes texts and remembers the pieces it has seen."""

    def __init__(self, voc: Vocabulary, pattern: str):
        self.voc, self.cut, self.cut_latin = voc, regex.compile(pattern).findall, _latin(pattern)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        ids, sizes, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= SLICE_CHARS):
                chars += len(texts[end])
                end += 1
            part = self._encode(texts[at:end])
            ids.append(part[0])
            sizes.append(part[1])
            at = end
        return np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, text: str) -> list[str]:
        if self.cut_latin is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.cut(text)
            return self.cut_latin(text)
        return self.cut(text)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = list(map(self._pieces, texts))
        flat = list(chain.from_iterable(rows))
        new = set(flat) - self.known.keys()
        cost = sum(map(len, new)) + len(new) * _PIECE_COST
        if self.held + cost > KNOWN_BYTES:
            self._forget()
            new = set(flat)
            cost = sum(map(len, new)) + len(new) * _PIECE_COST
        self.held += cost
        if new:
            self._learn(list(new))
        where = np.array(list(map(self.known.__getitem__, flat)), np.int64)
        counts = self.lengths[where]
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = total[np.cumsum([len(row) for row in rows])]
        return self.ids[spans_of(self.starts[where], counts)], np.diff(ends, prepend=0)

    def _learn(self, pieces: list[str]) -> None:
        ids = self._merge([p.encode("utf-8", "replace") for p in pieces])
        lengths = np.array(list(map(len, ids)), np.int64)
        self.known.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.concatenate(ids).astype(np.int32)])

    def _merge(self, raw: list[bytes]) -> list[np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if b in self.voc.ranks:
                found[i] = np.array([self.voc.ranks[b]], np.int64)
            else:
                buckets.setdefault(len(b) if len(b) < 16 else 16 * len(b).bit_length(), []).append(i)
        for rows in buckets.values():
            if max(len(raw[i]) for i in rows) > WIDE:
                for i in rows:
                    found[i] = merge_wide(self.voc, raw[i])
            else:
                for a in range(0, len(rows), MATRIX_ROWS):
                    part = rows[a : a + MATRIX_ROWS]
                    for i, ids in zip(part, merge_rows(self.voc, [raw[i] for i in part]), strict=True):
                        found[i] = ids
        return found


def _latin(pattern: str):
    """The cutter for texts of Latin-1 characters only: the same pattern, its character properties spelled out.

    None if the pattern has other escapes than those of letters, numbers and white space.
    """
    if re.search(r"\\(?!p\{[LN]\}|[sS])|\(\?[^!:=]", pattern):
        return None
    chars = [chr(c) for c in range(256)]
    for escape in (r"\p{L}", r"\p{N}", r"\s"):
        inside = "".join(re.escape(c) for c in chars if regex.match(escape, c))
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(escape), lambda m, inside=inside: m[1] + inside, pattern)
        pattern = pattern.replace(escape, f"[{inside}]")
        if escape == r"\s":
            pattern = pattern.replace(r"\S", f"[^{inside}]")
    return re.compile(pattern).findall


def merge_rows(voc: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece: one padded matrix, one merge a row and round."""
    out: list[np.ndarray] = [None] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ids = np.full((len(pieces), int(sizes.max())), -1, np.int64)
    ids[np.arange(ids.shape[1]) < sizes[:, None]] = voc.single[np.frombuffer(b"".join(pieces), np.uint8)]
    ranks = voc.merged(ids[:, :-1], ids[:, 1:])
    rows = np.arange(len(pieces))
    while len(rows):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
        done = best >= _NONE
        for k in np.flatnonzero(done):
            out[rows[k]] = ids[k, : sizes[k]]
        live = ~done
        rows, ids, ranks, sizes, at, best = rows[live], ids[live], ranks[live], sizes[live] - 1, at[live], best[live]
        if not len(rows):
            break
        each = np.arange(len(rows))
        ids[each, at] = best
        columns = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
        columns = np.arange(ranks.shape[1] - 1)
        ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < ranks.shape[1])
        ranks[left, at[left] - 1] = voc.merged(ids[left, at[left] - 1], best[left])
        ranks[right, at[right]] = voc.merged(best[right], ids[right, at[right] + 1])
        width = int(sizes.max())
        if width < ids.shape[1]:
            ids, ranks = ids[:, :width], ranks[:, : width - 1]
    return out


def merge_wide(voc: Vocabulary, piece: bytes) -> np.ndarray:
    """Ids of one long piece. All places of the minimum rank merge in one round, left to right, unless one of those
    merges makes a pair of a lower rank; then only the leftmost does."""
    ids = voc.single[np.frombuffer(piece, np.uint8)]
    ranks = voc.merged(ids[:-1], ids[1:])
    while len(ranks) and (best := int(ranks.min())) < _NONE:
        places = np.flatnonzero(ranks == best)
        # In a run of overlapping places every second one merges.
        runs = np.cumsum(np.diff(places, prepend=-2) != 1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1])
        places = places[(np.arange(len(places)) - first[runs - 1]) % 2 == 0]
        if len(places) > 1:
            before = np.where(np.isin(places - 2, places), best, ids[places - 1])
            lowest = np.minimum(
                voc.merged(np.where(places > 0, before, -1), np.full(len(places), best)),
                voc.merged(
                    np.full(len(places), best), np.where(places + 2 < len(ids), ids[(places + 2) % len(ids)], -1)
                ),
            )
            if lowest.min() < best:
                places = places[:1]
        keep = np.ones(len(ids), bool)
        keep[places + 1] = False
        ids = ids.copy()
        ids[places] = best
        ids = ids[keep]
        if len(places) == 1:
            j = int(places[0])
            ranks = np.delete(ranks, j)
            for k in (j - 1, j):
                if 0 <= k < len(ranks):
                    ranks[k] = voc.merged(ids[k : k + 1], ids[k + 1 : k + 2])[0]
        else:
            ranks = voc.merged(ids[:-1], ids[1:])
    return ids
