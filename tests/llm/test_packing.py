"""Packing against the tokenizer library and the laws of its sequences."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellsift.llm import packing, word_bpe
from cellsift.llm.queries import op12_harmonic_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", None, "it's I'll 'S 'RE ''s !'s 'rest 'r 'v 'l 'll' '", "a<|endoftext|>b <| x <|startoftext|>", "É̀ é ÀÉ×÷ß ÿ Ÿ œ İ ΑΣ",
    "x\x1cy\x85z\xa0q 　中文 日本語", "'", "a'", "'s", "12 3.4e5 ²³ ½", "\n\t ", "don’t “x” – …", "\x00\x7f ~~ ^^", "'d've",
]


def encoder():
    with open(PATH, encoding="utf-8") as file:
        return word_bpe.WordEncoder(file.read())


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(5)
    signs = [*"abST'' .,12\n é×ÀßŸ<|中\x85", "<|endoftext|>", "'ll", "'re"]
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def test_ids_are_the_library_s():
    texts = odd_texts()
    assert [i.tolist() for i in encoder().encode(pa.array(texts, pa.string()))] == [plain_ids(t) for t in texts]


def test_long_texts_and_small_memories(monkeypatch):
    texts = odd_texts()[:400]
    texts.append("\n".join(t or "" for t in texts))
    monkeypatch.setattr(word_bpe, "SLICE_BYTES", 97)
    monkeypatch.setattr(word_bpe, "KNOWN", 50)
    assert [i.tolist() for i in encoder().encode(pa.array(texts, pa.string()))] == [plain_ids(t) for t in texts]


def test_pieces_that_share_a_hash(monkeypatch):
    texts = odd_texts()[:300]
    monkeypatch.setattr(word_bpe.SliceHasher, "hashes", lambda self, starts, ends: (ends - starts).astype(np.uint64))
    assert [i.tolist() for i in encoder().encode(pa.array(texts, pa.string()))] == [plain_ids(t) for t in texts]


def check(rows, pieces, capacity):
    """All ids of all documents, each in one piece; sequences without gaps and without padding."""
    want = sorted((str(i), tuple(plain_ids(t) + [1])) for i, t in rows)
    by_document, by_sequence = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length > 0
        by_document.setdefault(str(p.doc_id), []).append((p.start, p.doc_tokens, ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity and end & (end - 1) == 0
    full = sum(sum(n for _, n in parts) == capacity for parts in by_sequence.values())
    ids_of = {}
    for i, ids in want:
        ids_of.setdefault(i, []).append(ids)
    for i, texts in ids_of.items():
        if len(texts) > 1:  # repeated rows cannot be told apart by their id
            assert sum(len(p) for _, _, p in by_document[i]) == sum(map(len, texts))
            continue
        at, whole = 0, []
        for start, tokens, ids in sorted(by_document[i]):
            assert (start, tokens) == (at, len(texts[0]))
            at, whole = at + len(ids), whole + ids
        assert tuple(whole) == texts[0]
    assert set(by_document) == set(ids_of)
    return full, len(by_sequence)


@pytest.mark.parametrize("capacity", [1, 16, 2048])
def test_pack(spark, capacity):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:300])] + [(900, "word " * 9000), (7, "twice"), (7, "twice"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string").repartition(3)
    check(rows, packing.pack(docs, PATH, capacity).collect(), capacity)


def test_short_sequences_come_from_the_ends_of_tasks_only(spark):
    """A task leaves at most 2^i - 1 pieces of class i, which make at most i sequences: 1 + 2 + ... + 11 of them."""
    rows = [(i, f"word{i} " * (i % 700)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    full, all_ = check(rows, packing.pack(docs, PATH).collect(), 2048)
    assert all_ - full <= 2 * 66


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert packing.pack(empty, PATH).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(empty, PATH, 1000)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    ids = {d.doc_id: plain_ids(d.text) + [1] for d in docs}
    seen = dict.fromkeys(ids, 0)
    sequences = {}
    for p in op12_harmonic_packing(spark, "/root/testdata/sf0.001").collect():
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids[p.doc_id])
        seen[p.doc_id] += p.length
        sequences[p.sequence_id] = sequences.get(p.sequence_id, 0) + p.length
    assert seen == {i: len(x) for i, x in ids.items()}
    assert all(n & (n - 1) == 0 for n in sequences.values())
