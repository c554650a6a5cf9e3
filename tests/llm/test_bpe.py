"""Ids against the tokenizer library, bytes against the texts."""

import random

import pytest
import tiktoken

P = pytest.importorskip("public_tokenizers")

from cellsift.llm import bpe  # noqa: E402
from cellsift.llm.queries import op2_byte_bpe  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def voc():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library(voc):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=voc.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    spaces = "".join(map(chr, range(0x250))) + " " + " a".join(map(chr, range(0x3100)))
    out = ["", " ", "a", " a ", "a  b", "x \n y\n\n z", "isn't it's we'll", spaces, "   x\x1c y \x1d\x85 z"]
    out += ["a" * 5000, "ab" * 3000, "the" * 2000, " " * 4000, "日本語" * 900, "\U0001f600 é" * 300, "aab" * 700]
    out += ["".join(rng.choice("abcdefghe tion\n'sé日😀123 .,!") for _ in range(rng.randrange(300))) for _ in range(200)]
    out += ["".join(rng.choice("aeitnos") for _ in range(rng.randrange(500, 3000))) for _ in range(20)]
    return out


def test_ids_are_the_library_s(voc, library):
    ids, sizes = bpe.Cutter(voc, P.PATTERN).encode(texts())
    at = 0
    for text, n in zip(texts(), sizes, strict=True):
        assert ids[at : at + n].tolist() == library.encode_ordinary(text)
        at += n


def test_forgetting_changes_nothing(voc, monkeypatch):
    want = bpe.Cutter(voc, P.PATTERN).encode(texts())[0].tolist()
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 50 * 200)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 500)
    monkeypatch.setattr(bpe, "MATRIX_ROWS", 3)
    assert bpe.Cutter(voc, P.PATTERN).encode(texts())[0].tolist() == want


def test_rows_nulls_and_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "null id", "x"), (5, None, "x"), (1, " ", "x"), (1, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    encoded = bpe.encode(docs, PATH, P.PATTERN)
    assert encoded.columns == ["doc_id", "ids"]
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in bpe.decode(encoded, PATH).collect())
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert got == want
    both = bpe.encode(docs, PATH, P.PATTERN, out_column="text")
    assert both.columns == ["doc_id", "ids", "text"]
    assert sorted((str(r.doc_id), r.ids, bytes(r.text)) for r in both.collect()) == want


def test_empty_table_null_list_unknown_id(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(lists, PATH).orderBy("doc_id").collect()] == [None, b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), PATH).collect()


def test_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
