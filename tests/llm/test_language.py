"""The kernel against its definition, predictions against held-out labels."""

import zlib

import numpy as np

from cellsift.llm import language
from cellsift.llm.queries import op5_string_kernel

SF = "/root/testdata/sf0.01"


def test_presence_is_of_whole_texts_and_letters_only():
    letters = language.Letters()
    for text in (None, "", " 12 !", "\n"):
        assert language.presence(text, letters, np.zeros(language.PLACES, bool)) == 0

    def marks(text):
        out = np.zeros(language.PLACES, bool)
        language.presence(text, letters, out)
        return out

    assert (marks("Ab, cd!") == marks("  ab CD")).all()
    assert (marks("ab" * 50_000 + " zq") != marks("ab" * 50_000)).any()
    # Grams of " ab ": a, b, blank; " a", "ab", "b "; " ab", "ab "; " ab ".
    assert marks("ab").sum() == 9


def test_symbols_beyond_the_first_plane_are_no_letters(spark):
    letters = language.Letters()

    def marks(text):
        out = np.zeros(language.PLACES, bool)
        return language.presence(text, letters, out), out

    assert marks("\U0001f600\U0001f680 \U0001f600")[0] == 0 and marks("\U0010ffff")[0] == 0
    assert (marks("good\U0001f600day")[1] == marks("good day")[1]).all()
    assert marks("\U00010330\U00020000")[0] > 0  # letters of Gothic and Han
    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "\U0001f600 \U0001f680", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, language.fit(docs)).collect()}
    assert got[1][0] == "en" and got[2] == ("und", 0.0)


def test_kernel_ridge_is_the_exact_one_when_all_rows_are_landmarks():
    rng = np.random.default_rng(0)
    rows = rng.random((40, language.PLACES)) < 0.01
    labels = ["x", "y"] * 20
    model = language.fit_rows(rows, labels, landmarks=40, ridge=1e-2)
    x = rows / np.sqrt(rows.sum(1, keepdims=True))
    kernel = x @ x.T
    y = np.array([[1.0, -1.0] if label == "x" else [-1.0, 1.0] for label in labels])
    want = kernel @ np.linalg.solve(kernel + 1e-2 * 40 / 100 * np.eye(40), y)
    assert np.abs(model.scores(rows, rows.sum(1)) - want).max() < 1e-3


def test_rows_without_letters_ties_repeats_and_clashing_names(spark):
    rows = [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "fr"), (4, "123 !", "en"), (None, "the", None)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string").withColumn("score", docs_lit())
    model = language.fit(docs)
    assert model.languages == ["en", "fr"]
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.predict(docs, model).collect())
    assert got == [("1", "en"), ("1", "en"), ("2", "fr"), ("3", "und"), ("4", "und"), ("None", "en")]


def docs_lit():
    from pyspark.sql import functions as F

    return F.lit("mine")


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.fit(docs).languages == []
    assert [tuple(r) for r in language.predict(docs, language.fit(docs)).collect()] == [(1, "und", 0.0)]
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).collect() == []


def test_query_on_held_out_rows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_string_kernel(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
