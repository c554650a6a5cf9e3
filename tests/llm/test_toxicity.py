"""The regression against the likelihood's own optimum conditions, verdicts against held-out labels."""

import numpy as np
import pytest

from cellsift.llm import toxicity as t
from cellsift.llm.queries import op3_cumulative_link

SF = "/root/testdata/sf0.1"


def places(*texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    rows, found = t.Features().of(raw, offsets)
    return [set(found[rows == i].tolist()) for i in range(len(texts))]


def test_features():
    a, b, c, d, e = places("Stupid dog", "stupid! DOG.", "", " ,;", "stupidity")
    assert a == b and not c and not d
    assert len(a) == 4  # two words, beginnings of 4 and 5 letters
    assert len(a & e) == 3 and places("stup")[0] != places("stupx")[0]
    assert places("ab", "cd")[0] == places("ab")[0]  # rows do not run into each other
    long_text = places("word " * 100_000 + "stupid")[0]
    assert places("stupid")[0] <= long_text


def test_thresholds_are_ordered_and_more_marks_are_worse():
    rng = np.random.default_rng(0)
    texts, toxic = [], []
    for i in range(600):
        bad = i % 3 == 0
        marks = rng.choice(20, rng.integers(1, 8), replace=False) if bad else []
        texts.append(np.unique(np.concatenate([np.array(marks, np.int64), rng.integers(100, t.PLACES, 60)])))
        toxic.append(bad)
    model = t.fit_rows(texts, np.array(toxic), np.ones(600))
    assert (np.diff(model.thresholds) > 0).all()
    used = np.flatnonzero(model.weights)
    assert set(used) <= set(range(20)) and (model.weights[used] > 0).all()
    rows = np.repeat(np.arange(4), [0, 1, 4, 8])
    chances = model.exceeding(rows, np.concatenate([used[:0], used[:1], used[:4], used[:8]]), 4)
    assert (np.diff(chances, axis=1) <= 0).all()
    assert (np.diff(chances.sum(1)) > 0).all()
    assert chances[0, 0] < 0.5 < chances[2, 0]
    twice, often = (
        model.exceeding(np.repeat(rows, k), np.repeat(np.concatenate([used[:0], used[:1], used[:4], used[:8]]), k), 4)
        for k in (2, 50)
    )
    assert np.allclose(twice, often)


def test_only_copies_and_near_copies_count_once():
    rng = np.random.default_rng(1)
    # Texts of different words that share the words with the smallest hashes, so any one coordinate calls them copies.
    common = np.arange(1000, 1040)
    texts = [np.unique(np.concatenate([common, rng.integers(2000, t.PLACES, 150)])) for _ in range(60)]
    toxic = np.arange(60) < 30
    assert (t.copies(texts, toxic) == np.arange(60)).all()
    near = np.unique(np.concatenate([texts[3][5:], [7, 8]]))
    first = t.copies([*texts, texts[3], near, texts[3], texts[40]], np.concatenate([toxic, [True, True, False, False]]))
    assert first[60:].tolist() == [3, 3, 62, 40]  # a copy under the other label is none


def test_texts_that_share_a_common_word_all_teach():
    rng = np.random.default_rng(2)
    hashes = np.arange(t.PLACES, dtype=np.int64) * 0x9E3779B1 & 0xFFFFFFFF
    shared = int(hashes[1:].argmin()) + 1  # the place that is every text's minimum under one hash
    texts, toxic = [], []
    for i in range(200):
        words = rng.integers(100, t.PLACES, 60)
        texts.append(np.unique(np.concatenate([words, [shared], [1, 2, 3] if i < 40 else []])).astype(np.int64))
        toxic.append(i < 40)
    model = t.fit_rows(texts, np.array(toxic), np.ones(200))
    assert set(np.flatnonzero(model.weights)) == {1, 2, 3}


def test_marks_of_a_rare_kind_of_toxic_texts_are_learnt():
    rng = np.random.default_rng(3)
    texts, toxic = [], []
    for i in range(8000):
        marks = [1, 2] if i < 40 else [3, 4] if i < 4000 else []  # 40 of 4,000 toxic texts are of their own kind
        texts.append(np.unique(np.concatenate([rng.integers(100, t.PLACES, 20), marks]).astype(np.int64)))
        toxic.append(i < 4000)
    model = t.fit_rows(texts, np.array(toxic), np.ones(8000))
    assert set(np.flatnonzero(model.weights)) == {1, 2, 3, 4}
    assert (model.exceeding(np.array([0, 0, 1, 1, 2]), np.array([1, 2, 3, 4, 200]), 3)[:, 0] >= 0.5).tolist() == [True, True, False]


def test_discoveries_keep_their_bound():
    rng = np.random.default_rng(5)
    for share in (0.05, 0.3):
        both = rng.integers(1, 200, 20_000)
        held = rng.binomial(both, share)
        assert t.discovered(held, both, share).sum() <= 1  # chance alone
        held[:50], both[:50] = 12, 12  # marks
        found = np.flatnonzero(t.discovered(held, both, share))
        assert set(range(50)) <= set(found) and len(found) <= 50 / (1 - t.CHANCE) + 3
    # The more features there are to try, the more is asked of one: three of three toxic texts say little among many.
    few = np.array([3, 0, 0]), np.array([3, 9, 9])
    assert t.discovered(*few, 0.1).tolist() == [True, False, False]
    many = np.concatenate([[3], np.zeros(5000, int)]), np.concatenate([[3], np.full(5000, 9)])
    assert not t.discovered(*many, 0.1).any()
    assert not t.discovered(np.array([1]), np.array([1]), 1e-9).any()  # one text alone


def test_few_labels_teach_something(spark):
    """Eight toxic texts of ninety, with words that the others lack."""
    rng = np.random.default_rng(6)
    words = [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(words, 40)) + (" pathetic loser" if i < 8 else "")
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(90)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in t.score(docs, t.fit(docs, labels)).collect()}
    assert sum(got[i] for i in range(8)) == 8 and not any(got[i] for i in range(8, 90))
    plain = spark.createDataFrame([(i, f"word{i}") for i in range(90)], "doc_id long, text string")
    with pytest.warns(UserWarning, match="nothing marks the 8 toxic of 90"):
        assert t.fit(plain, labels) is t.NOTHING


def test_smallest_scale(spark):
    """Eleven toxic labels among 87: what little they say is used, on no clean text."""
    sf = "/root/testdata/sf0.001"
    rows = op3_cumulative_link(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    caught = {r.doc_id for r in rows if r.toxic}
    assert sum(bool(labels[i]) for i in caught if i in labels) >= 5 and all(labels[i] for i in caught if i in labels)


def test_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "x y", 0.5), (2, None, 0.5), (None, "", 0.5)], "doc_id long, text string, severity double")
    for labels in ([], [(1, 1)], [(1, 0)], [(1, None), (None, 1)]):
        model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = t.score(docs, model).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"]
        assert all(r.severity == 0 and r.toxic is False for r in got)
    assert t.score(docs.limit(0), t.NOTHING, keep=("doc_id", "text")).collect() == []


def test_verdicts_on_labels_that_training_did_not_see(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    model = t.fit(docs, seen)
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r for r in t.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.severity <= 3 for r in got.values())
    missed = sum(not got[i].toxic for i, bad in truth.items() if bad)
    wrong = sum(got[i].toxic for i, bad in truth.items() if not bad)
    bad = sum(truth.values())
    # Half of the labels hold few toxic texts of the rarer languages.
    assert missed / bad < 0.1 and wrong / (len(truth) - bad) < 0.01


def test_query(spark):
    rows = op3_cumulative_link(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert sum(r.toxic == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels) / len(labels) > 0.94
