"""Each stage against a plain version on its own input."""

import hashlib
import re
from collections import Counter

import pytest
import tiktoken

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as c  # noqa: E402
from cellsift.llm import bpe, mixing  # noqa: E402
from tests.llm.test_secrets import all_spans  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, [docs.collect()]
    for name, stage in c.STAGES:
        docs = c.staged(stage(spark, docs, SF), name.replace(" ", "-"))
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1]}
    assert set(steps[1]) <= set(steps[0])
    clean = [i for i, bad in labels.items() if not bad]
    assert sum(i in kept for i in clean) / len(clean) > 0.98
    toxic = [i for i, bad in labels.items() if bad]
    # A few toxic texts of each of the rarer languages are too few to learn from.
    assert sum(i not in kept for i in toxic) / len(toxic) > 0.6


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_one_of_each_group_stays(steps):
    sets = {r.doc_id: shingles(r.text) for r in steps[1]}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    want = [r for r in steps[1] if root(r.doc_id) == r.doc_id]
    assert len(want) < len(steps[1])
    assert sorted(steps[2]) == sorted(want)


def test_secrets_are_masked(steps):
    before = {r.doc_id: r for r in steps[2]}
    assert len(steps[3]) == len(before)
    changed = 0
    for r in steps[3]:
        text, out, at = before[r.doc_id].text or "", [], 0
        spans = all_spans(text)
        for a, _, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        want = "".join(out) + text[at:]
        assert (r.text, r.n_chars) == (want, len(want) if spans else before[r.doc_id].n_chars)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        changed += bool(spans)
    assert changed


def test_sources_are_mixed(steps):
    passes = Counter(steps[4])
    assert set(passes) == set(steps[3]) and set(passes.values()) <= {1, 2}
    tokens, dealt = Counter(), Counter()
    for r in steps[3]:
        tokens[r.source] += len(r.text.split())
        dealt[r.source] += len(r.text.split()) * passes[r]
    names = list(tokens)
    _, weights, budget = mixing.temperature([tokens[s] for s in names], repeats=c.REPEATS)
    for s, w in zip(names, weights):
        longest = max(len(r.text.split()) for r in steps[3] if r.source == s)
        assert w * budget - longest <= dealt[s] <= w * budget + 1e-6


def test_ids(steps):
    ranks = bpe.vocabulary(P.path(c.VOCABULARY)).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in steps[4])
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps[5]) == want


def test_ids_are_decoded(steps):
    texts = {r.doc_id: r.text or "" for r in steps[4]}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in steps[5])


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "A b c d e f g", None, None, None)]
    rows += [(3, None, None, "s", 0), (4, "", "en", "s", 0), (None, "a b c d e f g", "en", "s", 13), (5, "token: abcdefgh", "en", "t", 15)]
    docs = spark.createDataFrame([(*r, 1.5, "x", []) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, tokens double, toxic string, spans array<int>")
    for name, stage in c.STAGES[:-1]:
        docs = c.staged(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns[-3:] == ["tokens", "toxic", "spans"]
    assert Counter((r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id", "text"]).collect()) == Counter(
        [(1, "a b c d e f g"), (3, None), (4, ""), (None, "a b c d e f g"), (5, "[assign]")]
    )
    assert c.encode(spark, docs, SF).count() == docs.count()
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in c.STAGES:
        empty = c.staged(stage(spark, empty, SF), name.replace(" ", "-"))
        assert empty.count() == 0
