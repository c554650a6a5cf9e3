"""Language of texts by a string kernel.

The kernel of two texts is the number of n-grams of one to four characters that both hold, over the root of the
product of how many each holds (blended spectrum, presence only). Landmark texts give a Nyström map of the kernel;
kernel ridge regression, one language against the rest, is solved in it. A text is scored by the product of its
presence row with landmarks and weights folded into one matrix, a batch of rows at a time.

n-grams are taken from lower-case text in which everything but letters is one blank, and are hashed to 2^15 places.
Whole texts are read, both in training and in prediction. A null text, or one without a letter, is ``und`` with score
0. Ties go to the first language in order. Without training rows every text is ``und``. Rows repeat as they come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cellsift.llm.common import ship, worker_cache

ship(__name__)

#: Bounds of what training takes: texts of each language, chosen by a hash of their id, and landmarks over all.
TEXTS_PER_LANGUAGE = 400
LANDMARKS = 300
RIDGE = 1e-2
SIZES = (1, 2, 3, 4)
PLACES = 1 << 15
NONE = "und"
_ROWS = 128
_BASE = np.uint32(0x01000193)


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Rows that no model may learn from: crc32 of the id's digits is a multiple of ``folds``. A null id counts as empty."""
    return F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % folds == 0


class Letters:
    """Which code points are letters."""

    def __init__(self):
        cache = worker_cache()
        if "letters" not in cache:
            cache["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.table = cache["letters"]


def presence(text: str | None, letters: Letters, out: np.ndarray) -> int:
    """Marks the places of a text's n-grams in ``out`` and returns how many there are; 0 if it holds no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    real = letters.table[codes]
    if not real.any():
        return 0
    codes = np.concatenate([[np.uint32(32)], np.where(real, codes, np.uint32(32)), [np.uint32(32)]])
    blank = codes == 32
    codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]
    for n in SIZES:
        size = len(codes) - n + 1
        if size <= 0:
            break
        h = np.full(size, n, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + size]) * _BASE
            h ^= h >> np.uint32(15)
        out[h >> np.uint32(32 - 15)] = True
    return int(np.count_nonzero(out))


class Model:
    """Learned languages and the matrix that scores presence rows."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(sizes, 1))[:, None]


def fit_rows(rows: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression over the Nyström map of the given presence rows."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((PLACES, 0), np.float32))
    x = rows.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    # Every language gets its share of landmarks; rows come in the order of a hash.
    seats = np.zeros(len(labels), np.int64)
    for language in languages:
        own = np.flatnonzero(np.array([label == language for label in labels]))
        seats[own] = np.arange(len(own))
    chosen = np.argsort(seats, kind="stable")[:landmarks]
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > max(values.max(), 0) * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T).astype(np.float64) @ root
    wanted = np.array([[1.0 if label == language else -1.0 for language in languages] for label in labels])
    share = np.array([1.0 / (wanted == 1).sum(0)[languages.index(label)] for label in labels])
    weighted = z * (share / share.mean())[:, None]
    solved = np.linalg.solve(weighted.T @ z + ridge * len(z) * np.eye(z.shape[1]) / 100, weighted.T @ wanted)
    return Model(languages, (marks.T.astype(np.float64) @ (root @ solved)).astype(np.float32))


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang",
        per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Learn from labelled rows. Of each language about ``per_language`` texts are taken, those whose id has the
    smallest hash; their presence rows, 4 KB each, come to the driver."""
    label, text = F.col(f"`{label_column}`").cast("string"), F.col(f"`{text_column}`").cast("string")
    place = F.pmod(F.xxhash64(F.col(f"`{id_column}`")), F.lit(1 << 30))
    labelled = docs.where(label.isNotNull()).select(label.alias("label"), place.alias("place"), text.alias("text"))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit_rows(np.zeros((0, PLACES), bool), [])
    limits = {c: int(min(1.0, 1.3 * per_language / n) * (1 << 30)) for c, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(v) for pair in limits.items() for v in pair]), F.col("label"))
    # Repeated rows of an id count once, so that a row with many copies cannot outgrow the bound.
    chosen = labelled.where(F.col("place") < limit).groupBy("label", "place").agg(F.min("text").alias("text"))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = Letters()
        for batch in batches:
            kept = []
            for row in batch.itertuples(index=False):
                out = np.zeros(PLACES, bool)
                if presence(row.text, letters, out):
                    kept.append((row.label, row.place, np.packbits(out).tobytes()))
            yield pd.DataFrame(kept, columns=["label", "place", "marks"])

    marked = chosen.mapInPandas(marks, "label string, place long, marks binary").collect()
    taken = sorted((r.label, r.place, bytes(r.marks)) for r in marked)
    rows, labels, seen = [], [], dict.fromkeys(limits, 0)
    for name, _, packed in taken:
        if seen[name] < per_language:
            seen[name] += 1
            labels.append(name)
            rows.append(np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool))
    return fit_rows(np.array(rows).reshape(len(rows), PLACES), labels)


def predict(docs: DataFrame, model: Model, text_column: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row; a map without a shuffle.

    The score is the winner's value, 1 where the regression says this language and 0 where it says any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").cast("string").alias("_text"))
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = Letters(), shared.value
        for batch in batches:
            texts = batch.column(len(keep))
            names, scores = np.full(len(texts), NONE, object), np.zeros(len(texts))
            for a in range(0, len(texts) if model.languages else 0, _ROWS):
                part = texts.slice(a, _ROWS).to_pylist()
                marks = np.zeros((len(part), PLACES), bool)
                sizes = np.array([presence(t, letters, marks[i]) for i, t in enumerate(part)])
                values = model.scores(marks, sizes)
                best = values.argmax(1)
                known = np.flatnonzero(sizes)
                names[a + known] = np.array(model.languages, object)[best[known]]
                scores[a + known] = np.clip((values[known, best[known]] + 1) / 2, 0, 1)
            arrays = [*[batch.column(i) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(run, schema)
