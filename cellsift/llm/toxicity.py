"""Toxicity as an ordered grade: cumulative-link regression over sparse features of whole texts.

Features are the words of a text and the beginnings of longer words, hashed to 2^18 places, each once for being there
and once more for being there twice; no more than that counts, so an insult in a long text weighs what it does in a
short one. Of all features those take part that the training texts have in toxic ones far more often than in clean
ones, beyond chance: a false-discovery bound over all features asks more of each the more of them there are to try, and
works alike with few labels and many. One weight vector serves all grades; ordered thresholds turn a text's score into the chances to exceed each
grade (a logistic link), and their sum is the expected severity.

The labels tell clean from toxic only. Grades come from them and the text: clean is 0, and toxic texts are 1, 2 or 3
by thirds of how many of those features they hold. So severity says how many marks there are, which is also how sure
the verdict is; it is no judgement of harm that somebody made.

Training takes a bounded sample of labelled rows, those whose id has the smallest hash, weighted back to the labels'
own shares. Null and empty texts have no features and the severity of an unmarked text. Without labels of both kinds
nothing is toxic; so it is if no feature passes the bound, of which ``fit`` warns. Rows repeat as they come; of several labels of one id the worst counts. Scoring is a map without a
shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cellsift.llm.common import SliceHasher, runs, ship, slices

ship(__name__)

#: Bound of what training takes of each label, toxic or clean: hashed features of about so many texts come to the driver.
TEXTS_PER_LABEL = 3000
GRADES = 4
PLACES = 1 << 18
#: Bytes of a longer word's beginning that make a feature besides the whole word; a short word and such a beginning are one.
BEGINNINGS = (4, 5, 6, 7)
#: A feature that takes part is held by so many times the share of toxic texts than of clean ones, and is one of those of which
#: this share at most is there by chance. Features of one text alone are not tried.
LEAST_RATIO, CHANCE = 5, 0.05
#: Texts that have this share of their places in common are near copies. They are looked for among texts of which this share of
#: signature coordinates agrees.
COPY, AGREEING, COORDINATES = 0.8, 0.5, 64
RIDGE, STEPS, RATE = 1e-3, 800, 0.1


class Features:
    """Hashed features of many texts at once."""

    def __init__(self):
        # A word is a run of letters, digits and bytes of other scripts.
        self.inside = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.hasher = SliceHasher()

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of every feature, repeats included."""
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, ends = runs(self.inside[raw], offsets)
        rows = np.searchsorted(offsets, starts, "right") - 1
        self.hasher.over(self.lower[raw])
        owners, hashes = [rows], [self.hasher.hashes(starts, ends)]
        for n in BEGINNINGS:
            longer = ends - starts > n
            owners.append(rows[longer])
            hashes.append(self.hasher.hashes(starts[longer], starts[longer] + n))
        return np.concatenate(owners), (np.concatenate(hashes) & np.uint64(PLACES - 1)).astype(np.int64)


def distinct(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's places once, by row, and once more, ``PLACES`` further, those that it holds twice."""
    pairs, counts = np.unique(rows * (2 * PLACES) + places, return_counts=True)
    pairs = np.sort(np.concatenate([pairs, pairs[counts > 1] + PLACES]))
    return pairs // (2 * PLACES), pairs % (2 * PLACES)


class Model:
    """Weights by place, zero for features that take no part, and the thresholds between grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceeding(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """For each of ``n`` texts the chances to exceed each grade."""
        used = (self.weights[places] != 0) | (self.weights[places + PLACES] != 0)
        rows, places = distinct(rows[used], places[used])
        scores = np.bincount(rows, self.weights[places], n)
        return _logistic(scores[:, None] - self.thresholds)


NOTHING = Model(np.zeros(2 * PLACES), np.full(GRADES - 1, np.inf))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def copies(texts: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """For each text the number of an earlier one of its label that it is a copy or near copy of, or else its own.

    Signatures only choose whom a text is compared with; their places themselves decide.
    """
    factors = np.random.default_rng(0).integers(1 << 62, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
    first, inside = np.arange(len(texts)), np.zeros(2 * PLACES, bool)
    for bad in (True, False):
        own = np.flatnonzero(toxic == bad)
        signatures, kept = np.zeros((len(own), COORDINATES), np.uint32), []
        for i in own.tolist():
            text = texts[i]
            numbers = text.astype(np.uint64) + np.uint64(1)
            signature = np.array([(numbers * factor).min() >> np.uint64(32) for factor in factors], np.uint32)
            agreeing = (signatures[: len(kept)] == signature).sum(1)
            inside[text] = True
            for j in np.flatnonzero(agreeing >= AGREEING * COORDINATES).tolist():
                common = int(inside[texts[kept[j]]].sum())
                if common >= COPY * (len(text) + len(texts[kept[j]]) - common):
                    first[i] = kept[j]
                    break
            else:
                signatures[len(kept)] = signature
                kept.append(i)
            inside[text] = False
    return first


def discovered(held: np.ndarray, both: np.ndarray, share: float) -> np.ndarray:
    """Which features toxic texts hold more often than the toxic ``share`` of all texts explains.

    ``held`` of the ``both`` texts with a feature are toxic. Its chance of so many is bounded by Chernoff's inequality, and
    of the features in order of their chances those are taken that keep the false discoveries below ``CHANCE`` of all taken
    (Benjamini and Hochberg).
    """
    part = held / np.maximum(both, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        toxic = np.where(part > 0, part * np.log(part / share), 0.0)
        clean = np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - share)), 0.0)
    chance = np.where(part > share, -both * (toxic + clean), 0.0)  # its logarithm
    tried = np.flatnonzero(both > 1)
    order = tried[np.argsort(chance[tried], kind="stable")]
    within = np.flatnonzero(chance[order] <= np.log(CHANCE * np.arange(1, len(order) + 1) / max(len(order), 1)))
    found = np.zeros(len(held), bool)
    found[order[: within[-1] + 1 if len(within) else 0]] = True
    return found


def fit_rows(texts: list[np.ndarray], toxic: np.ndarray, shares: np.ndarray) -> Model:
    """Learn from the distinct places of each text. ``shares`` are the weights of the rows.

    Of copies and near copies the first counts, with the weights of all: the words of a copied text mark nothing.
    """
    some = [i for i, text in enumerate(texts) if len(text)]
    texts, toxic, shares = [texts[i] for i in some], toxic[some], shares[some]
    first = copies(texts, toxic)
    shares = np.bincount(first, shares, len(texts))
    some = np.flatnonzero(first == np.arange(len(texts)))
    texts, toxic, shares = [texts[i] for i in some], toxic[some], shares[some]
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return NOTHING
    held, clean = np.zeros(2 * PLACES, np.int64), np.zeros(2 * PLACES, np.int64)
    for text, bad in zip(texts, toxic, strict=True):
        (held if bad else clean)[text] += 1  # a text's places are distinct
    both, share = held + clean, n_toxic / (n_toxic + n_clean)
    odds = np.log((held + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    rarer = clean / n_clean * LEAST_RATIO <= held / n_toxic
    marking = rarer & discovered(held, both, share)
    if not marking.any():
        return NOTHING
    number = np.cumsum(marking) - 1
    used = [number[t[marking[t]]] for t in texts]
    sizes = np.array([len(u) for u in used])
    levels = np.quantile(sizes[toxic], np.arange(1, GRADES - 1) / (GRADES - 1))
    grades = np.where(toxic, 1 + (sizes[:, None] > levels).sum(1), 0)
    rows = np.repeat(np.arange(len(used)), sizes)
    return _ordinal(np.concatenate(used), rows, grades, shares / shares.sum(), marking, odds[marking])


def _ordinal(columns: np.ndarray, rows: np.ndarray, grades: np.ndarray, shares: np.ndarray, marking: np.ndarray,
             odds: np.ndarray) -> Model:
    """Adam over the likelihood of the grades, from the features' own odds on; thresholds are a first one and positive steps."""
    n, width = len(grades), int(marking.sum())
    x = np.concatenate([odds, [4.0], np.ones(GRADES - 2)])
    mean, square = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        thresholds = np.cumsum(np.concatenate([x[width : width + 1], np.exp(x[width + 1 :])]))
        above = _logistic(np.bincount(rows, x[columns], n)[:, None] - thresholds)
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slopes = edges * (1 - edges)
        each = np.arange(n)
        chance = np.maximum(edges[each, grades] - edges[each, grades + 1], 1e-12)
        low, high = slopes[each, grades] / chance * shares, slopes[each, grades + 1] / chance * shares
        by_score = high - low  # of the loss
        by_threshold = np.zeros(GRADES + 1)
        np.add.at(by_threshold, grades, low)
        np.add.at(by_threshold, grades + 1, -high)
        by_threshold = by_threshold[1:GRADES]
        later = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate(
            [
                np.bincount(columns, by_score[rows], width) + RIDGE * x[:width] / max(width, 1),
                later[:1],
                later[1:] * np.exp(x[width + 1 :]),
            ]
        )
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        x -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(2 * PLACES)
    weights[marking] = x[:width]
    return Model(weights, np.cumsum(np.concatenate([x[width : width + 1], np.exp(x[width + 1 :])])))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        per_label: int = TEXTS_PER_LABEL) -> Model:
    """Learn from the texts of ``docs`` that ``labels`` (``id_column``, ``label_column``) calls toxic or not."""
    key, place = F.col(f"`{id_column}`"), F.pmod(F.xxhash64(f"`{id_column}`"), F.lit(1 << 30))
    bad = F.col(f"`{label_column}`").cast("int")
    known = labels.where(bad.isNotNull() & key.isNotNull()).select(key.alias("id"), (bad != 0).alias("bad"), place.alias("place"))
    counts = {r.bad: r.n for r in known.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return NOTHING
    limits = {b: int(min(1.0, 1.3 * per_label / n) * (1 << 30)) for b, n in counts.items()}
    near = known.where(F.col("place") < F.when(F.col("bad"), limits[True]).otherwise(limits[False]))
    worst = {r.id: r.bad for r in near.groupBy("id").agg(F.max("bad").alias("bad")).collect()}
    # Repeated rows of an id count once, so that a row with many copies cannot outgrow the bound.
    chosen = docs.where(key.isin(list(worst))).select(key.alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at, raw, offsets in slices(batch, 1):
                rows, found = features.of(raw, offsets)
                rows, found = distinct(rows, found)
                bounds = np.searchsorted(rows, np.arange(len(offsets)))
                packed = [found[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                arrays = [batch.column(0).slice(at, len(packed)), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "places"])

    kind = chosen.schema["id"].dataType.simpleString()
    found = sorted((r.id, bytes(r.places)) for r in chosen.mapInArrow(places, f"id {kind}, places binary").collect())
    toxic = np.array([worst[i] for i, _ in found], bool)
    sample = {b: max(1, int((toxic == b).sum())) for b in (True, False)}
    shares = np.array([counts[b] / sample[b] for b in toxic.tolist()])
    model = fit_rows([np.frombuffer(p, np.int32) for _, p in found], toxic, shares)
    if model is NOTHING:
        warnings.warn(f"nothing marks the {int(toxic.sum())} toxic of {len(toxic)} labelled texts: no text will be called toxic", stacklevel=2)
    return model


def score(docs: DataFrame, model: Model, text_column: str = "text", keep: Sequence[str] = ("doc_id",),
          names: tuple[str, str] = ("severity", "toxic")) -> DataFrame:
    """The columns ``keep`` with ``severity``, the expected grade, and ``toxic``: more likely than not above grade 0.

    ``names`` are those of the two new columns, which ``keep`` must not hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    rows, at_text = docs.select(*[F.col(f"`{c}`") for c in keep]), len(keep)
    if text_column in keep and docs.schema[text_column].dataType == T.StringType():
        at_text = list(keep).index(text_column)  # once is enough
    else:
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").cast("string").alias("_text"))
    added = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for at, raw, offsets in slices(batch, at_text):
                n = len(offsets) - 1
                chances = shared.value.exceeding(*features.of(raw, offsets), n)
                columns = [batch.column(i).slice(at, n) for i in range(len(keep))]
                arrays = [*columns, pa.array(chances.sum(1)), pa.array(chances[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(run, schema)
