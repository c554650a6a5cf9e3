"""Sources mixed by temperature: shares of tokens to a power, the power found by bisection, realised as passes over
permuted blocks.

The weight of a source is its share of tokens to the power alpha, normalised. Alpha 1 keeps the shares, alpha 0 makes
all sources equal. Alpha is bisected to the largest one whose weights reach a wanted entropy, and raised, if need be, until no source
is repeated more often than allowed; the repetition limit wins. The entropy is wanted as a part of the way from that of
the shares to the highest possible, so it binds on any sources that are not equal, or as a fraction of the highest.

The budget of tokens is dealt by the weights. A source whose budget is e times its tokens is passed over floor(e)
times and once more in part. Documents of a source fall into blocks by a hash of their id, more of them where there are more
documents. Each pass permutes the blocks by a bijection of its own and orders the documents of a block by a hash of its
own; ``position`` tells where a row stands in its pass, ``(block's place, document's place)`` in one number. The last
pass takes the rows up to where its budget ends: so many whole blocks, and in the next one documents up to a hash. That end is found
from the hashes and token counts alone, one row a document and no texts, and each source's end is one row.

By default the budget is the smallest that passes at least once over every source, so that no document is lost.

A null source is a source of its own. A null or empty text has no tokens but is dealt like others. Repeated rows are
documents of their own; rows with equal ids stand at one position and are taken together. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellsift.llm.common import staged

#: A block holds about so many documents, and a source as many blocks as that makes, a power of two; beyond the most its blocks grow.
BLOCK_DOCUMENTS = 64
MOST_BLOCKS = 1 << 16
_PLACE_BITS = 40  # of a position are for the document's place in its block


def token_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def weights_at(shares: list[float], alpha: float) -> list[float]:
    powers = [p**alpha if p > 0 else 0.0 for p in shares]
    total = sum(powers)
    return [p / total for p in powers] if total else [0.0 for _ in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def temperature(tokens: list[int], entropy_share: float | None = None, repeats: float | None = 2.0, budget: int | None = None,
                entropy_gain: float | None = 0.5, steps: int = 60) -> tuple[float, list[float], int]:
    """Alpha, weights and the budget of tokens for sources of so many tokens.

    The weights' entropy reaches ``entropy_share`` of the highest possible; without it, ``entropy_gain`` of what the shares lack of
    that; with neither alpha is 1.
    """
    total = sum(tokens)
    real = [t for t in tokens if t > 0]
    if not real:
        return 1.0, [0.0 for _ in tokens], 0
    shares = [t / total for t in tokens]
    highest = math.log(len(real))
    goal = None
    if entropy_share is not None:
        goal = entropy_share * highest
    elif entropy_gain is not None:
        goal = entropy(shares) + entropy_gain * (highest - entropy(shares)) - 1e-12

    def spent(weights: list[float]) -> int:
        if budget is not None:
            return budget
        return max(math.ceil(t / w) for t, w in zip(tokens, weights, strict=True) if t > 0)

    def most_repeated(alpha: float) -> float:
        weights = weights_at(shares, alpha)
        return max(spent(weights) * w / t for t, w in zip(tokens, weights, strict=True) if t > 0)

    def bisected(holds, inside: float, outside: float) -> float:
        """The alpha nearest to ``outside`` that holds, where it holds at ``inside`` and from there up to some alpha."""
        if holds(outside):
            return outside
        for _ in range(steps):
            middle = (inside + outside) / 2
            inside, outside = (middle, outside) if holds(middle) else (inside, middle)
        return inside

    alpha = 1.0 if goal is None else bisected(lambda a: entropy(weights_at(shares, a)) >= goal, 0.0, 1.0)
    if repeats is not None and most_repeated(alpha) > repeats:
        alpha = bisected(lambda a: most_repeated(a) <= repeats, 1.0, alpha)
    weights = weights_at(shares, alpha)
    return alpha, weights, spent(weights)


def _scrambled(h: Column, number: Column) -> Column:
    return F.xxhash64(h, number.cast("long"))


def block_place(block: Column, number: Column, blocks: Column) -> Column:
    """Place of a block in pass ``number``: a bijection of 0 to ``blocks`` - 1, which is a power of two.

    Each round multiplies by an odd number, adds another and folds the high half onto the low one, all modulo ``blocks``.
    """
    mask, half = blocks - 1, (F.length(F.bin(blocks)) / 2).cast("int")
    x = block
    for salt in (1, 2, 3):
        key = F.xxhash64(F.lit(salt), number.cast("long"))
        odd = F.shiftleft(key.bitwiseAND(0x7FFF), 1) + 1
        x = (x * odd + F.shiftright(key, 20).bitwiseAND(0xFFFF)).bitwiseAND(mask)
        x = x.bitwiseXOR(F.call_function("shiftrightunsigned", x, F.greatest(half, F.lit(1))))
    return x


def mix(docs: DataFrame, source_column: str = "source", id_column: str = "doc_id", text_column: str = "text",
        names: tuple[str, ...] = ("tokens", "weight", "pass", "position"), **goals: float | int | None) -> DataFrame:
    """The columns of ``docs`` with ``tokens``, ``weight`` of the source, ``pass`` from 0 and ``position``, by which the rows of a source's pass
    are to be ordered; one row for each pass over a document.

    ``goals`` are those of ``temperature``. ``names`` are those of the new columns, the last of which may be left out;
    columns of ``docs`` that have these names are replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in names]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)],
        token_count(F.col(f"`{text_column}`")).alias("_words"),
        F.col(f"`{source_column}`").alias("_source"),
        F.xxhash64(F.col(f"`{id_column}`")).alias("_hash"),
    )
    thin = staged(rows.groupBy("_source", "_hash").agg(F.sum("_words").alias("_words"), F.count("*").alias("_n")), "mix-documents")
    # One row a source comes to the driver.
    found = thin.groupBy("_source").agg(F.sum("_words").alias("tokens"), F.sum("_n").alias("n")).collect()
    _, weights, budget = temperature([r.tokens for r in found], **goals)
    dealt = []
    for r, w in zip(found, weights, strict=True):
        whole, rest = divmod(math.floor(w * budget + 1e-6), r.tokens) if r.tokens else (1, 0)
        blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(r.n / BLOCK_DOCUMENTS) - 1).bit_length())
        dealt.append((r._source, float(w), whole, rest, blocks))
    kind = docs.schema[source_column].dataType.simpleString()
    plan = spark.createDataFrame(dealt, f"_source {kind}, _weight double, _whole long, _rest long, _blocks long")
    ends = _ends(thin, plan)

    same = F.col("r._source").eqNullSafe(F.col("p._source"))
    joined = rows.alias("r").join(F.broadcast(ends).alias("p"), same)  # a row a source
    last = F.when(F.col("_at") < F.col("_end"), 1).when((F.col("_at") == F.col("_end")) & (F.col("_place") <= F.col("_end_place")), 1).otherwise(0)
    at, place = _stands(F.col("_whole"))
    joined = joined.select("r.*", "_weight", "_whole", "_blocks", "_end", "_end_place", at.alias("_at"), place.alias("_place")).withColumn("_last", last)
    passes = F.expr("if(_whole + _last > 0, sequence(0, cast(_whole + _last - 1 as int)), cast(array() as array<int>))")
    spread = joined.withColumn("_pass", F.explode(passes))
    at, place = _stands(F.col("_pass"))
    new = [F.col("_words"), F.col("_weight"), F.col("_pass"), F.shiftleft(at, _PLACE_BITS) + place]
    return spread.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], *[c.alias(n) for c, n in zip(new, names, strict=False)])


def _stands(number: Column) -> tuple[Column, Column]:
    """Places of a row's block and of the row in it, in pass ``number``."""
    block = F.pmod(F.col("_hash"), F.col("_blocks"))
    place = _scrambled(F.col("_hash"), number).bitwiseAND((1 << _PLACE_BITS) - 1)
    return block_place(block, number, F.col("_blocks")), place


def _ends(thin: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with ``_end``, the place of the block in which a source's last pass ends, and ``_end_place``, the last place taken there."""
    same = F.col("t._source").eqNullSafe(F.col("p._source"))
    at, place = _stands(F.col("_whole"))
    placed = thin.alias("t").join(F.broadcast(plan).alias("p"), same).where("_rest > 0").select(
        "t._source", "_words", "_rest", at.alias("_at"), place.alias("_place")
    )
    order = W.partitionBy("_source").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = placed.groupBy("_source", "_rest", "_at").agg(F.sum("_words").alias("_here")).withColumn("_upto", F.sum("_here").over(order))
    # The first block that does not fit whole, and what is left for it; a rest is less than a source's tokens, so there is one.
    ends = blocks.where("_upto > _rest").groupBy("_source").agg(
        F.min("_at").alias("_end"), F.min_by(F.col("_rest") - F.col("_upto") + F.col("_here"), "_at").alias("_left")
    )
    ends = staged(ends, "mix-ends")
    both = F.col("t._source").eqNullSafe(F.col("e._source")) & (F.col("t._at") == F.col("e._end"))
    inside = placed.alias("t").join(F.broadcast(ends).alias("e"), both).groupBy("e._source", "_left", "_place").agg(F.sum("_words").alias("_here"))
    order = W.partitionBy("_source").orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    fitting = inside.withColumn("_upto", F.sum("_here").over(order)).where("_upto <= _left").groupBy("_source").agg(F.max("_place").alias("_end_place"))
    known = ends.alias("a").join(fitting.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source")), "left").select(
        F.col("a._source").alias("_source"), "_end", F.coalesce("_end_place", F.lit(-1).cast("long")).alias("_end_place")
    )
    joined = plan.alias("p").join(known.alias("k"), F.col("p._source").eqNullSafe(F.col("k._source")), "left")
    return staged(joined.select("p.*", F.coalesce("_end", F.lit(-1).cast("long")).alias("_end"), F.coalesce("_end_place", F.lit(-1).cast("long")).alias("_end_place")), "mix-plan")
