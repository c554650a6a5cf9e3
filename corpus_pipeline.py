"""A training corpus from raw documents, stage by stage.

Toxic documents go, one document of each group of near copies stays, secrets are masked in the texts, sources are
mixed by temperature so that no document is lost and none comes more than twice, and what is left becomes token ids, which
are decoded again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellsift.llm import bpe, mixing, near_dups, secrets, toxicity
from cellsift.llm.common import staged, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Passes over a document at most.
REPEATS = 2.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the regression, learnt from ``labels``, does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=docs.columns, names=("_severity", "_toxic"))
    return scored.where("not _toxic").select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the smallest id. Equal rows of one id are one document."""
    found = staged(near_dups.near_duplicates(docs), "pipeline-groups")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*_columns(docs))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by its kind in brackets; documents without secrets stay as they are."""
    found = secrets.find(docs, keep=docs.columns, out_column="_spans")
    masked = found.withColumn("_masked", secrets.redact(F.col("text"), F.col("_spans")))
    length = F.when(F.size("_spans") > 0, F.char_length("_masked").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("_masked"), "n_chars": length}
    return masked.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources weigh more: their documents come up to ``REPEATS`` times, all others once."""
    return mixing.mix(docs, names=("_tokens", "_weight", "_pass"), repeats=REPEATS).select(*_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every text, and the digest of the bytes that the ids stand for."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, out_column="decoded")
    return encoded.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: No SQL can express the regression, the signatures and the merges; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
