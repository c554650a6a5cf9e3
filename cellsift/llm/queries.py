"""One query per operator, over the whole of its table, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellsift.llm import bpe, ctph, language, mixing, multi_index, near_dups, packing, prefix_trie, secrets, shards, style_tree, toxicity, whitening
from cellsift.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, out_column="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edit_report(table(spark, sf_dir, "documents"))


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    held = docs.select("doc_id", "text", language.held_out().alias("held_out"))
    return language.predict(held, model, keep=("doc_id", "held_out"))


def op6_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = style_tree.main_text(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "tokens", "weight", "pass", "position")


def op9_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
#: All pairs that share a shingle, counted; then what can be reached.
OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c
 FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT r.x, l.b FROM reach AS r JOIN both_ways AS l ON r.y = l.a),
c AS (SELECT x, min(least(x, y)) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(y, doc_id) AS component_id, coalesce(y, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON doc_id = x"""


def _rule_sql(number: int, rule: secrets.Rule) -> str:
    pattern = "'" + rule.java.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least, regexp_split_to_array(t, {pattern}) AS gaps, "
        f"regexp_extract_all(t, {pattern}, 0) AS found, regexp_extract_all(t, {pattern}, {rule.group}) AS tested FROM d"
    )


#: Each pattern over each text; places are the lengths of what stands before.
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(_rule_sql(i, rule) for i, rule in enumerate(secrets.RULES))}),
m AS (SELECT doc_id, number, kind, least, gaps, found, tested, unnest(range(1, len(found) + 1)) AS i FROM r WHERE len(found) > 0),
p AS (SELECT doc_id, number, kind, length(found[i]) AS n,
 CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) AS BIGINT)
 + CAST(coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM m WHERE length(tested[i]) >= least),
s AS (SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
 coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, number) FILTER (number < 3), '') AS base,
 string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, number) AS spans FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["number"] < len(secrets.BASE))

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["number"] == number)).cast("long").alias(f"n_{kind}")

    counts = [count(i, rule.kind) for i, rule in enumerate(secrets.BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, sf_dir, "embeddings"), 32)
    shares = [] if model is None else (model.values / model.trace).tolist()
    explained = F.array(*[F.lit(s) for s in shares]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.centre.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


def op12_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


#: CRC-32 of the decimal digits of c, bit by bit.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda g: CAST(ascii(g) AS BIGINT))),
 lambda a, g: list_reduce([xor(a, g), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""
#: Every prefix of every rebuilt conversation as a list of turns, grouped; subtrees are the prefixes that begin alike.
OP13_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS s FROM t GROUP BY c),
h AS (SELECT c, s, c - c % 100 AS b, CAST({_CRC_SQL} % 6 AS BIGINT) AS h FROM s),
r AS (SELECT h.c AS c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN s AS b ON b.c = h.b),
p AS (SELECT c, len(s) AS l, s, unnest(range(0, len(s) + 1)) AS d FROM r),
n AS (SELECT s[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs,
 sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
f AS (SELECT n.*, coalesce(m, 0) AS n_children, CAST(m IS NULL AS BIGINT) AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(k[d].x) END AS own
 FROM n LEFT JOIN (SELECT k[1:d - 1] AS k, count(*) AS m FROM n WHERE d > 0 GROUP BY ALL) USING (k)),
u AS (SELECT k[1:a] AS k, sum(leaf) AS leaves, sum(own) AS saved FROM (SELECT k, leaf, own, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (k) LEFT JOIN n AS up ON f.d > 0 AND up.k = f.k[1:f.d - 1]"""


def op13_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_prefixes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_multi_index": (op1_multi_index, None),
    "op2_byte_bpe": (op2_byte_bpe, None),
    "op3_cumulative_link": (op3_cumulative_link, None),
    "op4_piecewise_hash": (op4_piecewise_hash, None),
    "op5_string_kernel": (op5_string_kernel, None),
    "op6_style_tree": (op6_style_tree, None),
    "op7_minimax_shards": (op7_minimax_shards, None),
    "op8_temperature_mixing": (op8_temperature_mixing, None),
    "op9_coordinate_join": (op9_coordinate_join, OP9_SQL),
    "op10_trigram_secrets": (op10_trigram_secrets, OP10_SQL),
    "op11_chebyshev_whitening": (op11_chebyshev_whitening, None),
    "op12_harmonic_packing": (op12_harmonic_packing, None),
    "op13_burst_trie": (op13_burst_trie, OP13_SQL),
}
