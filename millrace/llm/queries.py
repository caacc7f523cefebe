"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import digit_whitening, factor_quality, interpolated_lm, kd_shards, piece_codec, pivot_topk, poisson_mix, prefix_forest, prefix_trie, segment_langid, simhash_dedup, warc_bundles, wrapper_induction
from millrace.llm.common import fold
from millrace.session import table

SHARDS = 40
PIECE_MODEL = "piece_bpe_32k.model"


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op2_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    scored = interpolated_lm.score(docs, crc % 7 != 2, F.floor(crc / 7) % 8 == 3, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_bundles.archive_folder(spark)
    index = warc_bundles.write(table(spark, sf_dir, "pages"), folder)
    return warc_bundles.read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = factor_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = factor_quality.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= factor_quality.THRESHOLD).cast("int").alias("predicted"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_segment_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = segment_langid.fit(docs, public_tokenizers.path(PIECE_MODEL))
    found = segment_langid.identify(docs, languages, ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), ["doc_id"])


def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_chars", F.col("mix_copy").alias("copy"), F.col("mix_rate").alias("rate"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_digit_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digit_whitening.whiten(table(spark, sf_dir, "embeddings")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {f.__name__: f for f in (op1_pivot_topk, op2_interpolated_lm, op3_warc_bundles, op4_factor_quality, op5_kd_shards, op6_simhash_dedup, op7_segment_langid, op8_piece_codec, op9_prefix_forest, op10_poisson_mix, op11_prefix_trie, op12_digit_whitening, op13_wrapper_induction)}

ORACLES = {
    "op1_pivot_topk": """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id::BIGINT AS id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rn AS query_row, q.id AS query_id, c.id AS vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.id % 100 = 0 AND c.rn <> q.rn)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
""",
    "op3_warc_bundles": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes < 100 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) = 1 AS is_first, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN is_first THEN NULL ELSE first END AS refers_to FROM f
""",
    "op10_poisson_mix": """
WITH sizes AS (SELECT source, sum(coalesce(n_chars, 0))::BIGINT AS size FROM documents GROUP BY source),
wanted AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size::DOUBLE, 0.5) ELSE 0.0 END AS want FROM sizes),
sums AS (SELECT sum(want) AS w, sum(size)::DOUBLE AS s FROM wanted),
rates AS (SELECT source AS src, round(CASE WHEN size > 0 AND w > 0 THEN want / w * s / size ELSE 0.0 END, 9) AS rate FROM wanted, sums),
parts AS (SELECT src, rate, greatest(1, ceil(rate / 16.0))::INT AS parts FROM rates WHERE rate > 0),
terms AS (SELECT src, k, sum(exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS c
          FROM parts, range(0, 81) AS r(k)),
tables AS (SELECT src, list(c ORDER BY k) AS cs FROM terms GROUP BY src),
draws AS (SELECT d.doc_id, d.source, d.n_chars, p.rate, t.cs, p.parts FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.src
          JOIN tables t ON t.src IS NOT DISTINCT FROM p.src),
counted AS (SELECT doc_id, source, n_chars, rate, list_sum([
              len([c FOR c IN cs IF c <= ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/17/' || part::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0])
              FOR part IN range(1, parts + 1)]) AS n FROM draws)
SELECT doc_id, source, n_chars, unnest(range(1, n::BIGINT + 1))::INT AS copy, rate FROM counted WHERE n > 0
""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id AS c, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) AS h,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'h': h, 'w': w} ORDER BY turn NULLS FIRST, h) AS ts FROM t GROUP BY c),
crc AS (SELECT c, ts, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')]),
          lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 4 AS h FROM o),
r AS (SELECT a.c, list_concat(coalesce(g.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM crc a LEFT JOIN o g ON g.c = a.b),
m AS (SELECT c, len(ts) AS n, d, md5(array_to_string([x.h FOR x IN ts[1:d]], ',')) AS k, md5(array_to_string([x.h FOR x IN ts[1:d - 1]], ',')) AS pk, ts[d].w AS w
      FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
nodes AS (SELECT d, k, any_value(pk) AS pk, min(c) AS c, count(*) AS n, coalesce(any_value(w), 0) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM m GROUP BY d, k),
kids AS (SELECT p.d, p.k, count(x.k) AS n FROM nodes p LEFT JOIN nodes x ON x.d = p.d + 1 AND x.pk = p.k GROUP BY p.d, p.k),
below AS (SELECT m.d, m.k, sum((u.n - 1) * u.w)::BIGINT AS saved, count(*) FILTER (kids.n = 0) AS leaves
          FROM m JOIN nodes u ON u.c = m.c AND u.d >= m.d JOIN kids ON kids.d = u.d AND kids.k = u.k GROUP BY m.d, m.k)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, p.c AS parent_conv_id, v.n AS n_convs, kids.n AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN kids USING (d, k) JOIN below b USING (d, k) LEFT JOIN nodes p ON v.d > 0 AND p.d = v.d - 1 AND p.k = v.pk
""",
}
