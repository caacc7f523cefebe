"""A training-data pipeline over `documents`, each stage one operator of millrace.llm.

Stages are written as Parquet and read again. Quality and language drop the documents that they reject, near-duplicates
keep one document of each group, mixing repeats documents by their source's rate, and the last stage encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import factor_quality, piece_codec, poisson_mix, segment_langid, simhash_dedup
from millrace.llm.common import cut, discard
from millrace.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Jaccard similarity of five-word shingle sets from which documents count as near-duplicates, beside the fingerprints' links.
SIMILARITY = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    machine = factor_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = factor_quality.score(docs.select(*COLUMNS), machine)
    return scored.filter(F.col("quality_score") >= factor_quality.THRESHOLD).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, and all where no language could be learned, go."""
    languages = segment_langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = segment_langid.identify(docs.select(*COLUMNS), languages, COLUMNS)
    return found.filter(F.col("lang_pred") != segment_langid.UNDETERMINED).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document, of its smallest doc_id."""
    return simhash_dedup.keep_one(docs.select(*COLUMNS), similarity=SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the draw of their source's rate says, in global random order."""
    return poisson_mix.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the digests of ids and decoded text of each copy."""
    return piece_codec.digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "source"])


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The classifiers, SimHash and the tokenizer can't be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one stands."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
