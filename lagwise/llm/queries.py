"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, fingerprints, lines, nearest, packing, phrases, pii, sharding, simhash, substrings, toxicity, whitening
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_avi_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(documents(spark, sf_dir))


def op3_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).where("doc_id is not null")
    return lines.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=8)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_toxicity_scores, op2_avi_clips, op3_repeated_words, op4_line_windows, op5_bpe_round_trip, op6_bottom_k, op7_jump_shards, op8_best_fit_packing, op9_pii_spans, op10_simhash_components, op11_embedding_links, op12_embedding_whitening, op13_phrase_collocations)
}
ORACLES: dict[str, str] = {"op3_repeated_words": substrings.ORACLE, "op4_line_windows": lines.ORACLE, "op13_phrase_collocations": phrases.ORACLE}
