"""The corpus operators over their whole tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import chat, decontaminate, fingerprints, jaccard_join, lm_scoring, quality, sentencepiece_codec, sharding, substring_dedup, token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids and original byte spans of every document."""
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"))


@_query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of the corpus in its slot of the training order, in the shard files that are written on the way."""
    return token_shards.materialised(_table(spark, sf_dir, "documents"))


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of those whose word 3-gram sets are at least half alike, and the number it is linked to."""
    return jaccard_join.similar_classes(_table(spark, sf_dir, "documents"))


ORACLE["op3_jaccard_join"] = jaccard_join.SIMILAR_CLASSES_SQL


@_query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locally consistent phrase names of every document."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document that repeat 50 words or more of what comes before (``kept`` false: these can be cut), and where they occur first (``kept`` true)."""
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


ORACLE["op5_substring_dedup"] = substring_dedup.REPEATED_SPANS_SQL


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, bytes, tokens and rows balanced jointly."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@_query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability and perplexity of every document under an interpolated trigram model of the corpus."""
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document by a ranker trained on the labelled ones."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training example for every assistant turn."""
    return chat.prefix_targets(_table(spark, sf_dir, "conversations"))


ORACLE["op9_chat"] = chat.PREFIX_TARGETS_SQL


@_query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains, whole or nearly so."""
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE["op10_decontamination"] = decontaminate.CONTAMINATIONS_SQL
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
