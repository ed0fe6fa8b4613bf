"""From raw documents to piece ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, jaccard_join, quality, sentencepiece_codec, substring_dedup
from tidelog.llm._session import dropped, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the ranker rejects, and those without text, go."""
    return quality.kept(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies the document with the least id stays."""
    return jaccard_join.without_copies(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: passages of 50 words or more that occur earlier are cut; a document that is nothing else goes."""
    return substring_dedup.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: piece ids and byte spans of what is left."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The first stage is a trained model, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table ``documents``; each stage's result is written and reread, and dropped when the next one is there.

    Rows without text go in the first stage; those without an id can't be told apart, so no later stage removes or cuts them. Of rows that repeat an id and
    text one stays. Columns beside those of ``documents`` pass all stages but the last, whatever their names. An empty table gives no rows.
    """
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            dropped(before)
    return docs
