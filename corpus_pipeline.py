"""From raw documents to checked token digests: reject, deduplicate, mix, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from titleflow.llm import exact, mixing, piece_codec, queries, simhash, toxicity
from titleflow.llm.common import documents, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score 0.5 or more; nothing is learned from held-out labels."""
    return toxicity.reject(docs, queries.toxicity_classifier(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest id stays."""
    return exact.dedup(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near fingerprints connect, the one with the smallest id stays."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flattens the mix of sources as far as ``MAX_EPOCHS`` allows. Every document stays once at least; documents
    of small sources come again in later epochs, as rows of their own."""
    return mixing.repeat(docs, max_epochs=queries.MAX_EPOCHS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every row's text and of the text that these ids stand for."""
    return queries.piece_digests(piece_codec.round_trip(docs, queries.vocabulary(queries.PIECE_VOCABULARY)))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express learning from text; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
