"""Corpus pipeline: toxicity, quality, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents its
predecessor kept; ``run`` writes a stage's result as Parquet to the shared
folder and reads it back as the next one's documents.  All stages but the last return
the columns of ``documents``; the last returns the documents as piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanframe.llm import decontam, neardup, pieces, quality
from loanframe.llm import toxicity as tox
from loanframe.llm.common import stored, table


def _packed(docs: DataFrame) -> DataFrame:
    """All columns but the text in one, so that no name can clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("_row"), F.col("text").alias("_text"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model rejects (probability of at least 0.3)."""
    model = tox.trained(docs, table(spark, sf_dir, "labels"))
    scored = tox.score(_packed(docs), model, "_row", "_text", keep=["_text"])
    return _unpacked(scored.where(F.col("score") < tox.THRESHOLD), docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (probability below 0.5)."""
    vectors, network = quality.trained(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(_packed(docs), vectors, network, "_row", "_text", keep=["_text"])
    return _unpacked(scored.where(F.col("score") >= quality.THRESHOLD), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return neardup.keep_one(docs, width=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; documents that are mostly benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the text they decode to and the second and third best segmentation."""
    out = pieces.encode(docs, pieces.vocabulary(), n=3, decoded="text")
    return out.select("doc_id", "text", "ids", "n_pieces", "score", "alternatives")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", segment),
]

#: SQL can't express the trained stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per kept document, with the alternatives of its segmentation."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
