"""A corpus pipeline of operators from ``catena.llm``, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor
kept, and returns the columns of ``documents``; the last one returns packed pieces.
``run`` writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catena.llm import base, exact_dedup, mixing, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go; it is trained on the labels of the documents at hand.

    Null and empty texts have one score, so all of them stay or go; repeated rows and rows without a doc_id are judged
    like any other.  Without labels to learn from every document stays.  An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of white space count as one space, null as empty) the smallest doc_id stays, null last.

    Of rows that repeat that doc_id one stays, the same each time.  An empty table stays empty.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over 5-word shingles the smallest doc_id stays, null last.

    Candidates come from SimHash fingerprints by vantage-point trees, links are decided by the shingles.  Null counts as empty, texts without words are
    equal; of rows that repeat text and doc_id one stays.  An empty table stays empty.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document comes as often as the mixture takes it.

    Null is a source of its own; documents without words come with their neighbours; rows that repeat a doc_id with as many words share
    a place.  An empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence and offset of each.

    Null text is packed as the end id alone; repeated rows and rows without a doc_id are documents of their own.  An
    empty table gives no piece.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, near copies and packing can't be written in SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = base.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
