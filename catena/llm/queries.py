"""The operators of this subpackage over the whole tables, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catena.llm import base, exact_dedup, mixing, packing, quality, records, secret_scan, simhash, substring_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents with the forest's verdict: ``secret_scan.scan``."""
    docs = table(spark, sf_dir, "documents")
    forest = secret_scan.fit(secret_scan.labelled_findings(), language=secret_scan.learn_language(docs))
    return secret_scan.scan(docs, forest, path="source")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document: ``exact_dedup.annotate``, which states what nulls, ties, repeated rows and empty tables give."""
    return exact_dedup.annotate(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, the field trained on the table's labels: ``quality.assess``."""
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the record files: ``records.write``, ``records.digest``."""
    folder = base.shared_folder(spark, "token-records")
    index = records.write(table(spark, sf_dir, "documents"), folder)
    return records.digest(spark, folder, index)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents: ``packing.pack``."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: ``substring_dedup.remove_repeats`` with windows of 50 words."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document: ``mixing.report``."""
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, the network trained on the labels that are not held out: ``toxicity.score``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: ``simhash.near_duplicates``."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as read back from the archives: ``warc.write``, ``warc.read``."""
    folder = base.shared_folder(spark, "warc")
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_exact_dedup, op3_quality_rules, op4_token_records, op5_packing, op6_substring_dedup, op7_mixing, op8_toxicity, op9_simhash, op10_warc)
}

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op6_substring_dedup": substring_dedup.SQL, "op7_mixing": mixing.SQL, "op10_warc": warc.SQL}
