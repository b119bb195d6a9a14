"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary of each partition finds the digests that may be frequent;
their exact counts and winners are counted over all rows (verification), and
the winners, at most ``counters`` of them, are broadcast so that the copies of
a frequent text are settled where they are read.  All other digests meet in an
ordinary shuffle: a grouped minimum that combines before the shuffle finds each winner, and only digests that
come twice or more are joined back to their rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catena.llm import base

#: Counters of each summary and, with that, the most rows that are broadcast (32 bytes of digest and 3 numbers each).
COUNTERS = 1024
WINNER = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        T.StructField("first", T.StructType([T.StructField("unnamed", T.BooleanType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType())])),
        T.StructField("copies", T.LongType()),
    ]
)


def digest_of(text: Column) -> Column:
    """SHA-256 of the text (null: empty) with each run of white space as one space."""
    normal = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), base.SPACE, " ")
    return F.unhex(F.sha2(normal.cast("binary"), 256))


def add_counts(counts: dict, found: Iterable[tuple], counters: int) -> dict:
    """Merge counts into a Misra-Gries summary and cut it back to ``counters`` entries."""
    for key, n in found:
        counts[key] = counts.get(key, 0) + n
    if len(counts) <= counters:
        return counts
    excess = heapq.nlargest(counters + 1, counts.values())[-1]
    return {k: n - excess for k, n in counts.items() if n > excess}


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest, estimate``: every digest with over ``2 * rows / (counters + 1)`` rows is among them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            found = pc.value_counts(batch.column("digest"))
            counts = add_counts(counts, zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "estimate"])

    rows = digests.select("digest")
    return rows.mapInArrow(base.trimmed(summarise), "digest binary, estimate long").groupBy("digest").agg(F.sum("estimate").alias("estimate"))


def _first() -> Column:
    """Orders rows: smallest doc_id, null last; of repeated ids the row that is read first."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("row"))


def winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Frequent digests with their first row and exact count, at most ``counters`` rows, as a local table."""
    spark = digests.sparkSession
    rows = digests.count()
    candidates = frequent_candidates(digests, counters).where(F.col("estimate") > rows / (counters + 1))
    # Estimates never exceed true counts, so at most `counters` of them can pass; the limit states that bound.
    few = candidates.orderBy(F.desc("estimate"), "digest").limit(counters).select("digest").collect()
    if not few:
        return spark.createDataFrame([], WINNER)
    small = spark.createDataFrame([tuple(r) for r in few], "digest binary")
    exact = digests.join(F.broadcast(small), "digest").groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("copies"))
    return spark.createDataFrame(exact.where("copies > 1").collect(), WINNER)


def annotate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of white space
    became one space; whole texts of any length are digested.  Null text counts as empty; all empty texts are one
    group.  The smallest doc_id stays, null ids come last; of rows that repeat
    the winning doc_id one row stays.  Other columns are ignored; an empty
    table gives an empty result.
    """
    digests = base.store(docs.select(F.col("doc_id").cast("long"), digest_of(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    frequent = winners(digests, counters)
    split = digests.join(F.broadcast(frequent), "digest", "left")
    rest = split.where("first IS NULL").drop("first", "copies")
    again = rest.groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    alone = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    rare = rest.join(again, "digest", "left").withColumns({"first": F.coalesce("first", alone), "copies": F.coalesce("copies", F.lit(1))})
    both = split.where("first IS NOT NULL").unionByName(rare)
    return both.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("copies").cast("long").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with all their columns (rules as for ``annotate``).

    Of rows that repeat the winning doc_id the one with the smallest hash of all columns stays.
    Copies of frequent texts are dropped before the shuffle, all but those with the
    winner's id; the others meet by digest, at most one of each task, as the first place is looked for in each task before the shuffle.
    """
    digests = base.store(docs.select(F.col("doc_id").cast("long"), digest_of(F.col("text")).alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")
    best = winners(digests, counters).select("digest", F.col("first.doc_id").alias("winner"), F.lit(True).alias("frequent"))
    # The row travels as one struct, so its columns may have any names.
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.xxhash64(*plain).alias("tie"))
    rows = rows.join(F.broadcast(best), "digest", "left").where(F.col("frequent").isNull() | F.col("doc_id").eqNullSafe(F.col("winner")))
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")


#: DuckDB's form of ``annotate`` over documents with distinct ids.
SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
