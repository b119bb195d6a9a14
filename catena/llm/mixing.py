"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a shuffled order; a document's virtual
finish time is the source's tokens so far, divided by the source's target.
Documents of all sources, with their repetitions, are ranked by that time and
the ranking is cut where the budget (all tokens there are) is used up.

Only DataFrame operations are used.  Running sums over a source do not meet in
one task: the shuffled order is cut into slots, slots are summed first,
and each slot continues from the sum of the slots before it.  The same holds for
the ranking, whose slots are ranges of virtual time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catena.llm import base

#: A document is taken at most this often, so no target exceeds it times the source.
PASSES = 3
#: The weights of sources in code point order, repeated.
WEIGHTS = (1, 2, 3)
SEED = 42
#: Rows up to which the small tables by source (and slot) are broadcast once they were counted; larger ones are joined by shuffles.
BROADCAST_ROWS = 100_000
#: Documents that a slot of the shuffled order, or a range of finish times, should hold, and the fewest and most slots.
SLOT_ROWS, LEAST_SLOTS, MOST_SLOTS = 16_384, 256, 1 << 22


def tokens_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(base.WORD)), F.lit(0)).cast("long")


def shuffled(doc_id: Column, seed: int = SEED) -> Column:
    """A key that orders documents at random, the same in each run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Targets share the total by weight.  A target above ``passes`` times its
    source stops there and the excess is shared anew by weight until none is
    above.  That has a closed form: in order of room per weight, a source is
    capped exactly if the level of all sources from it on would exceed its room.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = sizes.withColumn("weight", weight).withColumns({"cap": F.col("source_size") * passes, "room": F.col("source_size") * passes / F.col("weight")})
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    table = table.withColumns({"level": level, "total": total}).withColumn("capped", F.col("room") <= F.col("level"))
    free = [F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)]
    share = F.col("weight") * (F.col("total") - free[1]) / free[0]
    return table.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"), "total")


def _by_source(rows: DataFrame, small: DataFrame, few: bool, *more: str) -> DataFrame:
    """Join on source (null equals null); ``small`` is broadcast only if its rows were counted to be few."""
    small = small.withColumnRenamed("source", "__source")
    match = F.col("source").eqNullSafe(F.col("__source"))
    for c in more:
        small = small.withColumnRenamed(c, f"__{c}")
        match = match & (F.col(c) == F.col(f"__{c}"))
    return rows.join(F.broadcast(small) if few else small, match, "left").drop("__source", *[f"__{c}" for c in more])


def plan(docs: DataFrame, passes: int = PASSES, seed: int = SEED, slots: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """The documents' sizes and order keys, the cut of each source, and whether sources are few.

    The cut of a source is where the ranking's end meets its shuffled order: the turn, the key and the row of the last
    document it takes.  The shuffled order has ``slots`` slots, by default as many as hold 16,384 documents each, and as
    many ranges of finish times; the ranking's end falls in one range, which alone is sorted as a whole.
    """
    meta = base.store(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), tokens_of(F.col("text")).alias("size"), shuffled(F.col("doc_id"), seed).alias("key")), "sizes")
    if slots is None:
        slots = min(MOST_SLOTS, max(LEAST_SLOTS, meta.count() // SLOT_ROWS))
    ranges = max(4096, slots)
    meta = meta.withColumn("slot", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slots / (1 << 32)).cast("int"))
    in_slot = base.store(meta.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")), "slots")
    wanted = base.store(targets(in_slot.groupBy("source").agg(F.sum("slot_size").alias("source_size"))), "targets")
    few = wanted.count() <= BROADCAST_ROWS
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = in_slot.select("source", "slot", F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("begin"))
    ranked = _by_source(_by_source(meta, begins, in_slot.count() <= BROADCAST_ROWS, "slot"), wanted, few)
    order = Window.partitionBy("source", "slot").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("so_far", F.col("begin") + F.sum("size").over(order)).where("target > 0")
    ranked = ranked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    ranked = ranked.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("so_far")) / F.col("target"))
    ranked = base.store(ranked.select("source", "key", "doc_id", "size", "turn", "finish", "total"), "ranked")
    # Finish times up to 2 are cut into fine ranges; what lies above shares one more.
    ranged = ranked.withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(2 * ranges)))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("in_range"), F.first("total").alias("total"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_begin", F.coalesce(F.sum("in_range").over(upto), F.lit(0)))
    # The one range in which the budget ends; ranges before it are taken whole.
    edge = sums.where((F.col("range_begin") <= F.col("total")) & (F.col("range_begin") + F.col("in_range") > F.col("total"))).head()
    at, begin = (edge["range"], edge["range_begin"]) if edge else (-1, 0)
    whole = ranged.where(F.col("range") < at)
    line = Window.orderBy("finish", F.col("source").asc_nulls_last(), "turn", "key", F.col("doc_id").asc_nulls_first(), "size")
    part = ranged.where(F.col("range") == at).withColumn("used", F.lit(begin) + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).where("used <= total").drop("used")
    last = F.max(F.struct("turn", "key", F.col("doc_id").isNotNull().alias("named"), "doc_id", "size")).alias("last")
    cuts = whole.unionByName(part).groupBy("source").agg(last)
    cuts = base.store(_by_source(wanted.select("source", "source_size", "target"), cuts, few), "cuts")
    return meta, cuts, few


def taken(rows: DataFrame, cuts: DataFrame, few: bool, passes: int = PASSES) -> DataFrame:
    """Add ``source_size, target, copies`` to rows that have ``source, key, doc_id, size``."""
    rows = _by_source(rows, cuts, few)
    here = F.struct(F.col("key").alias("key"), F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))
    end = F.struct(F.col("last.key").alias("key"), F.col("last.named").alias("named"), F.col("last.doc_id").alias("doc_id"), F.col("last.size").alias("size"))
    copies = F.col("last.turn") + F.when(here <= end, 1).otherwise(0)
    return rows.withColumn("copies", F.coalesce(F.least(copies, F.lit(passes)), F.lit(0)).cast("long")).drop("last")


def mix(docs: DataFrame, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """The mixture: each document as many times as it is taken, with all its columns.

    Words of whole texts are counted.  Null text has no words; a document without words comes with its neighbours
    in the shuffled order.  Null is a source of its own, the last one.  Rows that
    repeat a doc_id with as many words share a place.  Sources without any words have target
    0 and nothing is taken of them.  An empty table gives an empty mixture.
    """
    _, cuts, few = plan(docs, passes, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens_of(F.col("text")).alias("size"), shuffled(F.col("doc_id"), seed).alias("key"))
    chosen = taken(rows, cuts, few, passes).where("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def report(docs: DataFrame, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repetitions counted); rules as for ``mix``."""
    meta, cuts, few = plan(docs, passes, seed)
    return taken(meta, cuts, few, passes).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB's form of ``report`` over documents with distinct ids.
SQL = r"""
WITH meta AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('42:' || CAST(doc_id AS VARCHAR)) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM meta GROUP BY source),
r AS (SELECT *, source_size * 3 AS cap, source_size * 3 / weight AS room, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
l AS (SELECT *, room <= (total - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM r),
t AS (SELECT source, source_size, total, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target FROM l),
o AS (SELECT meta.doc_id, meta.source, size, key, source_size, target, total,
             sum(size) OVER (PARTITION BY meta.source ORDER BY key, meta.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
      FROM meta JOIN t ON meta.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (turn * source_size + so_far) / target AS finish FROM o, (SELECT unnest([0, 1, 2]) AS turn) WHERE target > 0),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= total AS inside FROM c),
n AS (SELECT doc_id, sum(CASE WHEN inside THEN size ELSE 0 END) AS taken FROM q GROUP BY doc_id)
SELECT o.doc_id, o.size, o.source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(n.taken, 0) AS BIGINT) AS taken FROM o LEFT JOIN n ON n.doc_id = o.doc_id
"""
