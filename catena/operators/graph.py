"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.storage import store


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``) that is not itself the smallest of its component; that one is the root.

    Alternates two steps that keep components as they are (Kiveris et al. 2014):
    each node's larger neighbours, then its smaller ones, are linked to the
    smallest neighbour, until every link leads to a root.  Each step is a grouped
    minimum and an equi-join; nothing is collected.
    """
    table = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links-0")
    before, step = None, 0
    while True:
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = store(large, f"links-large-{step}")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low", "a")
        table = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        table = store(table, f"links-{step + 1}")
        state = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, step = state, step + 1
