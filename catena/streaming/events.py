"""Profiles and grids from a stream of events.

Tumbling windows with a watermark for late rows, and a stateful operator that follows each
channel's last value to report steps as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mean, extremes and count of each channel's values by window of event time; later than ``late`` is dropped."""
    w = F.window("ts", width)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), F.col("user_id").alias("source_key"))
    return out.agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")).select("source_key", F.col("w.start").alias("start"), "mean", "low", "high", "n")


def steps(events: DataFrame, least: float) -> DataFrame:
    """``source_key, event_id, delta``: changes of at least ``least`` from a channel's last value, kept as state between batches."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        values = rows["value"].tolist()
        before = [last, *values[:-1]]
        state.update((values[-1],))
        found = [(int(key[0]), int(e), v - b) for e, v, b in zip(rows["event_id"], values, before, strict=True) if b is not None and abs(v - b) >= least]
        yield pd.DataFrame(found, columns=["source_key", "event_id", "delta"])

    return events.withColumn("source_key", F.col("user_id")).groupBy("source_key").applyInPandasWithState(follow, "source_key long, event_id long, delta double", "last double", "append", GroupStateTimeout.NoTimeout)
