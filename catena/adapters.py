"""Grids, trees, profiles and points from the test tables.

Every adapter is a piece of SQL that Spark and DuckDB read alike, so a query and
its check start from the same rows.  Prices are summed in whole cents, which
makes averages the same in every engine.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

#: Rows of lineitem that a cell averages: the grid grows with the table, and its values are spread alike at every size.
ROWS_PER_CELL = 12
SIZE = f"size AS (SELECT greatest(1, CAST(ceil(sqrt(count(*) / {ROWS_PER_CELL}.0)) AS INT)) AS n FROM lineitem)"

CELLS = """cells AS (SELECT CAST(l_orderkey % n AS INT) AS row, CAST(l_partkey % n AS INT) AS col,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS value FROM sized_lineitem GROUP BY 1, 2)"""
CELLS2 = """cells2 AS (SELECT CAST(l_orderkey % n AS INT) AS row, CAST(l_partkey % n AS INT) AS col,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / count(*) AS value FROM sized_lineitem GROUP BY 1, 2)"""
LITHO = """litho AS (SELECT row, col, (row * 7 + col * 13) % 5 AS litho FROM cells)"""
#: Basins for zonal statistics: square blocks.
ZONES = """zones AS (SELECT row, col, value, CAST(floor(row / 16.0) * 10000 + floor(col / 16.0) AS INT) AS zone FROM cells)"""
TREE = """tree AS (
  SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(r_regionkey AS BIGINT) AS receiver, CAST(0 AS DOUBLE) AS dx, CAST(1 AS BIGINT) AS amount FROM region
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), CAST(100 AS DOUBLE), CAST(2 AS BIGINT) FROM nation
  UNION ALL SELECT CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), CAST(10 + c_custkey % 7 AS DOUBLE), CAST(3 AS BIGINT) FROM customer
  UNION ALL SELECT CAST(10000000 + o_orderkey AS BIGINT), CAST(1000 + o_custkey AS BIGINT), CAST(1 + o_orderkey % 5 AS DOUBLE), CAST(round(o_totalprice) AS BIGINT) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"""
#: One channel a user: events in order, a unit apart; the running number is the distance from the outlet.
PROFILE = """profile AS (SELECT user_id AS source_key, event_id AS node, event_type AS kind, round(value, 2) AS elevation,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos FROM events)"""
POINTS = """points AS (SELECT o_orderkey AS id, CAST(o_custkey % n + 0.5 AS DOUBLE) AS x, CAST(o_orderkey % n + 0.5 AS DOUBLE) AS y, o_totalprice AS value FROM sized_orders)"""
SAMPLES = """samples AS (SELECT s_suppkey AS sample, CAST(-60 + (s_suppkey * 13) % 121 AS DOUBLE) AS latitude, CAST(-177 + (s_suppkey * 7) % 355 AS DOUBLE) AS longitude,
  100000 + CAST(round(s_acctbal * 100) AS BIGINT) % 900000 AS conc FROM supplier)"""

RAW_EVENTS = "raw_events AS (SELECT * FROM events)"

_PARTS = {"raw_events": RAW_EVENTS, "cells": CELLS, "cells2": CELLS2, "litho": LITHO, "zones": ZONES, "tree": TREE, "profile": PROFILE, "points": POINTS, "samples": SAMPLES}
_NEEDS = {"raw_events": ["events"], "cells": ["lineitem"], "cells2": ["lineitem"], "litho": ["lineitem"], "zones": ["lineitem"], "tree": ["region", "nation", "customer", "orders"], "profile": ["events"], "points": ["orders"], "samples": ["supplier"]}
_ON = {"cells": ["sized_lineitem"], "cells2": ["sized_lineitem"], "litho": ["sized_lineitem", "cells"], "zones": ["sized_lineitem", "cells"], "points": ["sized_orders"]}


def on_grid(*names: str) -> bool:
    """Whether any of the adapters depends on the size of the grid."""
    return any(n in _ON for n in names)


def grid_size(spark: SparkSession, sf_dir: str) -> int:
    """Rows, and columns, of the grid; the count comes from the files' footers."""
    return max(1, math.ceil(math.sqrt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / ROWS_PER_CELL)))


def prelude(*names: str, size: int | None = None) -> str:
    """The adapters' definitions as the beginning of a WITH clause (without WITH); without a size they count it themselves."""
    wanted = dict.fromkeys(n for name in names for n in [*_ON.get(name, []), name])
    sized = lambda t: f"{t} AS (SELECT *, {size} AS n FROM {t[6:]})" if size else f"{t} AS (SELECT t.*, size.n FROM {t[6:]} t, size)"
    parts = [sized(n) if n.startswith("sized_") else _PARTS[n] for n in wanted]
    return ",\n".join([SIZE, *parts] if on_grid(*names) and not size else parts)


def adapter(spark: SparkSession, sf_dir: str, name: str, size: int | None = None) -> DataFrame:
    """One adapter as a DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _NEEDS[name]}
    text = prelude(name, size=size)
    for t in tables:
        text = _named(text, t)
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **{f"t_{t}": df for t, df in tables.items()})


def _named(text: str, table: str) -> str:
    """Replace a table's name after FROM by a parameter, so that no view is registered."""
    return re.sub(rf"\bFROM {table}\b", f"FROM {{t_{table}}}", text)
