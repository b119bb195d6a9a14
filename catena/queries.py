"""Every terrain query by name, each with its SQL form for DuckDB where SQL can express it.

Queries run over the whole test tables by way of the adapters.  Results of floating-point sums are rounded
to six places, as sums depend on the order of their rows in the last digits.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catena.adapters import adapter, grid_size, on_grid, prelude
from catena.functions import geo, nuclide, soil, stats
from catena.grid import GridSpec
from catena.operators import algebra, flow, focal, joins, kernels, landforms, morphology, network, profile, routing
from catena.plans import analyses

#: The grid of the query that is being planned.
GRID: ContextVar[GridSpec] = ContextVar("grid")
spec = GRID.get
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *needs: str, sql: str | None = None, recursive: bool = False, more: str = "") -> Callable:
    """Register a query; its function gets the named adapters as DataFrames."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size = grid_size(spark, sf_dir) if on_grid(*needs) else None
            token = GRID.set(GridSpec(size or 1, size or 1))
            try:
                return f(*[adapter(spark, sf_dir, n, size) for n in needs])
            finally:
                GRID.reset(token)

        QUERIES[name] = run
        if sql:
            parts = [prelude(*needs), more]
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p for p in parts if p) + "\n" + sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


#: Products and quotients of short decimals often lie right between two roundings, where the last digit of a double decides; both sides add this first.
NUDGE = 3e-8


def halves_up(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Columns of no negative values rounded as the checks' engine does it, by a product: a mean of prices may lie right between two roundings.

    Values that are not finite, or have no such places, stay.
    """
    scaled = lambda n: F.col(n) * 10.0**places
    up = lambda n: (F.floor(scaled(n)) + F.when(scaled(n) - F.floor(scaled(n)) >= 0.5, 1).otherwise(0)) / 10.0**places
    return df.withColumns({n: F.when(scaled(n) < 2.0**52, up(n)).otherwise(F.col(n)) for n in names})


def nudged(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + NUDGE, places) for n in names})


# --- pieces of SQL that several checks share ---

STEPS_SQL = "(VALUES (0,-1,0,1),(1,-1,1,2),(2,0,1,1),(3,1,1,2),(4,1,0,1),(5,1,-1,2),(6,0,-1,1),(7,-1,-1,2)) k(k, dr, dc, d2)"
GRID_SQL = "grid AS (SELECT c.row, c.col, c.value, CAST(c.row * size.n + c.col AS BIGINT) AS node FROM cells c, size)"
#: Points with the row and column of their cell.
SPOTS_SQL = "spots AS (SELECT p.*, CAST(size.n - 1 - floor(p.y) AS INT) AS r0, CAST(floor(p.x) AS INT) AS c0, size.n FROM points p, size)"
D8_SQL = f"""{GRID_SQL},
falls AS (SELECT c.node, k.k, (c.value - n.value) / sqrt(CAST(k.d2 AS DOUBLE)) AS fall, n.node AS lower
  FROM grid c JOIN {STEPS_SQL} ON true JOIN grid n ON n.row = c.row + k.dr AND n.col = c.col + k.dc),
steepest AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY fall DESC, k) AS place FROM falls WHERE fall > 0),
nodes AS (SELECT c.node, c.row, c.col, c.value AS z, coalesce(s.lower, c.node) AS receiver, coalesce(s.k, -1) AS direction,
  CASE WHEN s.k IS NULL THEN CAST(0 AS DOUBLE) WHEN s.k % 2 = 1 THEN sqrt(CAST(2 AS DOUBLE)) ELSE CAST(1 AS DOUBLE) END AS dx
  FROM grid c LEFT JOIN steepest s ON s.node = c.node AND s.place = 1)"""
WAYS_SQL = """ways(node, ancestor, steps, distance) AS (SELECT node, node, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM {t}
  UNION ALL SELECT w.node, n.receiver, w.steps + 1, w.distance + n.dx FROM ways w JOIN {t} n ON n.node = w.ancestor WHERE n.receiver <> n.node)"""
D8_WAYS = D8_SQL + ",\n" + WAYS_SQL.format(t="nodes")
TREE_WAYS = WAYS_SQL.format(t="tree")
COUNTS = "counts AS (SELECT ancestor AS node, count(*) AS n_contrib FROM ways GROUP BY ancestor)"


def d8(cells: DataFrame) -> DataFrame:
    return flow.store(flow.d8(cells, spec()), "d8")


# --- flow ---


@query("d8_receiver", "cells", more=D8_SQL, sql="SELECT node, receiver, direction, round(dx, 6) AS dx FROM nodes")
def _(cells):
    return rounded(flow.d8(cells, spec()).select("node", "receiver", "direction", "dx"), "dx")


@query("d8_slope", "cells", more=D8_SQL, sql="SELECT n.node, round(CASE WHEN n.dx > 0 THEN (n.z - r.z) / n.dx ELSE 0 END, 6) AS slope FROM nodes n JOIN nodes r ON r.node = n.receiver")
def _(cells):
    return rounded(flow.d8_slope(d8(cells)).select("node", "slope"), "slope")


@query("contributing_cells", "cells", recursive=True, more=D8_WAYS, sql="SELECT ancestor AS node, count(*) AS n_contrib FROM ways GROUP BY ancestor")
def _(cells):
    return flow.contributing(flow.d8(cells, spec()))


@query("drainage_area", "cells", recursive=True, more=D8_WAYS, sql="SELECT ancestor AS node, count(*) AS n_contrib, CAST(count(*) AS DOUBLE) AS area FROM ways GROUP BY ancestor")
def _(cells):
    return flow.drainage_area(flow.d8(cells, spec()), spec())


@query("basin_root", "cells", recursive=True, more=D8_WAYS, sql="SELECT w.node, w.ancestor AS root, w.steps AS depth FROM ways w JOIN nodes n ON n.node = w.ancestor AND n.receiver = n.node")
def _(cells):
    return flow.to_root(flow.d8(cells, spec()))


@query("base_level_nodes", "cells", more=D8_SQL, sql='SELECT node, "row", col FROM nodes WHERE node = receiver')
def _(cells):
    return flow.base_level(flow.d8(cells, spec())).select("node", "row", "col")


@query("donors_count", "cells", more=D8_SQL, sql="SELECT n.node, count(d.node) AS n_donors FROM nodes n LEFT JOIN nodes d ON d.receiver = n.node AND d.node <> n.node GROUP BY n.node")
def _(cells):
    return flow.donors(d8(cells))


@query("upslope_sum", "tree", recursive=True, more=TREE_WAYS, sql="SELECT w.ancestor AS node, CAST(sum(t.amount) AS BIGINT) AS total FROM ways w JOIN tree t ON t.node = w.node GROUP BY w.ancestor")
def _(tree):
    return flow.accumulate(tree, {"total": F.col("amount")})


@query("upslope_mean", "tree", recursive=True, more=TREE_WAYS, sql="SELECT w.ancestor AS node, count(*) AS n, round(CAST(sum(t.amount) AS DOUBLE) / count(*), 6) AS mean FROM ways w JOIN tree t ON t.node = w.node GROUP BY w.ancestor")
def _(tree):
    tree = flow.store(tree, "tree")
    return rounded(flow.upslope_mean(tree, tree, "amount").select("node", "n", "mean"), "mean")


@query("distance_from_outlet", "tree", recursive=True, more=TREE_WAYS, sql="SELECT w.node, w.ancestor AS root, w.steps AS depth, w.distance FROM ways w JOIN tree n ON n.node = w.ancestor AND n.receiver = n.node")
def _(tree):
    return flow.distance_from_outlet(tree)


@query("flow_path", "cells", recursive=True, more=D8_WAYS, sql="SELECT node AS start, steps AS step, ancestor AS node FROM ways")
def _(cells):
    nodes = d8(cells)
    return flow.flow_paths(nodes, nodes)


CHI_SQL = """terms AS (SELECT w.node, n.receiver = n.node AS at_root, n.node AS via, CASE WHEN n.receiver = n.node THEN 0 ELSE n.dx * power(1.0 / c.n_contrib, 0.5) END AS term FROM ways w JOIN {t} n ON n.node = w.ancestor JOIN counts c ON c.node = n.node)"""


@query("chi_tree", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS + ",\n" + CHI_SQL.format(t="nodes"), sql="SELECT node, max(CASE WHEN at_root THEN via END) AS root, round(sum(term), 6) AS chi FROM terms GROUP BY node")
def _(cells):
    nodes = d8(cells)
    return rounded(flow.chi(nodes, flow.drainage_area(nodes, spec())), "chi")


@query("sources_area_threshold", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS, sql="SELECT node FROM counts WHERE n_contrib >= 5 AND node NOT IN (SELECT n.receiver FROM nodes n JOIN counts c ON c.node = n.node WHERE c.n_contrib >= 5 AND n.receiver <> n.node)")
def _(cells):
    nodes = d8(cells)
    return flow.sources_by_area(nodes, flow.contributing(nodes), 5)


SLOPES = "slopes AS (SELECT n.node, n.receiver, CASE WHEN n.dx > 0 THEN (n.z - r.z) / n.dx ELSE 0 END AS slope FROM nodes n JOIN nodes r ON r.node = n.receiver)"


@query("sources_slope_area", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS + ",\n" + SLOPES + ",\nhot AS (SELECT s.node, s.receiver FROM slopes s JOIN counts c ON c.node = s.node WHERE c.n_contrib * s.slope * s.slope >= 1e9)", sql="SELECT node FROM hot WHERE node NOT IN (SELECT receiver FROM hot WHERE receiver <> node)")
def _(cells):
    nodes = d8(cells)
    return flow.sources_by_slope_area(nodes, flow.contributing(nodes), flow.d8_slope(nodes), 1e9)


@query("upstream_closure", "tree", recursive=True, more=TREE_WAYS, sql="SELECT ancestor AS outlet, node FROM ways WHERE ancestor >= 100 AND ancestor < 1000")
def _(tree):
    tree = flow.store(tree, "tree")
    return flow.upslope_nodes(tree, tree.where("node >= 100 AND node < 1000"))


@query("is_upstream_pairs", "cells", recursive=True, more=D8_WAYS, sql="SELECT node AS a, ancestor AS b FROM ways WHERE steps > 0")
def _(cells):
    return flow.ancestors(flow.d8(cells, spec())).where("steps > 0").select(F.col("node").alias("a"), F.col("ancestor").alias("b"))


@query("farthest_upslope", "tree", recursive=True, more=TREE_WAYS, sql="SELECT ancestor AS node, arg_min(node, (-distance, node)) AS farthest, max(distance) AS distance FROM ways GROUP BY ancestor")
def _(tree):
    return flow.farthest_upslope(flow.store(tree, "tree"))


TAGGED = "tagged AS (SELECT w.node, w.ancestor AS tag_node, w.distance, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS place FROM ways w WHERE w.ancestor >= 100 AND w.ancestor < 1000)"


@query("tag_upstream", "tree", recursive=True, more=TREE_WAYS + ",\n" + TAGGED, sql="SELECT node, tag_node, tag_node * 10 AS tag, distance FROM tagged WHERE place = 1 AND distance < 120")
def _(tree):
    tree = flow.store(tree, "tree")
    return flow.nearest_tag(tree, tree.where("node >= 100 AND node < 1000").select("node", (F.col("node") * 10).alias("tag")), 120.0)


# --- networks ---


#: Stream order of the four-level tree, level by level from the leaves.
ORDER_SQL = """
l3 AS (SELECT receiver AS node, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS stream_order FROM tree WHERE node >= 10000000 GROUP BY receiver),
l3a AS (SELECT t.node, t.receiver, coalesce(l3.stream_order, 1) AS o FROM tree t LEFT JOIN l3 ON l3.node = t.node WHERE t.node >= 1000 AND t.node < 10000000),
l2m AS (SELECT receiver AS node, max(o) AS m FROM l3a GROUP BY receiver),
l2 AS (SELECT l2m.node, CASE WHEN (SELECT count(*) FROM l3a WHERE l3a.receiver = l2m.node AND l3a.o = l2m.m) > 1 THEN l2m.m + 1 ELSE l2m.m END AS stream_order FROM l2m),
l2a AS (SELECT t.node, t.receiver, coalesce(l2.stream_order, 1) AS o FROM tree t LEFT JOIN l2 ON l2.node = t.node WHERE t.node >= 100 AND t.node < 1000),
l1m AS (SELECT receiver AS node, max(o) AS m FROM l2a GROUP BY receiver),
l1 AS (SELECT l1m.node, CASE WHEN (SELECT count(*) FROM l2a WHERE l2a.receiver = l1m.node AND l2a.o = l1m.m) > 1 THEN l1m.m + 1 ELSE l1m.m END AS stream_order FROM l1m),
orders_of AS (SELECT node, CAST(stream_order AS INT) AS stream_order FROM (
  SELECT o.node, 1 AS stream_order FROM tree o WHERE o.node >= 10000000 OR (o.node NOT IN (SELECT receiver FROM tree WHERE receiver <> node))
  UNION ALL SELECT node, stream_order FROM l3 UNION ALL SELECT node, stream_order FROM l2 UNION ALL SELECT node, stream_order FROM l1))"""


@query("strahler_order", "tree", more=ORDER_SQL, sql="SELECT node, stream_order FROM orders_of")
def _(tree):
    return network.strahler(flow.store(tree, "tree"))


CHANNEL_SQL = D8_WAYS + ",\n" + COUNTS + """,
channel AS (SELECT n.* FROM nodes n JOIN counts c ON c.node = n.node WHERE c.n_contrib >= 3),
feeds AS (SELECT n.node, count(d.node) AS n_donors, bool_or(n.node = n.receiver) AS root FROM channel n LEFT JOIN channel d ON d.receiver = n.node AND d.node <> n.node GROUP BY n.node)"""


def channel_of(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The flow tree, its counts, and the nodes to which at least three drain."""
    nodes = d8(cells)
    counts = flow.store(flow.contributing(nodes), "counts")
    return nodes, counts, flow.store(nodes.join(counts.where("n_contrib >= 3").select("node"), "node", "left_semi"), "channel")


@query("junction_list", "cells", recursive=True, more=CHANNEL_SQL, sql="SELECT node AS junction, n_donors FROM feeds WHERE n_donors <> 1 OR root")
def _(cells):
    channel = channel_of(cells)[2]
    return network.junctions(channel, network.strahler(channel)).select("junction", "n_donors")


@query("channel_from_sources", "cells", recursive=True, more=CHANNEL_SQL, sql="SELECT node FROM channel")
def _(cells):
    nodes, counts, _channel = channel_of(cells)
    return network.channel_nodes(nodes, flow.sources_by_area(nodes, counts, 3)).select("node")


@query("largest_basin", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS, sql="SELECT c.node, c.n_contrib FROM counts c JOIN nodes n ON n.node = c.node AND n.receiver = n.node ORDER BY n_contrib DESC, c.node LIMIT 1")
def _(cells):
    nodes = d8(cells)
    return network.largest(flow.contributing(nodes).join(flow.base_level(nodes).select("node"), "node"), F.col("n_contrib"))


@query("prune_area_window", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS, sql="SELECT node, n_contrib FROM counts WHERE n_contrib BETWEEN 4 AND 20")
def _(cells):
    return network.prune_by_size(flow.contributing(flow.d8(cells, spec())), 4, 20)


@query("prune_nested", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS + ",\nouts AS (SELECT node FROM counts WHERE n_contrib BETWEEN 4 AND 20)", sql="SELECT node FROM outs WHERE node NOT IN (SELECT w.node FROM ways w JOIN outs o ON o.node = w.ancestor WHERE w.steps > 0)")
def _(cells):
    nodes = d8(cells)
    return network.prune_nested(nodes, network.prune_by_size(flow.contributing(nodes), 4, 20).select("node"))


@query("basins_of_outlets", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS + ",\nouts AS (SELECT node FROM counts WHERE n_contrib BETWEEN 4 AND 20),\nnear AS (SELECT w.node, w.ancestor, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS place FROM ways w JOIN outs o ON o.node = w.ancestor)", sql="SELECT node, ancestor AS basin FROM near WHERE place = 1")
def _(cells):
    nodes = d8(cells)
    return network.basins(nodes, network.prune_by_size(flow.contributing(nodes), 4, 20))


@query("nearest_channel_relief", "cells", recursive=True, more=CHANNEL_SQL + ",\nnear AS (SELECT w.node, w.ancestor, w.distance, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS place FROM ways w JOIN channel c ON c.node = w.ancestor)", sql="SELECT n.node, n.ancestor AS channel_node, round(n.distance, 6) AS distance, round(a.z - b.z, 6) AS relief FROM near n JOIN nodes a ON a.node = n.node JOIN nodes b ON b.node = n.ancestor WHERE place = 1")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return rounded(network.to_channel(nodes, channel, nodes), "distance", "relief")


@query("source_keys", "cells", recursive=True, more=CHANNEL_SQL + """,
heads AS (SELECT f.node FROM feeds f WHERE f.n_donors = 0),
far AS (SELECT w.node, max(w.distance) AS d FROM ways w GROUP BY w.node),
pick AS (SELECT w.ancestor AS node, h.node AS source_key, row_number() OVER (PARTITION BY w.ancestor ORDER BY round(far.d, 6) DESC, h.node) AS place FROM ways w JOIN heads h ON h.node = w.node JOIN far ON far.node = h.node)""", sql="SELECT node, source_key FROM pick WHERE place = 1")
def _(cells):
    nodes, counts, channel = channel_of(cells)
    return network.source_keys(channel, flow.sources_by_area(nodes, counts, 3))


@query("stream_counts", "tree", more=ORDER_SQL + ",\nfed AS (SELECT DISTINCT a.node FROM orders_of a JOIN tree t ON t.receiver = a.node AND t.node <> a.node JOIN orders_of d ON d.node = t.node AND d.stream_order = a.stream_order)", sql="SELECT stream_order, count(*) AS n_streams FROM orders_of WHERE node NOT IN (SELECT node FROM fed) GROUP BY stream_order")
def _(tree):
    tree = flow.store(tree, "tree")
    return network.stream_counts(tree, network.strahler(tree))


@query("hypsometric_integral", "cells", recursive=True, more=D8_WAYS, sql="SELECT w.ancestor AS node, round(CASE WHEN max(n.z) > min(n.z) THEN (avg(n.z) - min(n.z)) / (max(n.z) - min(n.z)) END, 6) AS hi FROM ways w JOIN nodes n ON n.node = w.node GROUP BY w.ancestor")
def _(cells):
    nodes = d8(cells)
    return rounded(network.hypsometric_integral(nodes, nodes), "hi")


ANGLE_SQL = """vecs AS (SELECT d.receiver, d.node, CAST(d.col - r.col AS DOUBLE) AS u, CAST(r.row - d.row AS DOUBLE) AS v FROM nodes d JOIN nodes r ON r.node = d.receiver WHERE d.node <> d.receiver)"""


@query("junction_angles", "cells", more=D8_SQL + ",\n" + ANGLE_SQL, sql="SELECT a.receiver AS node, a.node AS donor1, b.node AS donor2, round(degrees(acos(greatest(-1.0, least(1.0, (a.u * b.u + a.v * b.v) / sqrt((a.u * a.u + a.v * a.v) * (b.u * b.u + b.v * b.v)))))), 4) AS angle FROM vecs a JOIN vecs b ON a.receiver = b.receiver AND a.node < b.node")
def _(cells):
    nodes = d8(cells)
    places = nodes.select("node", spec().x(F.col("col")).alias("x"), spec().y(F.col("row")).alias("y"))
    return network.junction_angles(nodes, places).withColumn("angle", F.round("angle", 4))


ROOTED = "rooted AS (SELECT n.row, n.col, w.ancestor AS basin FROM ways w JOIN nodes n ON n.node = w.node JOIN nodes a ON a.node = w.ancestor AND a.receiver = a.node)"


def rooted(cells: DataFrame) -> DataFrame:
    nodes = d8(cells)
    return flow.store(flow.to_root(nodes).join(nodes.select("node", "row", "col"), "node").select("row", "col", F.col("root").alias("basin")), "rooted")


@query("basin_perimeter", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED, sql=f'SELECT * FROM (SELECT b.row AS "row", b.col, b.basin, CAST(8 - count(n.basin) AS INT) AS outside FROM rooted b JOIN {STEPS_SQL} ON true LEFT JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc AND n.basin = b.basin GROUP BY 1, 2, 3) WHERE outside > 0')
def _(cells):
    return network.perimeter(rooted(cells))


@query("adjacency_pairs", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED, sql=f"SELECT b.basin, n.basin AS neighbour, count(*) AS n FROM rooted b JOIN {STEPS_SQL} ON true JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc WHERE n.basin <> b.basin GROUP BY 1, 2")
def _(cells):
    return network.adjacent(rooted(cells))


# --- joins of points ---


@query("burn_raster_to_points", "points", "cells", more=SPOTS_SQL, sql="SELECT p.id, c.value AS burned FROM spots p LEFT JOIN cells c ON c.row = p.r0 AND c.col = p.c0")
def _(points, cells):
    return joins.burn(points, cells, spec()).select("id", "burned")


TARGETS = GRID_SQL + ",\n" + SPOTS_SQL + ",\ntargets AS (SELECT row, col, node FROM grid WHERE value < 44000)"


@query("snap_points", "points", "cells", more=TARGETS + ",\nseen AS (SELECT DISTINCT r0, c0 FROM spots),\npairs AS (SELECT s.r0, s.c0, t.node, (t.row - s.r0) * (t.row - s.r0) + (t.col - s.c0) * (t.col - s.c0) AS d2 FROM seen s JOIN targets t ON t.row BETWEEN s.r0 - 4 AND s.r0 + 4 AND t.col BETWEEN s.c0 - 4 AND s.c0 + 4),\nbest AS (SELECT r0, c0, arg_min(node, (d2, node)) AS node, min(d2) AS d2 FROM pairs WHERE d2 <= 16 GROUP BY 1, 2)", sql="SELECT p.id, b.node, round(sqrt(CAST(b.d2 AS DOUBLE)), 6) AS distance FROM spots p JOIN best b ON b.r0 = p.r0 AND b.c0 = p.c0")
def _(points, cells):
    targets = cells.where("value < 44000").select("row", "col", spec().node().alias("node"))
    return rounded(joins.nearest_within(joins.in_cells(points, spec()), targets, 4), "distance")


FAR_SQL = GRID_SQL + ",\nfar AS (SELECT g.node AS id2, CAST(g.col + 0.5 AS DOUBLE) AS x, CAST(size.n - 1 - g.row + 0.5 AS DOUBLE) AS y FROM grid g, size WHERE g.value > 68000)"


@query("nearest_point", "points", "cells", more=FAR_SQL + ",\nplaces AS (SELECT DISTINCT x, y FROM points),\nbest AS (SELECT p.x, p.y, arg_min(f.id2, ((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y), f.id2)) AS id2, min((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)) AS d2 FROM places p JOIN far f ON true GROUP BY 1, 2)", sql="SELECT p.id, b.id2, round(sqrt(b.d2), 6) AS distance FROM points p JOIN best b ON b.x = p.x AND b.y = p.y")
def _(points, cells):
    targets = cells.where("value > 68000").select(spec().node().alias("id2"), spec().x(F.col("col")).alias("x"), spec().y(F.col("row")).alias("y"))
    return rounded(joins.nearest(points, targets, 8.0), "distance")


POLYGON = [(3.2, 4.1), (40.7, 8.3), (55.1, 50.2), (20.4, 30.9), (8.6, 60.3)]
IN_POLYGON = " + ".join(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True))


@query("point_in_polygon", "points", sql=f"SELECT id FROM points WHERE ({IN_POLYGON}) % 2 = 1")
def _(points):
    return points.where(joins.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("id")


# --- map algebra ---

for _name, _op, _sql in (("raster_add", "add", "a.value + b.value"), ("raster_sub", "subtract", "a.value - b.value"), ("raster_mul", "multiply", "a.value * b.value"), ("raster_div", "divide", "CASE WHEN b.value <> 0 THEN a.value / b.value END")):
    query(_name, "cells", "cells2", sql=f'SELECT a.row AS "row", a.col, round({_sql} + {NUDGE}::DOUBLE, 6) AS value FROM cells a JOIN cells2 b ON a.row = b.row AND a.col = b.col')(lambda a, b, op=_op: nudged(algebra.combine(a, b, op), "value"))


@query("raster_diff_count", "cells", "cells2", sql="SELECT round(avg(abs(a.value - b.value)), 6) AS mean_abs_diff, count(*) FILTER (a.value <> b.value) AS n_different FROM cells a JOIN cells2 b ON a.row = b.row AND a.col = b.col")
def _(cells, cells2):
    return rounded(algebra.difference_summary(cells, cells2), "mean_abs_diff")


@query("mask_below", "cells", sql='SELECT row AS "row", col, CASE WHEN value >= 50000 THEN value END AS value FROM cells')
def _(cells):
    return algebra.mask_below(cells, 50000)


@query("mask_by_raster", "cells", "cells2", sql='SELECT a.row AS "row", a.col, CASE WHEN b.value > 25 THEN a.value END AS value FROM cells a LEFT JOIN cells2 b ON a.row = b.row AND a.col = b.col')
def _(cells, cells2):
    return algebra.mask_by(cells, cells2, 25)


@query("clip_window", "cells", sql='SELECT row - 10 AS "row", col - 20 AS col, value FROM cells WHERE row BETWEEN 10 AND 29 AND col BETWEEN 20 AND 49')
def _(cells):
    return algebra.clip(cells, 10, 20, 20, 30)


@query("trim_bounds", "cells", sql="SELECT min(row) AS row_min, max(row) AS row_max, min(col) AS col_min, max(col) AS col_max, count(*) AS n FROM cells WHERE value >= 70000")
def _(cells):
    return algebra.bounds(algebra.mask_below(cells, 70000))


@query("trim_to_data", "cells", sql='SELECT c.row - b.r AS "row", c.col - b.c AS col, value FROM cells c, (SELECT min(row) AS r, min(col) AS c FROM cells WHERE value >= 70000) b WHERE value >= 70000')
def _(cells):
    return algebra.trim(algebra.mask_below(cells, 70000)).select("row", "col", "value")


@query("resample_centre", "cells", sql='SELECT CAST(floor(row / 4.0) AS INT) AS "row", CAST(floor(col / 4.0) AS INT) AS col, value FROM cells WHERE row % 4 = 2 AND col % 4 = 2')
def _(cells):
    return algebra.resample(cells, 4)


@query("categorise", "cells", sql='SELECT row AS "row", col, CAST((value > 48000) AS INT) + CAST((value > 53000) AS INT) + CAST((value > 58000) AS INT) AS category FROM cells')
def _(cells):
    return cells.select("row", "col", algebra.categorise(F.col("value"), [48000.0, 53000.0, 58000.0]).alias("category"))


@query("scale_minmax", "cells", sql='SELECT row AS "row", col, round((value - min(value) OVER ()) * 100 / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM cells')
def _(cells):
    return rounded(algebra.rescale(cells, 0.0, 100.0), "value")


@query("merge_rasters", "cells", "cells2", sql='SELECT a.row AS "row", a.col, coalesce(CASE WHEN a.value >= 53000 THEN a.value END, b.value) AS value FROM cells a JOIN cells2 b ON a.row = b.row AND a.col = b.col')
def _(cells, cells2):
    return algebra.merge(algebra.mask_below(cells, 53000).where("value IS NOT NULL"), cells2)


@query("union_networks", "cells", "cells2", sql='SELECT row AS "row", col, max(v) AS value FROM (SELECT row, col, 1 AS v FROM cells WHERE value > 56000 UNION ALL SELECT row, col, 1 FROM cells2 WHERE value > 27) GROUP BY 1, 2')
def _(cells, cells2):
    return algebra.union_of(algebra.to_mask(cells, F.col("value") > 56000).where("value = 1"), algebra.to_mask(cells2, F.col("value") > 27).where("value = 1"))


@query("binary_quality", "cells", "cells2", more="b AS (SELECT CAST(a.value > 53000 AS INT) AS f, CAST(c.value > 25.5 AS INT) AS t FROM cells a JOIN cells2 c ON a.row = c.row AND a.col = c.col), s AS (SELECT count(*) FILTER (f = 1 AND t = 1) AS tp, count(*) FILTER (f = 1 AND t = 0) AS fp, count(*) FILTER (f = 0 AND t = 1) AS fn FROM b)", sql="SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS reliability, round(tp / (tp + fn), 6) AS sensitivity, round(tp / (tp + fp + fn), 6) AS quality, round((fp - fn) / (tp + fn), 6) AS area_difference FROM s")
def _(cells, cells2):
    found = algebra.to_mask(cells, F.col("value") > 53000).where("value = 1")
    return rounded(algebra.quality_of(found, algebra.to_mask(cells2, F.col("value") > 25.5).where("value = 1")), "reliability", "sensitivity", "quality", "area_difference")


# --- statistics by zone and group ---


@query("zonal_mean", "zones", sql="SELECT zone, round(avg(value), 6) AS mean, count(*) AS n FROM zones GROUP BY zone")
def _(zones):
    return zones.groupBy("zone").agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query("zonal_min_max_range", "zones", sql="SELECT zone, min(value) AS low, max(value) AS high, max(value) - min(value) AS span FROM zones GROUP BY zone")
def _(zones):
    return zones.groupBy("zone").agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.max("value") - F.min("value")).alias("span"))


@query("zonal_stddev", "zones", sql="SELECT zone, round(stddev_pop(value), 6) AS sd, round(stddev_pop(value) / sqrt(count(*)), 6) AS se FROM zones GROUP BY zone")
def _(zones):
    return zones.groupBy("zone").agg(r6(F.stddev_pop("value")).alias("sd"), r6(F.stddev_pop("value") / F.sqrt(F.count("*"))).alias("se"))


@query("zonal_median", "zones", sql="SELECT zone, round(quantile_cont(value, 0.5), 6) AS median FROM zones GROUP BY zone")
def _(zones):
    return zones.groupBy("zone").agg(r6(stats.percentile("value", 0.5)).alias("median"))


@query("zonal_percentile", "zones", sql="SELECT zone, round(quantile_cont(value, 0.16), 6) AS p16, round(quantile_cont(value, 0.84), 6) AS p84 FROM zones GROUP BY zone")
def _(zones):
    return zones.groupBy("zone").agg(r6(stats.percentile("value", 0.16)).alias("p16"), r6(stats.percentile("value", 0.84)).alias("p84"))


@query("zonal_litho_count", "zones", "litho", sql="SELECT z.zone, l.litho, count(*) AS n FROM zones z JOIN litho l ON l.row = z.row AND l.col = z.col GROUP BY 1, 2")
def _(zones, litho):
    return zones.join(litho, ["row", "col"]).groupBy("zone", "litho").agg(F.count("*").alias("n"))


@query("circular_mean_aspect", "zones", sql="SELECT zone, round(degrees(atan2(sum(sin(radians(value % 360))), sum(cos(radians(value % 360))))), 4) AS aspect FROM zones GROUP BY zone")
def _(zones):
    a = F.radians(F.col("value") % 360)
    return zones.groupBy("zone").agg(F.round(F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))), 4).alias("aspect"))


MAD_SQL = "m AS (SELECT source_key, quantile_cont(elevation, 0.5) AS m FROM profile GROUP BY 1), d AS (SELECT p.*, m.m, abs(p.elevation - m.m) AS away FROM profile p JOIN m ON m.source_key = p.source_key), mads AS (SELECT source_key, quantile_cont(away, 0.5) AS mad FROM d GROUP BY 1)"


@query("descriptive_stats", "profile", more=MAD_SQL, sql="""SELECT p.source_key, count(*) AS n, min(elevation) AS minimum, round(quantile_cont(elevation, 0.25), 6) AS q1, round(quantile_cont(elevation, 0.5), 6) AS median, round(quantile_cont(elevation, 0.75), 6) AS q3,
  max(elevation) AS maximum, round(avg(elevation), 8) AS mean, round(stddev_pop(elevation), 6) AS sd, round(stddev_pop(elevation) / sqrt(count(*)), 6) AS se, round(max(mad), 6) AS mad FROM profile p JOIN mads ON mads.source_key = p.source_key GROUP BY 1""")
def _(profile_):
    # Means of hundredths over 64 values have eight places: at six some would be ties.
    return rounded(stats.describe(profile_, ["source_key"], "elevation").withColumn("mean", F.round("mean", 8)), "q1", "median", "q3", "sd", "se", "mad")


@query("mad_by_group", "profile", more=MAD_SQL, sql="SELECT source_key, round(mad, 6) AS mad FROM mads")
def _(profile_):
    return rounded(stats.mad(profile_, ["source_key"], "elevation"), "mad")


@query("modified_zscore", "profile", more=MAD_SQL, sql="SELECT d.node, round(CASE WHEN mad > 0 THEN (elevation - m) * 0.6745 / mad END, 6) AS mzs, coalesce(abs(CASE WHEN mad > 0 THEN (elevation - m) * 0.6745 / mad END) > 3.5, false) AS outlier FROM d JOIN mads ON mads.source_key = d.source_key")
def _(profile_):
    return rounded(stats.modified_z(profile_, ["source_key"], "elevation").select("node", "mzs", "outlier"), "mzs")


@query("histogram", "profile", sql="SELECT CAST(floor(elevation / 10) AS BIGINT) AS bin, floor(elevation / 10) * 10 AS lower, (floor(elevation / 10) + 1) * 10 AS upper, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS density FROM profile GROUP BY 1, 2, 3")
def _(profile_):
    return rounded(stats.histogram(profile_, "elevation", 10.0), "density")


@query("linear_bins", "profile", sql="SELECT CAST(floor(elevation / 25) AS BIGINT) AS bin, round(avg(elevation), 6) AS mean_x, round(avg(pos), 6) AS mean_y, round(stddev_pop(pos), 6) AS sd_y, count(*) AS n FROM profile WHERE elevation <> 0 GROUP BY 1")
def _(profile_):
    return rounded(stats.linear_bins(profile_, "elevation", "pos", 25.0), "mean_x", "mean_y", "sd_y")


@query("log_bins", "profile", sql="SELECT CAST(floor(log10(pos) / 0.25) AS BIGINT) AS bin, round(avg(pos), 6) AS mean_x, round(avg(elevation), 6) AS mean_y, round(stddev_pop(elevation), 6) AS sd_y, count(*) AS n FROM profile WHERE pos > 0 GROUP BY 1")
def _(profile_):
    return rounded(stats.log_bins(profile_, "pos", "elevation", 0.25), "mean_x", "mean_y", "sd_y")


@query("small_bin_filter", "profile", sql="SELECT bin, n, round(share, 6) AS share FROM (SELECT CAST(floor(elevation / 25) AS BIGINT) AS bin, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM profile WHERE elevation <> 0 GROUP BY 1) WHERE share >= 0.02")
def _(profile_):
    return rounded(stats.drop_small_bins(stats.linear_bins(profile_, "elevation", "pos", 25.0), 0.02).select("bin", "n", "share"), "share")


@query("regression_by_group", "profile", sql="SELECT source_key, round(regr_slope(elevation, pos), 6) AS slope, round(regr_intercept(elevation, pos), 6) AS intercept, round(regr_r2(elevation, pos), 6) AS r2, count(*) AS n FROM profile GROUP BY 1")
def _(profile_):
    return rounded(stats.regression(profile_, ["source_key"], "pos", "elevation"), "slope", "intercept", "r2")


@query("orthogonal_regression", "profile", more="a AS (SELECT source_key, var_pop(pos) AS xx, var_pop(elevation) AS yy, covar_pop(elevation, pos) AS xy, avg(pos) AS mx, avg(elevation) AS my FROM profile GROUP BY 1), s AS (SELECT *, CASE WHEN xy <> 0 THEN (yy - xx + sqrt((yy - xx) * (yy - xx) + 4 * xy * xy)) / (2 * xy) END AS slope FROM a)", sql="SELECT source_key, round(slope, 4) AS slope FROM s")
def _(profile_):
    return stats.orthogonal_regression(profile_, ["source_key"], "pos", "elevation").select("source_key", F.round("slope", 4).alias("slope"))


@query("durbin_watson", "profile", more="f AS (SELECT source_key, regr_slope(elevation, pos) AS s, regr_intercept(elevation, pos) AS i FROM profile GROUP BY 1), r AS (SELECT p.source_key, s * pos + i - elevation AS r, (s * pos + i - elevation) - lag(s * pos + i - elevation) OVER (PARTITION BY p.source_key ORDER BY pos) AS d FROM profile p JOIN f ON f.source_key = p.source_key)", sql="SELECT source_key, round(sum(d * d) / sum(r * r), 6) AS durbin_watson FROM r GROUP BY 1")
def _(profile_):
    return rounded(stats.durbin_watson(profile_, ["source_key"], "pos", "elevation", ["pos"]), "durbin_watson")


RANKS = "k AS (SELECT *, rank() OVER (ORDER BY elevation) + (count(*) OVER (PARTITION BY elevation) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY elevation) AS t FROM profile WHERE kind IN ('click', 'view'))"


@query("mann_whitney_u", "profile", more=RANKS + """,
s AS (SELECT CAST(count(*) FILTER (kind = 'click') AS DOUBLE) AS na, CAST(count(*) FILTER (kind = 'view') AS DOUBLE) AS nb, sum(r) FILTER (kind = 'click') AS ra, sum(CAST(t * t - 1 AS DOUBLE)) AS ties FROM k),
u AS (SELECT *, ra - na * (na + 1) / 2 AS ua, na * nb - (ra - na * (na + 1) / 2) AS ub FROM s)""", sql="SELECT na, nb, CAST(ua AS DOUBLE) AS u_a, CAST(ub AS DOUBLE) AS u_b, round((least(ua, ub) - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 6) AS z FROM u")
def _(profile_):
    return rounded(stats.mann_whitney(profile_, "elevation", "kind", "click", "view"), "z").withColumns({"u_a": F.col("u_a").cast("double"), "u_b": F.col("u_b").cast("double")})


@query("ks_statistic", "profile", more="c AS (SELECT elevation, count(*) FILTER (kind = 'click') AS a, count(*) FILTER (kind = 'view') AS b FROM profile WHERE kind IN ('click', 'view') GROUP BY 1)", sql="SELECT round(max(g), 6) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY elevation) / sum(a) OVER () - sum(b) OVER (ORDER BY elevation) / sum(b) OVER ()) AS g FROM c)")
def _(profile_):
    return rounded(stats.ks_distance(profile_, "elevation", "kind", "click", "view"), "ks")


@query("quantile_points", "profile", more="q AS (SELECT unnest(range(1, 20)) AS i)", sql="SELECT CAST(i AS INT) AS i, round((SELECT quantile_cont(elevation, [0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]) FROM profile)[i], 4) AS quantile FROM q")
def _(profile_):
    return stats.quantile_points(profile_, "elevation", 19).select(F.col("i").cast("int").alias("i"), F.round("quantile", 4).alias("quantile"))


@query("unique_values", "profile", sql="SELECT kind, count(*) AS n FROM profile GROUP BY kind")
def _(profile_):
    return profile_.groupBy("kind").agg(F.count("*").alias("n"))


@query("duplicate_values", "profile", sql="SELECT elevation, count(*) AS n FROM profile GROUP BY 1 HAVING count(*) > 1")
def _(profile_):
    return profile_.groupBy("elevation").agg(F.count("*").alias("n")).where("n > 1")


KNOTS = "knots AS (SELECT source_key, pos * 1.0 AS x, elevation AS y FROM profile WHERE pos % 10 = 1), asked AS (SELECT source_key, node, pos + 0.25 AS x FROM profile)"


@query("interp1d_asof", "profile", more=KNOTS + """,
b AS (SELECT a.*, k.x AS x0, k.y AS y0 FROM asked a ASOF LEFT JOIN knots k ON a.source_key = k.source_key AND a.x >= k.x),
e AS (SELECT b.*, k.x AS x1, k.y AS y1 FROM b ASOF LEFT JOIN knots k ON b.source_key = k.source_key AND b.x <= k.x)""", sql="SELECT node, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END, 6) AS y FROM e")
def _(profile_):
    knots = profile_.where("pos % 10 = 1").select("source_key", F.col("pos").cast("double").alias("x"), F.col("elevation").alias("y"))
    asked = profile_.select("source_key", "node", (F.col("pos") + 0.25).cast("double").alias("x"))
    return rounded(stats.interpolate(asked, knots, ["source_key"], "x", "y").select("node", "y"), "y")


# --- neighbourhoods ---

DISC2 = ", ".join(f"({i}, {j})" for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4)


@query("neighbour_mean", "cells", sql=f'SELECT c.row AS "row", c.col, round(avg(n.value), 6) AS mean, round(stddev_pop(n.value), 6) AS sd, count(*) AS n FROM cells c JOIN (VALUES {DISC2}) k(i, j) ON true JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2')
def _(cells):
    return rounded(focal.neighbourhood(cells, 2).select("row", "col", "mean", "sd", "n"), "mean", "sd")


@query("neighbour_relief", "cells", sql=f'SELECT c.row AS "row", c.col, min(n.value) AS low, max(n.value) AS high, max(n.value) - min(n.value) AS relief FROM cells c JOIN (VALUES {DISC2}) k(i, j) ON true JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2')
def _(cells):
    return focal.neighbourhood(cells, 2).select("row", "col", "low", "high", "relief")


@query("fraction_condition", "cells", sql=f'SELECT c.row AS "row", c.col, round(avg(CASE WHEN n.value BETWEEN 50000 AND 56000 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM cells c JOIN (VALUES {DISC2}) k(i, j) ON true JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2')
def _(cells):
    return rounded(focal.fraction_where(cells, 2, 50000.0, 56000.0), "fraction")


W3 = f"""w3 AS (SELECT c.row, c.col, c.value AS z, {', '.join(f'max(CASE WHEN k.k = {k} THEN n.value END) AS n{k}' for k in range(8))}
  FROM cells c JOIN {STEPS_SQL} ON true LEFT JOIN cells n ON n.row = c.row + k.dr AND n.col = c.col + k.dc GROUP BY 1, 2, 3),
g3 AS (SELECT row, col, z, ((n1 + 2 * n2 + n3) - (n7 + 2 * n6 + n5)) / 8 AS zx, ((n7 + 2 * n0 + n1) - (n5 + 2 * n4 + n3)) / 8 AS zy FROM w3)"""


@query("gradient", "cells", more=W3, sql='SELECT row AS "row", col, round(zx, 6) AS zx, round(zy, 6) AS zy FROM g3 WHERE zx IS NOT NULL AND zy IS NOT NULL')
def _(cells):
    return rounded(focal.gradient3(cells).select("row", "col", "zx", "zy"), "zx", "zy")


@query("hillshade", "cells", more=W3, sql='SELECT row AS "row", col, round(255 * greatest(0.0, (-zx * sin(radians(315)) * sin(radians(45)) - zy * cos(radians(315)) * sin(radians(45)) + cos(radians(45))) / sqrt(1 + zx * zx + zy * zy)), 6) AS hillshade FROM g3 WHERE zx IS NOT NULL AND zy IS NOT NULL')
def _(cells):
    return rounded(focal.hillshade(cells), "hillshade")


# --- profiles ---


@query("knickpoint_diffs", "profile", more="c AS (SELECT *, elevation - lag(elevation) OVER (PARTITION BY source_key ORDER BY pos) AS d, count(*) OVER (PARTITION BY source_key) AS n FROM profile)", sql="SELECT node, round(d, 6) AS delta FROM c WHERE n >= 6 AND d <> 0")
def _(profile_):
    return rounded(profile.changes(profile_, "elevation").select("node", "delta"), "delta")


@query("stepped_knickpoints", "profile", more="c AS (SELECT *, elevation - lag(elevation) OVER (PARTITION BY source_key ORDER BY pos) AS step FROM profile), w AS (SELECT *, avg(step) OVER v AS m, stddev_pop(step) OVER v AS s FROM c WHERE step IS NOT NULL WINDOW v AS (PARTITION BY source_key ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))", sql="SELECT node, round(step, 6) AS step FROM w WHERE step > m + 2 * s")
def _(profile_):
    return rounded(profile.stepped(profile_, "elevation").select("node", "step"), "step")


@query("knickpoint_groups", "profile", more="c AS (SELECT *, elevation - lag(elevation) OVER (PARTITION BY source_key ORDER BY pos) AS d FROM profile), k AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY source_key ORDER BY pos) > 2 THEN 1 ELSE 0 END AS b FROM c WHERE abs(d) > 15), i AS (SELECT *, sum(b) OVER (PARTITION BY source_key ORDER BY pos) AS knick FROM k)", sql="SELECT source_key, CAST(knick AS BIGINT) AS knick, round(sum(d), 4) AS delta, min(pos) AS first, max(pos) AS last, count(*) AS n FROM i GROUP BY 1, 2")
def _(profile_):
    raw = profile.changes(profile_, "elevation", 1).where("abs(delta) > 15")
    return profile.gather(raw, 2).select("source_key", "knick", F.round("delta", 4).alias("delta"), "first", "last", "n")


@query("chi_profile_integral", "profile", sql="SELECT node, round(sum(power(1.0 / (1 + n - pos), 0.45)) OVER (PARTITION BY source_key ORDER BY pos), 6) AS chi FROM (SELECT *, count(*) OVER (PARTITION BY source_key) AS n FROM profile)")
def _(profile_):
    p = profile_.withColumns({"area": 1 + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos"), "dx": F.lit(1.0)})
    return rounded(profile.chi_along(p, "area", "dx", 0.45).select("node", "chi"), "chi")


@query("segment_counter", "profile", more="c AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY source_key ORDER BY pos) THEN 0 ELSE 1 END AS b FROM profile)", sql="SELECT node, CAST(sum(b) OVER (PARTITION BY source_key ORDER BY pos) AS BIGINT) AS segment FROM c")
def _(profile_):
    return profile.segments(profile_, "kind").select("node", "segment")


@query("slope_area_bins", "profile", more="p AS (SELECT source_key, log10(1 + pos) AS la, log10(elevation) AS ls FROM profile WHERE elevation > 0)", sql="SELECT source_key, CAST(floor(la / 0.2) AS BIGINT) AS bin, round(avg(la), 6) AS mean_log_a, round(quantile_cont(ls, 0.5), 6) AS median_log_s, round(quantile_cont(ls, 0.25), 6) AS q1_log_s, round(quantile_cont(ls, 0.75), 6) AS q3_log_s, count(*) AS n FROM p GROUP BY 1, 2")
def _(profile_):
    p = profile_.select("source_key", (F.col("pos") + 1).alias("area"), F.col("elevation").alias("slope"))
    return rounded(profile.bin_slope_area(p, 0.2).select("source_key", "bin", "mean_log_a", "median_log_s", "q1_log_s", "q3_log_s", "n"), "mean_log_a", "median_log_s", "q1_log_s", "q3_log_s")


@query("disorder_metric", "profile", more="s AS (SELECT source_key, pos * 1.0 AS chi, abs(pos - lag(pos) OVER (PARTITION BY source_key ORDER BY elevation, pos)) AS d FROM profile)", sql="SELECT source_key, round((coalesce(sum(d), 0) - (max(chi) - min(chi))) / CASE WHEN max(chi) > min(chi) THEN max(chi) - min(chi) END, 6) AS disorder, count(*) AS n FROM s GROUP BY 1")
def _(profile_):
    return rounded(profile.disorder(profile_.withColumn("chi", F.col("pos").cast("double")), ["source_key"]), "disorder")


@query("movern_grid_disorder", "profile", more="t AS (SELECT unnest([CAST(0.2 AS DOUBLE), 0.35, 0.5, 0.65]) AS theta), c AS (SELECT p.source_key % 10 AS basin_key, theta, elevation, pos, node, sum(power(CAST(1 AS DOUBLE) / (1 + n - pos), theta)) OVER (PARTITION BY p.source_key, theta ORDER BY pos) AS chi FROM (SELECT *, count(*) OVER (PARTITION BY source_key) AS n FROM profile) p, t), s AS (SELECT *, abs(chi - lag(chi) OVER (PARTITION BY basin_key, theta ORDER BY elevation, chi)) AS d FROM c)", sql="SELECT basin_key, theta, round((coalesce(sum(d), 0) - (max(chi) - min(chi))) / CASE WHEN max(chi) > min(chi) THEN max(chi) - min(chi) END, 4) AS disorder, count(*) AS n FROM s GROUP BY 1, 2")
def _(profile_):
    p = profile_.withColumns({"area": 1 + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos"), "dx": F.lit(1.0), "basin_key": F.col("source_key") % 10})
    return profile.disorder_over(p, [0.2, 0.35, 0.5, 0.65], "area", "dx", ["basin_key"]).withColumn("disorder", F.round("disorder", 4))


@query("nci", "profile", more="e AS (SELECT source_key, min(pos) AS p0, max(pos) AS p1, arg_min(elevation, pos) AS z0, arg_max(elevation, pos) AS z1, min(elevation) AS lo, max(elevation) AS hi FROM profile GROUP BY 1)", sql="SELECT p.source_key, round(quantile_cont((elevation - (z0 + (pos - p0) * (z1 - z0) / (p1 - p0))) / (hi - lo), 0.5), 6) AS nci FROM profile p JOIN e ON e.source_key = p.source_key WHERE p1 > p0 AND hi > lo GROUP BY 1")
def _(profile_):
    return rounded(profile.nci(profile_), "nci")


@query("swath_bins", "cells", sql="SELECT CAST(floor(abs(row - col) / 4.0) AS BIGINT) AS bin, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.25), 8) AS q1, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.75), 8) AS q3, count(*) AS n FROM cells GROUP BY 1")
def _(cells):
    found = profile.swath(cells.withColumn("away", F.abs(F.col("row") - F.col("col"))), "away", "value", 4.0)
    return rounded(found, "mean", "sd").withColumns({c: F.round(c, 8) for c in ("q1", "median", "q3")})


@query("moving_regression", "profile", sql="SELECT node, round(avg(elevation) OVER (PARTITION BY source_key ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smoothed, round(regr_slope(elevation, pos) OVER (PARTITION BY source_key ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 5) AS slope FROM profile")
def _(profile_):
    p = profile.smooth(profile.moving_regression(profile_, "pos", "elevation", 4), "elevation", 4)
    return p.select("node", r6("smoothed").alias("smoothed"), F.round("slope", 5).alias("slope"))


@query("enforce_slope", "profile", sql="SELECT node, round(max(elevation - 0.5 * pos) OVER (PARTITION BY source_key ORDER BY pos) + 0.5 * pos, 6) AS elevation FROM profile")
def _(profile_):
    p = profile_.withColumn("flow_distance", F.col("pos").cast("double"))
    return rounded(profile.enforce_slope(p, 0.5).select("node", "elevation"), "elevation")


@query("thin_profile", "profile", sql="SELECT node FROM (SELECT node, row_number() OVER (PARTITION BY source_key, floor(pos / 7.0) ORDER BY pos) AS r FROM profile) WHERE r = 1")
def _(profile_):
    return profile.thin_by_spacing(profile_.withColumn("flow_distance", F.col("pos").cast("double")), 7.0).select("node")


@query("sort_thin_skip", "profile", sql="SELECT node FROM (SELECT node, row_number() OVER (PARTITION BY source_key ORDER BY pos) AS r FROM profile) WHERE (r - 1) % 4 = 0")
def _(profile_):
    return profile.thin_by_skip(profile_, 3).select("node")


# --- components ---

COMPONENT_SQL = GRID_SQL + f""",
hot AS (SELECT row, col, node FROM grid WHERE value > 56000),
reach(node, row, col, label) AS (SELECT node, row, col, node FROM hot UNION SELECT n.node, n.row, n.col, r.label FROM reach r JOIN {STEPS_SQL} ON true JOIN hot n ON n.row = r.row + k.dr AND n.col = r.col + k.dc)"""


def hot(cells: DataFrame) -> DataFrame:
    return morphology.components(algebra.mask_below(cells, 56000.000001), spec().ncols)


@query("connected_components", "cells", recursive=True, more=COMPONENT_SQL, sql='SELECT row AS "row", col, min(label) AS component FROM reach GROUP BY 1, 2')
def _(cells):
    return hot(cells)


@query("small_patch_filter", "cells", recursive=True, more=COMPONENT_SQL + ", c AS (SELECT row, col, min(label) AS component FROM reach GROUP BY 1, 2)", sql='SELECT row AS "row", col, component, n FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM c) WHERE n >= 4')
def _(cells):
    return morphology.patches_of_size(hot(cells), 4)


@query("isolated_corner_cells", "cells", more="hot AS (SELECT row, col FROM cells WHERE value > 53000)", sql='SELECT h.row AS "row", h.col FROM hot h WHERE EXISTS (SELECT 1 FROM hot n WHERE abs(n.row - h.row) + abs(n.col - h.col) = 1)')
def _(cells):
    return morphology.remove_checkerboard(algebra.to_mask(cells, F.col("value") > 53000)).select("row", "col")


# --- places and nuclides ---


@query("utm_forward", "samples", more="""p AS (SELECT sample, longitude, latitude, radians(latitude) AS la, least(60, floor((longitude + 180) / 6) + 1) AS zone, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e FROM samples),
q AS (SELECT *, e / (1 - e) AS ep, tan(la) * tan(la) AS t, cos(la) * cos(la) * e / (1 - e) AS c, 6378137.0::DOUBLE / sqrt(1 - sin(la) * sin(la) * e) AS n, radians(longitude - ((zone - 1) * 6 - 177)) * cos(la) AS a,
  6378137.0::DOUBLE * (la * (1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) - sin(la * 2) * (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) + sin(la * 4) * (15 * e * e / 256 + 45 * e * e * e / 1024) - sin(la * 6) * (35 * e * e * e / 3072)) AS m FROM p)""", sql="""SELECT sample, CAST(zone AS INT) AS zone,
  round(n * (a + (1 - t + c) * a * a * a / 6 + (5 - t * 18 + t * t + c * 72 - 58 * ep) * a * a * a * a * a / 120) * 0.9996 + 500000, 3) AS easting,
  round((m + n * tan(la) * (a * a / 2 + (5 - t + c * 9 + c * c * 4) * a * a * a * a / 24 + (61 - t * 58 + t * t + c * 600 - 330 * ep) * a * a * a * a * a * a / 720)) * 0.9996 + CASE WHEN latitude < 0 THEN 10000000 ELSE 0 END, 3) AS northing FROM q""")
def _(samples):
    lat, lon = F.col("latitude"), F.col("longitude")
    e, n = geo.to_utm(lat, lon)
    return samples.select("sample", geo.utm_zone(lon).alias("zone"), F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("be10_steady_state", "samples", more="e AS (SELECT sample, CAST(conc AS DOUBLE) / 1e8 AS rate FROM samples)", sql="SELECT sample, round(4.30::DOUBLE * (0.9887::DOUBLE / (rate / 160 + 4.99e-7) + 0.0027::DOUBLE / (rate / 738.6::DOUBLE + 4.99e-7) + 0.0086::DOUBLE / (rate / 2688 + 4.99e-7)), 2) AS conc FROM e")
def _(samples):
    return samples.select("sample", F.round(nuclide.steady_concentration(F.col("conc") / 1e8), 2).alias("conc"))


@query("atmospheric_pressure", "samples", sql="SELECT sample, round(1013.25 * exp(-0.03417 / 0.0065 * (ln(288.15) - ln(288.15 - conc / 1000.0 * 0.0065))), 4) AS hpa FROM samples")
def _(samples):
    return samples.select("sample", F.round(nuclide.pressure(F.col("conc") / 1000), 4).alias("hpa"))


@query("sinmap_safety", "cells", more="s AS (SELECT row, col, 0.1 + (value % 500) / 1000 AS a FROM cells)", sql='SELECT row AS "row", col, round((0.2 + cos(a) * (1 - 0.4 * 0.5) * tan(0.6)) / sin(a), 6) AS fs FROM s')
def _(cells):
    s = cells.withColumn("a", 0.1 + (F.col("value") % 500) / 1000)
    return s.select("row", "col", r6(soil.factor_of_safety(F.lit(0.2), F.lit(0.4), 0.5, F.col("a"), F.lit(0.6))).alias("fs"))


AIR_SQL = "air AS (SELECT sample, abs(latitude) AS lat, 1013.25 * exp(-0.03417 / 0.0065 * (ln(288.15) - ln(288.15 - conc / 1000.0 * 0.0065))) AS hpa, 14.9 * power(cos(radians(latitude)), 4) AS r FROM samples)"


def _stone_sql(hpa: str) -> str:
    """Scaling at each tabled latitude as a list."""
    terms = [f"({a}::DOUBLE + {b}::DOUBLE * exp({hpa} / -150.0) + ({c}::DOUBLE) * {hpa} + {d!r}::DOUBLE * {hpa} * {hpa} + ({e!r}::DOUBLE) * {hpa} * {hpa} * {hpa}) * 0.978::DOUBLE + exp((1013.25 - {hpa}) / 242.0) * {muon * (1 - 0.978)!r}::DOUBLE" for a, b, c, d, e, muon in nuclide.STONE]
    return "[" + ", ".join(terms) + "]"


def _depth_sql(x: str) -> str:
    """The attenuation integral of the Desilets model down to a depth."""
    n, alpha, k, *rows = nuclide.DESILETS
    more = " + ".join(f"(({a!r}::DOUBLE) + ({b!r}::DOUBLE) * q + ({c!r}::DOUBLE) * q * q) * power({x}, {i}) / {i}" for i, (a, b, c) in enumerate(rows, 2))
    return f"({n!r}::DOUBLE * {x} / (1 + exp(-({alpha!r}::DOUBLE) * power(q, -({k!r}::DOUBLE)))) + {more})"


_L, _S = nuclide.LIFTON, 0.95
_STONE_SQL = "(t[CAST(least(5, floor(l / 10)) AS INT) + 1] * (1 - (l / 10 - least(5, floor(l / 10)))) + t[CAST(least(5, floor(l / 10)) AS INT) + 2] * (l / 10 - least(5, floor(l / 10))))"
for _name, _scale, _more, _sql in (
    ("scaling_stone", lambda s: nuclide.stone_scaling(F.col("latitude"), nuclide.pressure(F.col("conc") / 1000)), f"p AS (SELECT sample, least(lat, 60.0) AS l, {_stone_sql('hpa')} AS t FROM air)", _STONE_SQL),
    ("scaling_dunai", lambda s: nuclide.dunai_scaling(nuclide.pressure(F.col("conc") / 1000), nuclide.cutoff_rigidity(F.col("latitude"))), "p AS (SELECT sample, hpa, 0.4952 + 0.5221 / power(1 + exp((r - 4.2822) / 1.7211), 0.3345) AS l, 130.11 + 17.183 / power(1 + exp((r - 2.2964) / -2.060), 5.9164) AS len FROM air)", "l * exp((1013.25 - hpa) * 1.019716 / len)"),
    ("scaling_desilets", lambda s: nuclide.desilets_scaling(nuclide.pressure(F.col("conc") / 1000), nuclide.cutoff_rigidity(F.col("latitude"))), "p AS (SELECT sample, greatest(r, 2.0) AS q, hpa * 1.019716::DOUBLE AS x FROM air)", f"(1 - exp(-10.275 * power(q, -0.9615))) * exp({_depth_sql('1033.0::DOUBLE')} - {_depth_sql('x')})"),
    ("scaling_lifton", lambda s: nuclide.lifton_scaling(nuclide.pressure(F.col("conc") / 1000), nuclide.cutoff_rigidity(F.col("latitude"))), "p AS (SELECT sample, greatest(r, 1.907) AS q, hpa * 1.019716::DOUBLE AS x FROM air)",
     f"exp({_L[0]}::DOUBLE * ln(x * {_S}) - {_S}::DOUBLE * exp({_L[1] * _S!r}::DOUBLE / power(q + {5 * _S!r}::DOUBLE, {2 * _S!r}::DOUBLE)) + ({_L[2]}::DOUBLE) * power(x, {_L[3]}::DOUBLE) + {_L[4]!r}::DOUBLE * power((q + {4 * _S!r}::DOUBLE) * x, {_L[5]}::DOUBLE) + ({_L[6]}::DOUBLE) * power(q + {4 * _S!r}::DOUBLE, {_L[7]}::DOUBLE))"),
):
    query(_name, "samples", more=AIR_SQL + ",\n" + _more, sql=f"SELECT sample, round({_sql}, 6) AS scaling FROM p")(lambda s, f=_scale: s.select("sample", r6(f(s)).alias("scaling")))


# --- more of networks and landforms ---


def outlets_of(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = d8(cells)
    counts = flow.store(flow.contributing(nodes), "counts")
    return nodes, counts, flow.store(network.prune_by_size(counts, 4, 20).select("node"), "outlets")


OUTS = D8_WAYS + ",\n" + COUNTS + ",\nouts AS (SELECT node FROM counts WHERE n_contrib BETWEEN 4 AND 20)"


@query("nesting_map", "cells", recursive=True, more=OUTS + ",\npairs AS (SELECT w.ancestor AS outlet, w.node AS inside, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS depth FROM ways w JOIN outs a ON a.node = w.ancestor JOIN outs b ON b.node = w.node WHERE w.steps > 0)", sql="SELECT outlet, inside, CAST(depth AS INT) AS depth FROM pairs")
def _(cells):
    nodes, _counts, outlets = outlets_of(cells)
    return network.nesting(nodes, outlets).withColumn("depth", F.col("depth").cast("int"))


@query("prune_elevation", "cells", recursive=True, more=OUTS, sql="SELECT o.node FROM outs o JOIN nodes n ON n.node = o.node WHERE n.z BETWEEN 40000 AND 48000")
def _(cells):
    nodes, _counts, outlets = outlets_of(cells)
    return network.prune_elevation(outlets, nodes, 40000.0, 48000.0)


@query("upstream_histogram", "cells", recursive=True, more=OUTS, sql="SELECT w.ancestor AS outlet, CAST(floor(n.z / 2000) AS BIGINT) AS bin, count(*) AS n FROM ways w JOIN outs o ON o.node = w.ancestor JOIN nodes n ON n.node = w.node GROUP BY 1, 2")
def _(cells):
    nodes, _counts, outlets = outlets_of(cells)
    return routing.upstream_histogram(nodes, outlets, nodes, 2000.0)


@query("drainage_density", "cells", recursive=True, more=CHANNEL_SQL + ",\nmembers AS (SELECT w.node, w.ancestor AS basin FROM ways w JOIN nodes a ON a.node = w.ancestor AND a.receiver = a.node), len AS (SELECT m.basin, sum(c.dx) AS l FROM members m JOIN channel c ON c.node = m.node GROUP BY 1), area AS (SELECT basin, count(*) AS a FROM members GROUP BY 1)", sql="SELECT area.basin, round(l / a, 6) AS density, round(CASE WHEN l > 0 THEN 1 / (2 * l / a) END, 6) AS hillslope_length FROM area JOIN len ON len.basin = area.basin")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    members = flow.to_root(nodes).select("node", F.col("root").alias("basin"))
    return rounded(network.drainage_density(members, channel), "density", "hillslope_length")


@query("basin_summary", "cells", recursive=True, more=D8_WAYS, sql="SELECT w.ancestor AS basin, CAST(count(*) AS DOUBLE) AS area, round(avg(n.row), 6) AS centre_row, round(avg(n.z), 6) AS z_mean, round(quantile_cont(n.z, 0.5), 6) AS z_median, min(n.z) AS z_min, max(n.z) AS z_max FROM ways w JOIN nodes a ON a.node = w.ancestor AND a.receiver = a.node JOIN nodes n ON n.node = w.node GROUP BY 1")
def _(cells):
    nodes = d8(cells)
    members = flow.to_root(nodes).select("node", F.col("root").alias("basin")).join(nodes.select("node", "row", "col", "z"), "node")
    return rounded(network.basin_summary(members, ["z"]).select("basin", F.col("area").cast("double").alias("area"), "centre_row", "z_mean", "z_median", "z_min", "z_max"), "centre_row", "z_mean", "z_median")


@query("largest_complete_basins", "cells", recursive=True, more=D8_WAYS + ",\n" + COUNTS + ",\nedge AS (SELECT DISTINCT w.ancestor AS node FROM ways w JOIN nodes n ON n.node = w.node, size WHERE n.row IN (0, size.n - 1) OR n.col IN (0, size.n - 1)), free AS (SELECT c.node, c.n_contrib, r.ancestor AS root FROM counts c JOIN ways r ON r.node = c.node JOIN nodes a ON a.node = r.ancestor AND a.receiver = a.node WHERE c.node NOT IN (SELECT node FROM edge)), p AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n_contrib DESC, node) AS k FROM free)", sql="SELECT root, node, n_contrib FROM p WHERE k = 1")
def _(cells):
    nodes = d8(cells)
    edge = F.when((F.col("row").isin(0, spec().nrows - 1)) | (F.col("col").isin(0, spec().ncols - 1)), 1).otherwise(0)
    touched = flow.accumulate(nodes, {}, {"touched": edge}).where("touched = 1").select("node")
    return network.largest_complete(nodes, flow.contributing(nodes), touched)


@query("move_heads_down", "cells", recursive=True, more=D8_WAYS + ",\nm AS (SELECT node, arg_max(ancestor, steps) AS moved FROM ways WHERE distance <= 2.5 GROUP BY node)", sql="SELECT node, moved FROM m")
def _(cells):
    nodes = d8(cells)
    return routing.move_heads_down(nodes, nodes.select("node"), 2.5)


@query("slope_between_nodes", "cells", recursive=True, more=D8_WAYS, sql="SELECT w.node AS a, w.ancestor AS b, round(w.distance, 6) AS length, round((a.z - b.z) / w.distance + 3e-8::DOUBLE, 6) AS slope FROM ways w JOIN nodes a ON a.node = w.node JOIN nodes b ON b.node = w.ancestor WHERE w.steps = 2")
def _(cells):
    nodes = d8(cells)
    pairs = flow.store(flow.ancestors(nodes).where("steps = 2").select(F.col("node").alias("a"), F.col("ancestor").alias("b")), "pairs")
    return nudged(rounded(routing.slope_between(nodes, pairs), "length"), "slope")


@query("hillslope_lengths", "cells", recursive=True, more=CHANNEL_SQL + ",\nnear AS (SELECT w.node, w.ancestor, w.distance, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS place FROM ways w JOIN channel c ON c.node = w.ancestor)", sql="SELECT n.node, n.ancestor AS channel_node, round(n.distance, 6) AS length, round(a.z - b.z, 6) AS relief, round(CASE WHEN n.distance > 0 THEN (a.z - b.z) / n.distance END, 6) AS slope FROM near n JOIN nodes a ON a.node = n.node JOIN nodes b ON b.node = n.ancestor WHERE place = 1 AND a.z > 60000")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return rounded(routing.hillslopes(nodes, nodes.where("z > 60000"), channel), "length", "relief", "slope")


@query("bordered_by_nodata", "cells", more="c AS (SELECT row, col FROM cells WHERE value < 56000)", sql=f'SELECT * FROM (SELECT c.row AS "row", c.col, CAST(8 - count(n.row) AS INT) AS gaps FROM c JOIN {STEPS_SQL} ON true LEFT JOIN c n ON n.row = c.row + k.dr AND n.col = c.col + k.dc GROUP BY 1, 2) WHERE gaps > 0')
def _(cells):
    return landforms.bordered_by_nodata(cells.where("value < 56000"))


@query("terrain_shape_index", "cells", more=W3, sql='SELECT row AS "row", col, round((8 * z - (n0 + n1 + n2 + n3 + n4 + n5 + n6 + n7)) / 8 / ((12 + 8 * sqrt(2.0)) / 20), 4) AS value FROM w3 WHERE n0 + n1 + n2 + n3 + n4 + n5 + n6 + n7 IS NOT NULL')
def _(cells):
    return landforms.terrain_shape(cells).withColumn("value", F.round("value", 4))


@query("box_plot", "profile", more="q AS (SELECT source_key, quantile_cont(elevation, 0.25) AS q1, quantile_cont(elevation, 0.5) AS median, quantile_cont(elevation, 0.75) AS q3 FROM profile GROUP BY 1)", sql="SELECT p.source_key, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(elevation) FILTER (elevation >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(elevation) FILTER (elevation <= q3 + 1.5 * (q3 - q1)) AS whisker_high FROM profile p JOIN q ON q.source_key = p.source_key GROUP BY p.source_key, q1, median, q3")
def _(profile_):
    return rounded(stats.box_plot(profile_, ["source_key"], "elevation"), "q1", "median", "q3")


@query("distribution_shape", "profile", more="m AS (SELECT source_key, avg(elevation) AS m FROM profile GROUP BY 1), c AS (SELECT p.source_key, elevation, elevation - m AS d FROM profile p JOIN m ON m.source_key = p.source_key)", sql="SELECT source_key, round(sqrt(avg(elevation * elevation)), 6) AS quadratic_mean, round(avg(d * d * d) / power(avg(d * d), 1.5), 6) AS skewness, round(avg(d * d * d * d) / power(avg(d * d), 2), 6) AS kurtosis FROM c GROUP BY 1")
def _(profile_):
    return rounded(stats.distribution(profile_, ["source_key"], "elevation"), "quadratic_mean", "skewness", "kurtosis")


@query("mid_ranks", "profile", sql="SELECT node, rank() OVER (ORDER BY elevation) + (count(*) OVER (PARTITION BY elevation) - 1) / 2 AS rank FROM profile")
def _(profile_):
    return stats.mid_ranks(profile_, "elevation").select("node", "rank")


@query("bilinear_points", "points", "cells", more="p AS (SELECT id, x + CAST(0.13 AS DOUBLE) AS x, y - CAST(0.21 AS DOUBLE) AS y FROM points), q AS (SELECT id, x - 0.5 AS u, size.n - y - 0.5 AS v FROM p, size), k AS (SELECT id, CAST(floor(v) AS INT) + i AS row, CAST(floor(u) AS INT) + j AS col, (CASE WHEN i = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))", sql="SELECT id, round(CASE WHEN count(*) = count(value) THEN sum(w * value) END, 4) AS value FROM k LEFT JOIN cells c ON c.row = k.row AND c.col = k.col WHERE w > 0 GROUP BY id")
def _(points, cells):
    found = joins.bilinear(points.withColumns({"x": F.col("x") + 0.13, "y": F.col("y") - 0.21}), cells, spec())
    return found.withColumn("value", F.round("value", 4))


@query("swath_coordinates", "points", sql="SELECT id, round(greatest(CAST(0 AS DOUBLE), least(CAST(50 AS DOUBLE), (x - 5) * 0.6 + (y - 10) * 0.8)), 6) AS along FROM points")
def _(points):
    return rounded(landforms.swath_coordinates(points, [(5.0, 10.0), (35.0, 50.0)]).select("id", "along"), "along")


@query("ridges", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED, sql=f'SELECT DISTINCT b.row AS "row", b.col, b.basin FROM rooted b JOIN {STEPS_SQL} ON true JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc WHERE n.basin <> b.basin')
def _(cells):
    return landforms.ridges(cells, rooted(cells))


@query("edge_influenced", "cells", recursive=True, more=D8_WAYS + f",\nrim AS (SELECT c.node FROM grid c JOIN {STEPS_SQL} ON true LEFT JOIN cells n ON n.row = c.row + k.dr AND n.col = c.col + k.dc GROUP BY 1 HAVING count(n.row) < 8)", sql="SELECT DISTINCT w.ancestor AS node FROM ways w JOIN rim ON rim.node = w.node")
def _(cells):
    return flow.edge_influenced(d8(cells), cells, spec())


@query("greatest_in_window", "points", "cells", more=SPOTS_SQL + ",\nw AS (SELECT p.id, c.row, c.col, c.value FROM spots p JOIN cells c ON c.row BETWEEN p.r0 - 1 AND p.r0 + 1 AND c.col BETWEEN p.c0 - 1 AND p.c0 + 1)", sql="SELECT id, max(value) AS value FROM w GROUP BY id")
def _(points, cells):
    return joins.greatest_within(joins.in_cells(points, spec()), cells, 1).select("id", "value")


# --- channels, flow shared among neighbours, traces ---

STEM_SQL = CHANNEL_SQL + """,
chways AS (SELECT w.* FROM ways w JOIN channel c ON c.node = w.node),
far AS (SELECT w.ancestor AS outlet, w.node, row_number() OVER (PARTITION BY w.ancestor ORDER BY round(w.distance, 9) DESC, w.node) AS place FROM chways w JOIN channel o ON o.node = w.ancestor AND o.receiver = o.node),
stem AS (SELECT f.outlet, w.ancestor AS node, w.steps AS step FROM far f JOIN chways w ON w.node = f.node WHERE f.place = 1)"""


@query("main_stems", "cells", recursive=True, more=STEM_SQL, sql="SELECT outlet, node, step FROM stem")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return landforms.main_stem(channel, flow.base_level(channel).select("node"))


@query("tributaries", "cells", recursive=True, more=STEM_SQL, sql="SELECT s.outlet, c.node, c.receiver AS junction FROM channel c JOIN stem s ON s.node = c.receiver LEFT JOIN stem m ON m.outlet = s.outlet AND m.node = c.node WHERE c.node <> c.receiver AND m.node IS NULL")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return landforms.tributaries(channel, flow.store(landforms.main_stem(channel, flow.base_level(channel).select("node")), "stem"))


DOWN_SQL = f"downs AS (SELECT c.row, c.col, n.row AS to_row, n.col AS to_col, k.k, (c.value - n.value) / sqrt(CAST(k.d2 AS DOUBLE)) AS fall FROM cells c JOIN {STEPS_SQL} ON true JOIN cells n ON n.row = c.row + k.dr AND n.col = c.col + k.dc WHERE c.value > n.value)"
SHARED_SQL = """,
edges AS (SELECT row, col, to_row, to_col, w / sum(w) OVER (PARTITION BY row, col) AS w FROM weighed),
moving(row, col, q, step) AS (SELECT row, col, CAST(1 AS DOUBLE), 0 FROM cells UNION ALL SELECT e.to_row, e.to_col, sum(f.q * e.w), f.step + 1 FROM moving f JOIN edges e ON e.row = f.row AND e.col = f.col GROUP BY e.to_row, e.to_col, f.step)"""
AREA_SQL = 'SELECT row AS "row", col, round(sum(q), 6) AS area FROM moving GROUP BY 1, 2'


@query("quinn_flow", "cells", recursive=True, more=DOWN_SQL + ",\nweighed AS (SELECT *, fall * CASE WHEN k % 2 = 1 THEN 0.354::DOUBLE ELSE 0.5::DOUBLE END AS w FROM downs)" + SHARED_SQL, sql=AREA_SQL)
def _(cells):
    return rounded(routing.spread_flow(cells, routing.weighted_edges(cells, "quinn")), "area")


@query("two_way_flow", "cells", recursive=True, more=DOWN_SQL + ",\nweighed AS (SELECT *, fall AS w FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY fall DESC, k) AS place FROM downs) WHERE place <= 2)" + SHARED_SQL, sql=AREA_SQL)
def _(cells):
    return rounded(routing.spread_flow(cells, routing.weighted_edges(cells, "two")), "area")


@query("multiple_flow", "cells", recursive=True, more=DOWN_SQL + ",\nweighed AS (SELECT *, power(fall, 1.1::DOUBLE) AS w FROM downs)" + SHARED_SQL, sql=AREA_SQL)
def _(cells):
    return rounded(flow.multiple_flow(cells, spec()), "area")


#: Facets: (edge neighbour, corner neighbour, sign, quarter turns), and the directions that leave a flat without any.
_FACETS = [(2, 1, 1, 0), (0, 1, -1, 1), (0, 7, 1, 1), (6, 7, -1, 2), (6, 5, 1, 2), (4, 5, -1, 3), (4, 3, 1, 3), (2, 3, -1, 4)]
FACET_SQL = W3 + ",\nfacets AS (" + " UNION ALL ".join(f"SELECT row, col, z - n{e} AS s1, n{e} - n{c} AS s2, (z - n{c}) / sqrt(2.0::DOUBLE) AS s3, {sign} AS sign, {turns} AS turns FROM w3" for e, c, sign, turns in _FACETS) + """),
tops AS (SELECT row, col, arg_max(angle, (slope, angle)) AS angle, max(slope) AS slope FROM (
  SELECT row, col, CASE WHEN atan2(s2, s1) < 0 THEN s1 WHEN atan2(s2, s1) > pi() / 4 THEN s3 ELSE sqrt(s1 * s1 + s2 * s2) END AS slope,
    sign * CASE WHEN atan2(s2, s1) < 0 THEN 0::DOUBLE WHEN atan2(s2, s1) > pi() / 4 THEN pi() / 4 ELSE atan2(s2, s1) END + turns * (pi() / 2) AS angle FROM facets WHERE s1 IS NOT NULL AND s2 IS NOT NULL) WHERE slope > 0 GROUP BY 1, 2),
ways8 AS (SELECT w.row, w.col, w.z, t.angle - 2 * pi() * floor(t.angle / (2 * pi())) AS angle, coalesce(t.slope, 0) AS slope FROM w3 w LEFT JOIN tops t ON t.row = w.row AND t.col = w.col)"""
_RING = ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate([(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1)]))


@query("d_infinity", "cells", more=FACET_SQL, sql='SELECT row AS "row", col, round(angle, 6) AS angle, round(slope, 6) AS slope FROM ways8')
def _(cells):
    return rounded(flow.d_infinity(cells), "angle", "slope")


#: Edges of facet directions: flow is shared by the two neighbours beside the direction.
INFINITE_SQL = FACET_SQL + f""",
weighed AS (SELECT t.row, t.col, t.row + k.dr AS to_row, t.col + k.dc AS to_col, CASE o.o WHEN 0 THEN 1 - share ELSE share END AS w
  FROM (SELECT row, col, CAST(floor(angle / (pi() / 4)) AS INT) % 8 AS f, angle / (pi() / 4) - floor(angle / (pi() / 4)) AS share FROM ways8 WHERE angle IS NOT NULL) t, (VALUES (0), (1)) o(o), (VALUES {_RING}) k(i, dr, dc)
  WHERE k.i = t.f + o.o AND CASE o.o WHEN 0 THEN 1 - share ELSE share END > 0)"""


@query("d_infinity_area", "cells", recursive=True, more=INFINITE_SQL + SHARED_SQL, sql=AREA_SQL)
def _(cells):
    return rounded(routing.spread_flow(cells, routing.infinity_edges(cells)), "area")


@query("hilltop_traces", "cells", recursive=True, more=CHANNEL_SQL + ",\n" + FACET_SQL + """,
place AS (SELECT n.node, n.row, n.col, n.z, d.angle, h.node IS NOT NULL AS stop FROM nodes n LEFT JOIN ways8 d ON d.row = n.row AND d.col = n.col LEFT JOIN channel h ON h.node = n.node),
traces(start, r, c, length, row, col, z, angle, stop, row0, col0, climbs) AS (
  SELECT node, row + 0.5::DOUBLE, col + 0.5::DOUBLE, 0::DOUBLE, row, col, z, angle, stop, NULL::INT, NULL::INT, false FROM place WHERE z > 65000
  UNION ALL SELECT t.start, t.r2, t.c2, t.length + 0.5, t.row2, t.col2, p.z, p.angle, coalesce(p.stop, false), t.row, t.col, coalesce(p.z >= t.z AND (t.row2 <> t.row OR t.col2 <> t.col), false)
  FROM (SELECT *, r - sin(angle) * 0.5 AS r2, c + cos(angle) * 0.5 AS c2, CAST(floor(r - sin(angle) * 0.5) AS INT) AS row2, CAST(floor(c + cos(angle) * 0.5) AS INT) AS col2 FROM traces WHERE angle IS NOT NULL AND NOT stop AND NOT climbs) t
  LEFT JOIN place p ON p.row = t.row2 AND p.col = t.col2)""", sql='SELECT start, CASE WHEN climbs THEN row0 ELSE row END AS "row", CASE WHEN climbs THEN col0 ELSE col END AS col, length FROM traces WHERE climbs OR stop OR angle IS NULL')  # fmt: skip
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return routing.aspect_traces(cells, nodes.where("z > 65000").select("row", "col"), channel.select("row", "col"), spec())


@query("breach", "cells")
def _(cells):
    return routing.breach(cells, spec().nrows, spec().ncols, 0.001)


@query("flow_bearings", "cells", recursive=True, more=D8_WAYS + ",\nb AS (SELECT a.node AS start, a.steps AS step, a.ancestor AS node, degrees(atan2(CAST(q.col - p.col AS DOUBLE), CAST(p.row - q.row AS DOUBLE))) AS d FROM ways a JOIN ways e ON e.node = a.node AND e.steps = a.steps + 2 JOIN nodes p ON p.node = a.ancestor JOIN nodes q ON q.node = e.ancestor)", sql="SELECT start, step, node, round(d - 360 * floor(d / 360), 6) AS bearing FROM b")
def _(cells):
    nodes = d8(cells)
    paths = flow.flow_paths(nodes, nodes)
    return rounded(routing.bearings(paths, nodes.select("node", spec().x(F.col("col")).alias("x"), spec().y(F.col("row")).alias("y")), 2), "bearing")


#: Stream order over the channel by rounds: a node has one as soon as all its donors have.
STRAHLER_SQL = """,
ranks(node, receiver, o, step) AS (
  SELECT c.node, c.receiver, CASE WHEN f.n_donors = 0 THEN 1 END, 0 FROM channel c JOIN feeds f ON f.node = c.node
  UNION ALL SELECT r.node, r.receiver, CASE WHEN r.o IS NOT NULL THEN r.o WHEN count(d.node) = count(d.o) THEN max(d.o) + CASE WHEN list_sort(list(d.o), 'DESC')[2] = max(d.o) THEN 1 ELSE 0 END END, r.step + 1
  FROM ranks r LEFT JOIN ranks d ON d.receiver = r.node AND d.node <> r.node WHERE r.step < (SELECT max(steps) FROM ways) GROUP BY r.node, r.receiver, r.o, r.step),
strahler AS (SELECT node, o AS stream_order FROM ranks WHERE step = (SELECT max(steps) FROM ways))"""


@query("junction_angle_statistics", "cells", recursive=True, more=CHANNEL_SQL + STRAHLER_SQL + ",\n" + ANGLE_SQL.replace("FROM nodes d JOIN nodes r", "FROM channel d JOIN nodes r") + ",\nangles AS (SELECT a.receiver AS node, degrees(acos(greatest(-1.0, least(1.0, (a.u * b.u + a.v * b.v) / sqrt((a.u * a.u + a.v * a.v) * (b.u * b.u + b.v * b.v)))))) AS angle FROM vecs a JOIN vecs b ON a.receiver = b.receiver AND a.node < b.node)", sql="SELECT s.stream_order, round(avg(angle), 4) AS mean, round(quantile_cont(angle, 0.5), 4) AS median, round(stddev_pop(angle), 4) AS sd, count(*) AS n FROM angles a JOIN strahler s ON s.node = a.node GROUP BY 1")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    places = nodes.select("node", spec().x(F.col("col")).alias("x"), spec().y(F.col("row")).alias("y"))
    found = network.angle_statistics(network.junction_angles(channel, places), network.strahler(channel))
    return found.select("stream_order", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd")], "n")


KEYS_SQL = CHANNEL_SQL + """,
heads AS (SELECT f.node FROM feeds f WHERE f.n_donors = 0),
remote AS (SELECT w.node, max(w.distance) AS d, max(w.steps) AS depth FROM ways w GROUP BY w.node),
pick AS (SELECT w.ancestor AS node, h.node AS source_key, w.steps AS pos, row_number() OVER (PARTITION BY w.ancestor ORDER BY round(remote.d, 6) DESC, h.node) AS place FROM ways w JOIN heads h ON h.node = w.node JOIN remote ON remote.node = h.node)"""


@query("overlapping_channels", "cells", recursive=True, more=KEYS_SQL + ",\nown AS (SELECT source_key, node, pos FROM pick WHERE place = 1), last AS (SELECT source_key, max(pos) AS pos FROM own GROUP BY 1)", sql="SELECT w.node AS source_key, w.ancestor AS node, w.steps AS pos, w.steps <= l.pos AS own FROM ways w JOIN last l ON l.source_key = w.node WHERE w.steps <= l.pos + 3")
def _(cells):
    nodes, counts, channel = channel_of(cells)
    return network.overlapping_channels(channel, flow.sources_by_area(nodes, counts, 3), 3)


@query("internal_nodes", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED, sql=f'SELECT b.row AS "row", b.col, b.basin FROM rooted b JOIN {STEPS_SQL} ON true JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc AND n.basin = b.basin GROUP BY 1, 2, 3 HAVING count(*) = 8')
def _(cells):
    return network.internal_nodes(rooted(cells))


@query("tag_downstream", "cells", recursive=True, more=D8_WAYS + ",\ntagged AS (SELECT n.node, n.node % 5 AS tag FROM nodes n WHERE n.z > 60000), reached AS (SELECT w.ancestor AS node, t.tag, row_number() OVER (PARTITION BY w.ancestor ORDER BY w.steps, w.distance, w.node) AS place FROM ways w JOIN tagged t ON t.node = w.node LEFT JOIN tagged o ON o.node = w.ancestor WHERE w.distance <= 3 AND (w.steps = 0 OR o.node IS NULL))", sql="SELECT node, tag FROM reached WHERE place = 1")
def _(cells):
    nodes = d8(cells)
    return routing.tag_downstream(nodes, nodes.where("z > 60000").select("node", (F.col("node") % 5).alias("tag")), 3.0)


@query("base_level_sides", "cells", recursive=True, more=D8_SQL + ",\nlevelled AS (SELECT n.node, CASE WHEN n.row = 0 OR n.col = size.n - 1 THEN n.node ELSE n.receiver END AS receiver FROM nodes n, size),\nroots(node, root) AS (SELECT node, node FROM levelled WHERE node = receiver UNION ALL SELECT l.node, r.root FROM roots r JOIN levelled l ON l.receiver = r.node AND l.node <> l.receiver)", sql="SELECT root, count(*) AS n FROM roots GROUP BY root")
def _(cells):
    return flow.to_root(flow.d8(cells, spec(), base="ne")).groupBy("root").agg(F.count("*").alias("n"))


@query("value_peaks", "profile", more="c AS (SELECT source_key, pos, elevation, elevation - lag(elevation) OVER w AS up, lead(elevation) OVER w - elevation AS down FROM profile WINDOW w AS (PARTITION BY source_key ORDER BY pos)), k AS (SELECT * FROM c WHERE up > 0 AND down < 0 AND elevation > 60)", recursive=True, sql="""SELECT source_key, pos, elevation FROM (
  WITH RECURSIVE left_over(source_key, pos, elevation, step, kept) AS (SELECT source_key, pos, elevation, 0, false FROM k
    UNION ALL SELECT source_key, pos, elevation, step, kept FROM (
      SELECT l.source_key, l.pos, l.elevation, l.step + 1 AS step, row_number() OVER g = 1 AS kept, first_value(l.pos) OVER g AS top FROM left_over l WHERE NOT l.kept WINDOW g AS (PARTITION BY l.source_key ORDER BY l.elevation DESC, l.pos DESC))
    WHERE kept OR abs(pos - top) > 4) SELECT * FROM left_over) WHERE kept""")
def _(profile_):
    return stats.peaks(profile_, ["source_key"], "pos", "elevation", 60.0, 4)


# --- profiles and their segments ---


@query("channel_heads_chi", "profile", more="""p AS (SELECT source_key, node, pos, CAST(pos AS DOUBLE) AS x, elevation AS y, elevation - lag(elevation) OVER w AS dy, count(*) OVER (PARTITION BY source_key) AS n FROM profile WINDOW w AS (PARTITION BY source_key ORDER BY pos)),
cuts AS (SELECT source_key, pos AS cut FROM p WHERE pos BETWEEN 10 AND n - 10),
low AS (SELECT c.source_key, c.cut, CASE WHEN var_pop(p.y) > 0 THEN power(corr(p.y, p.x), 2) ELSE 0 END AS r2 FROM cuts c JOIN p ON p.source_key = c.source_key AND p.pos <= c.cut GROUP BY 1, 2),
up AS (SELECT c.source_key, c.cut, regr_slope(p.y, p.x) AS m, regr_intercept(p.y, p.x) AS b FROM cuts c JOIN p ON p.source_key = c.source_key AND p.pos > c.cut GROUP BY 1, 2),
dw AS (SELECT u.source_key, u.cut, sum(CASE WHEN p.pos > u.cut + 1 THEN (p.dy - u.m) * (p.dy - u.m) END) / greatest(1e-300, sum((p.y - u.m * p.x - u.b) * (p.y - u.m * p.x - u.b))) AS dw FROM up u JOIN p ON p.source_key = u.source_key AND p.pos > u.cut GROUP BY 1, 2),
scored AS (SELECT l.source_key, l.cut, l.r2 - (d.dw - 2) / 2 AS score, row_number() OVER (PARTITION BY l.source_key ORDER BY round(l.r2 - (d.dw - 2) / 2, 9) DESC, l.cut DESC) AS place FROM low l JOIN dw d ON d.source_key = l.source_key AND d.cut = l.cut)""",
    sql="SELECT p.source_key, p.node, round(s.score, 6) AS score FROM p LEFT JOIN scored s ON s.source_key = p.source_key AND s.place = 1 WHERE p.pos = coalesce(s.cut, 1)")
def _(profile_):
    return rounded(landforms.chi_heads(profile_.withColumn("chi", F.col("pos").cast("double"))), "score")


_POISSON = " + ".join(f"CASE WHEN u > {x!r}::DOUBLE THEN 1 ELSE 0 END" for x in stats.poisson_steps())


@query("bootstrap_regression", "profile", more=f"""u AS (SELECT source_key, r, CAST(pos AS DOUBLE) AS x, elevation AS y, CAST(('0x' || substr(md5('1:' || r || ':' || node), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u FROM profile, (SELECT unnest(range(1, 21)) AS r)),
w AS (SELECT source_key, r, x, y, CAST({_POISSON} AS DOUBLE) AS w FROM u),
m AS (SELECT source_key, r, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM w GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN n * xx - sx * sx > 0 THEN (n * xy - sx * sy) / (n * xx - sx * sx) END AS slope FROM m),
g AS (SELECT *, CASE WHEN n <> 0 THEN (sy - slope * sx) / n END AS intercept FROM f)""", sql="SELECT source_key, round(avg(slope), 5) AS slope, round(stddev_pop(slope), 5) AS slope_sd, round(avg(intercept), 5) AS intercept, round(stddev_pop(intercept), 5) AS intercept_sd FROM g GROUP BY 1")
def _(profile_):
    found = stats.bootstrap_regression(profile_, ["source_key"], "pos", "elevation", "node", 20)
    return found.select("source_key", *[F.round(c, 5).alias(c) for c in ("slope", "slope_sd", "intercept", "intercept_sd")])


@query("combination_disorder", "profile", more="""p AS (SELECT *, CAST(floor(source_key / 15) AS BIGINT) AS basin, source_key % 15 = 0 AS main FROM profile),
t AS (SELECT DISTINCT basin, source_key FROM p WHERE NOT main),
chosen AS (SELECT x.basin, x.source_key AS a, y.source_key AS b, z.source_key AS c FROM t x JOIN t y ON y.basin = x.basin AND x.source_key < y.source_key JOIN t z ON z.basin = x.basin AND y.source_key < z.source_key),
s AS (SELECT h.basin, h.a, h.b, h.c, CAST(p.pos AS DOUBLE) AS chi, abs(p.pos - lag(p.pos) OVER (PARTITION BY h.basin, h.a, h.b, h.c ORDER BY p.elevation, p.pos)) AS d FROM chosen h JOIN p ON p.basin = h.basin AND (p.main OR p.source_key IN (h.a, h.b, h.c)))""", sql="SELECT basin, a, b, c, round((coalesce(sum(d), 0) - (max(chi) - min(chi))) / CASE WHEN max(chi) > min(chi) THEN max(chi) - min(chi) END, 6) AS disorder, count(*) AS n FROM s GROUP BY 1, 2, 3, 4")
def _(profile_):
    p = profile_.withColumns({"chi": F.col("pos").cast("double"), "basin": F.floor(F.col("source_key") / 15), "main": F.col("source_key") % 15 == 0})
    return rounded(profile.combinations_disorder(p, "source_key", "basin", "main"), "disorder")


_TERMS = [(s_, g_) for s_, g_ in zip(nuclide.SHARES["be10"], nuclide.ATTENUATION, strict=True) if s_]
_F = " + ".join(f"top * {s_}::DOUBLE / (exp(u) / {g_}::DOUBLE + 4.99e-7::DOUBLE)" for s_, g_ in _TERMS)
_DF = " + ".join(f"-top * {s_}::DOUBLE / power(exp(u) / {g_}::DOUBLE + 4.99e-7::DOUBLE, 2) / {g_}::DOUBLE" for s_, g_ in _TERMS)


@query("apparent_erosion", "samples", recursive=True, more=f"""air AS (SELECT sample, conc, least(abs(latitude), 60.0) AS l, 1013.25 * exp(-0.03417 / 0.0065 * (ln(288.15) - ln(288.15 - 500.0 * 0.0065))) AS hpa FROM samples),
s AS (SELECT sample, CAST(conc AS DOUBLE) AS conc, {_STONE_SQL} AS scaling FROM (SELECT *, {_stone_sql('hpa')} AS t FROM air)),
newton(sample, conc, top, u, k) AS (SELECT sample, conc, 4.30::DOUBLE * scaling, ln(greatest(1e-12::DOUBLE, 160.0 * (4.30::DOUBLE * scaling / conc - 4.99e-7::DOUBLE))), 0 FROM s
  UNION ALL SELECT sample, conc, top, u - greatest(-2, least(2, ({_F} - conc) / (({_DF}) * exp(u)))), k + 1 FROM newton WHERE k < 40)""", sql="SELECT s.sample, CAST(s.conc AS BIGINT) AS conc, round(s.scaling, 6) AS scaling, round(exp(n.u), 9) AS erosion FROM s JOIN newton n ON n.sample = s.sample AND n.k = 40")
def _(samples):
    s = samples.withColumn("scaling", nuclide.stone_scaling(F.col("latitude"), nuclide.pressure(F.lit(500.0))))
    return nuclide.apparent_erosion(s, "conc", "scaling").select("sample", F.col("conc").cast("long").alias("conc"), r6("scaling").alias("scaling"), F.round("erosion", 9).alias("erosion"))


@query("tv_denoise", "profile")
def _(profile_):
    return kernels.denoise(profile_, "elevation", 20.0)


@query("segment_channels", "profile")
def _(profile_):
    return kernels.segment_channels(profile_.withColumn("chi", F.col("pos").cast("double")), 20.0, 8, 6)


@query("sampled_segments", "profile")
def _(profile_):
    return kernels.sampled_segments(profile_.withColumn("chi", F.col("pos").cast("double")), 20.0, rounds=5)


@query("concavity_chain", "profile")
def _(profile_):
    p = profile_.withColumns({"area": F.lit(1.0) + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos"), "dx": F.lit(1.0), "basin_key": F.col("source_key") % 10})
    return kernels.concavity_chain(p, "basin_key", "area", "dx", steps=200)


@query("kernel_density", "profile", more="h AS (SELECT source_key, greatest(1e-9::DOUBLE, 1.06::DOUBLE * stddev_pop(elevation) * power(count(*), -0.2::DOUBLE)) AS h, count(*) AS n FROM profile GROUP BY 1)", sql="SELECT a.source_key, a.elevation, round(sum(exp(-0.5 * power((a.elevation - b.elevation) / h.h, 2))) / (any_value(h.n) * any_value(h.h) * sqrt(2 * pi())), 6) AS density FROM profile a JOIN profile b ON b.source_key = a.source_key JOIN h ON h.source_key = a.source_key GROUP BY a.source_key, a.node, a.elevation")
def _(profile_):
    return rounded(stats.gaussian_density(profile_, ["source_key"], "elevation"), "density")


def _collinear_sql(keys: str) -> str:
    """Residuals of tributaries (test) against the reference (ref) by interpolation at equal chi, from ``pts`` with the keys."""
    on = " AND ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    return f"""ref AS (SELECT {keys}, chi, avg(elevation) AS z FROM pts WHERE reference GROUP BY {keys}, chi),
span AS (SELECT {keys}, min(chi) AS lo, max(chi) AS hi FROM ref GROUP BY {keys}),
test AS (SELECT p.* FROM pts p JOIN span s ON {on.format(a='p', b='s')} WHERE NOT p.reference AND p.chi BETWEEN s.lo AND s.hi),
below AS (SELECT t.*, r.chi AS x0, r.z AS z0 FROM test t ASOF JOIN ref r ON {on.format(a='t', b='r')} AND t.chi >= r.chi),
both_ends AS (SELECT t.*, r.chi AS x1, r.z AS z1 FROM below t ASOF JOIN ref r ON {on.format(a='t', b='r')} AND t.chi <= r.chi),
resid AS (SELECT *, CASE WHEN x0 = x1 THEN z0 ELSE z0 + (chi - x0) / (x1 - x0) * (z1 - z0) END - elevation AS r FROM both_ends)"""


@query("collinearity", "profile", more="pts AS (SELECT source_key, source_key % 10 AS basin_key, CAST(pos AS DOUBLE) AS chi, elevation, source_key < 10 AS reference FROM profile),\n" + _collinear_sql("basin_key"), sql="SELECT basin_key, source_key, round(exp(-sum(r * r) / 200), 6) AS mle, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, count(*) AS n FROM resid GROUP BY 1, 2")
def _(profile_):
    p = profile_.withColumns({"chi": F.col("pos").cast("double"), "basin_key": F.col("source_key") % 10})
    return halves_up(profile.collinearity(p, F.col("source_key") < 10), 6, "mle", "mae", "rmse")


def _theta_sql(area: str) -> str:
    """Points with chi by concavity; ``area`` is an expression over n and pos."""
    return f"t AS (SELECT unnest([CAST(0.3 AS DOUBLE), 0.5]) AS theta), pts AS (SELECT source_key, source_key % 10 AS basin_key, theta, elevation, source_key < 10 AS reference, round(sum(power(CAST(1 AS DOUBLE) / ({area}), theta)) OVER (PARTITION BY source_key, theta ORDER BY pos), 9) AS chi FROM (SELECT *, count(*) OVER (PARTITION BY source_key) AS n FROM profile), t),\n" + _collinear_sql("basin_key, theta")


GRID_FIT = "SELECT basin_key, theta, source_key, round(exp(-sum(r * r) / 200), 6) AS mle, round(avg(abs(r)), 5) AS mae, round(sqrt(avg(r * r)), 5) AS rmse, count(*) AS n FROM resid GROUP BY 1, 2, 3"


def _grid_fit(p: DataFrame, fit: Callable[..., DataFrame]) -> DataFrame:
    found = profile.collinearity_over(p.withColumns({"dx": F.lit(1.0), "basin_key": F.col("source_key") % 10}), [0.3, 0.5], "area", "dx", F.col("source_key") < 10, fit=fit)
    return halves_up(halves_up(found, 6, "mle"), 5, "mae", "rmse")


@query("collinearity_grid", "profile", more=_theta_sql("1 + n - pos"), sql=GRID_FIT)
def _(profile_):
    return _grid_fit(profile_.withColumn("area", F.lit(1.0) + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos")), profile.collinearity)


@query("collinearity_discharge", "profile", more=_theta_sql("(1 + n - pos) * (0.5 + source_key % 4)"), sql=GRID_FIT)
def _(profile_):
    # Discharge: area times the rain of the channel.
    area = F.lit(1.0) + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos")
    return _grid_fit(profile_.withColumn("area", area * (0.5 + F.col("source_key") % 4)), profile.decimal_collinearity)


@query("slope_area", "profile", more="m AS (SELECT source_key, node, pos, max(elevation) OVER (PARTITION BY source_key ORDER BY pos) AS z FROM profile), b AS (SELECT a.source_key, a.node, a.pos, a.z, max(d.pos) AS pos0, arg_max(d.z, d.pos) AS z0 FROM m a JOIN m d ON d.source_key = a.source_key AND d.pos < a.pos AND d.z <= a.z - 5 GROUP BY 1, 2, 3, 4)", sql="SELECT source_key, node, CAST(pos AS DOUBLE) AS area, round((z - z0) / (pos - pos0) + 3e-8::DOUBLE, 6) AS slope FROM b")
def _(profile_):
    found = profile.slope_area(profile_.withColumns({"area": F.col("pos").cast("double"), "flow_distance": F.col("pos").cast("double")}), 5.0)
    return nudged(found, "slope")


@query("knickpoint_chain", "profile")
def _(profile_):
    return profile.knickpoints(profile_, "elevation", 30.0, 3.0, 5.0)


@query("chi_analysis", "cells", recursive=True, more=KEYS_SQL + ",\n" + CHI_SQL.format(t="nodes") + ",\nchis AS (SELECT node, max(CASE WHEN at_root THEN via END) AS root, sum(term) AS chi FROM terms GROUP BY node),\nrows_of AS (SELECT p.source_key, c.root AS basin_key, p.node, round(c.chi, 6) AS chi, n.z AS elevation, round(r.d, 6) AS flow_distance, CAST(k.n_contrib AS DOUBLE) AS drainage_area, round(n.dx, 6) AS dx, r.depth FROM pick p JOIN chis c ON c.node = p.node JOIN nodes n ON n.node = p.node JOIN remote r ON r.node = p.node JOIN counts k ON k.node = p.node WHERE p.place = 1)", sql="SELECT source_key, basin_key, node, chi, elevation, flow_distance, drainage_area, dx, row_number() OVER (PARTITION BY source_key ORDER BY depth) AS pos FROM rows_of")
def _(cells):
    parts = analyses.drainage(cells, spec(), {"raster_is_filled": True, "threshold_contributing_pixels": 3})
    found = analyses.chi_profiles({k: flow.store(v, k) for k, v in parts.items() if k in ("nodes", "area", "chi", "source_keys")})["chi_data"]
    return rounded(found, "chi", "flow_distance", "dx")


# --- surfaces ---


@query("cast_shadows", "cells", sql=f'SELECT c.row AS "row", c.col, CAST(max(CASE WHEN n.value > c.value + k.h THEN 1 ELSE 0 END) AS DOUBLE) AS shadow FROM cells c JOIN (VALUES ' + ", ".join(f"({round(-d * math.cos(math.radians(135.0)))}, {round(d * math.sin(math.radians(135.0)))}, {math.tan(math.radians(30.0)) * 3000.0 * math.hypot(round(-d * math.cos(math.radians(135.0))), round(d * math.sin(math.radians(135.0))))!r}::DOUBLE)" for d in range(1, 7)) + ") k(i, j, h) ON true LEFT JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2")
def _(cells):
    return landforms.cast_shadows(cells, 3000.0, 30.0, 135.0, 6)


@query("terrace_cells", "cells", recursive=True, more=CHANNEL_SQL + ",\n" + SLOPES + ",\nnear AS (SELECT w.node, w.ancestor, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS place FROM ways w JOIN channel c ON c.node = w.ancestor), j AS (SELECT a.row, a.col, a.z - b.z AS relief, s.slope FROM near n JOIN nodes a ON a.node = n.node JOIN nodes b ON b.node = n.ancestor JOIN slopes s ON s.node = n.node WHERE n.place = 1), q AS (SELECT quantile_cont(relief, 0.25) AS r, quantile_cont(slope, 0.25) AS s FROM j)", sql='SELECT j.row AS "row", j.col, 1 AS value FROM j, q WHERE j.relief <= q.r AND j.slope <= q.s')
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return landforms.terraces_by_relief(network.to_channel(nodes, channel, nodes), flow.d8_slope(nodes))


@query("valley_widths", "cells", more=GRID_SQL + ",\nseen AS (SELECT g.node, k.i, CAST(round(round(g.row - cos(radians(g.node % 360 + 90.0::DOUBLE)) * k.i, 9)) AS INT) AS r, CAST(round(round(g.col + sin(radians(g.node % 360 + 90.0::DOUBLE)) * k.i, 9)) AS INT) AS c FROM grid g, (SELECT unnest(range(-10, 11)) AS i) k), ends AS (SELECT s.node, min(CASE WHEN f.row IS NULL AND s.i >= 0 THEN s.i END) AS hi, max(CASE WHEN f.row IS NULL AND s.i <= 0 THEN s.i END) AS lo FROM seen s LEFT JOIN cells f ON f.row = s.r AND f.col = s.c AND f.value < 56000 GROUP BY 1)", sql="SELECT node, CAST(greatest(0, coalesce(hi, 11) - coalesce(lo, -11) - 1) AS INT) AS width FROM ends")
def _(cells):
    line = cells.select(spec().node().alias("node"), "row", "col").withColumn("bearing", (F.col("node") % 360).cast("double"))
    return landforms.valley_widths(cells.where("value < 56000"), line, 10)


@query("divide_sides", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED + f",\nedge AS (SELECT * FROM (SELECT b.row, b.col, b.basin, count(n.basin) AS n FROM rooted b JOIN {STEPS_SQL} ON true LEFT JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc AND n.basin = b.basin GROUP BY 1, 2, 3) WHERE n < 8)", sql=f'SELECT e.row AS "row", e.col, e.basin, round(avg(CASE WHEN r.basin = e.basin THEN c.value END), 6) AS inside, round(avg(CASE WHEN r.basin <> e.basin THEN c.value END), 6) AS outside FROM edge e JOIN (VALUES {DISC2}) k(i, j) ON true JOIN cells c ON c.row = e.row + k.i AND c.col = e.col + k.j JOIN rooted r ON r.row = c.row AND r.col = c.col GROUP BY 1, 2, 3')
def _(cells):
    members = rooted(cells)
    return rounded(network.both_sides(network.perimeter(members), cells, members, 2), "inside", "outside")


def _fit_sql(radius: int) -> str:
    """Coefficients a .. f of the six-term surface of whole windows: each a fixed combination of the window's values (the normal equations' solution)."""
    places = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    x, y = np.array([float(j) for _, j in places]), np.array([float(-i) for i, _ in places])
    design = np.stack([x * x, y * y, x * y, x, y, np.ones_like(x)], axis=1)
    weights = np.linalg.solve(design.T @ design, design.T)
    values = ", ".join(f"({i}, {j}, {', '.join(f'{w!r}::DOUBLE' for w in weights[:, k].tolist())})" for k, (i, j) in enumerate(places))
    return f"fit AS (SELECT c.row, c.col, {', '.join(f'sum(k.{n} * n.value) AS {n}' for n in 'abdefg')}, count(*) AS cells FROM cells c JOIN (VALUES {values}) k(i, j, a, b, d, e, f, g) ON true JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2 HAVING count(*) = {len(places)})"


@query("fitted_surface", "cells", more=_fit_sql(2), sql="""SELECT row AS "row", col, round(g + 1e-6::DOUBLE, 3) AS elevation, round(sqrt(e * e + f * f) + 1e-6::DOUBLE, 4) AS slope, round(2 * a + 2 * b + 1e-6::DOUBLE, 4) AS curvature, round(e + 1e-6::DOUBLE, 4) AS gradient_x, round(f + 1e-6::DOUBLE, 4) AS gradient_y FROM fit""")
def _(cells):
    found = focal.polynomial_surface(cells, 2, partial=False).where("slope IS NOT NULL")
    return found.select("row", "col", *[F.round(F.col(c) + 1e-6, 3 if c == "elevation" else 4).alias(c) for c in ("elevation", "slope", "curvature", "gradient_x", "gradient_y")])


@query("polynomial_surface", "cells")
def _(cells):
    return focal.polynomial_surface(cells, 2)


@query("curved_channels", "cells")
def _(cells):
    return landforms.curved_channels(cells, 2, 1.0)


@query("roughness", "cells")
def _(cells):
    return focal.roughness(cells, 2)


_GAUSS = [math.exp(-0.5 * i * i) for i in range(-3, 4)]


@query("gaussian_filter", "cells", sql='SELECT c.row AS "row", c.col, round(sum(k.w * n.value) / sum(k.w), 4) AS value FROM cells c JOIN (VALUES ' + ", ".join(f"({i - 3}, {j - 3}, {_GAUSS[i] * _GAUSS[j]!r}::DOUBLE)" for i in range(7) for j in range(7)) + ") k(i, j, w) ON true JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2")
def _(cells):
    return focal.gaussian(cells, 1.0).withColumn("value", F.round("value", 4))


def _diffused(k: int) -> str:
    return f"d{k} AS (SELECT c.row, c.col, c.value + 0.1 * coalesce(sum((n.value - c.value) * exp(-power((n.value - c.value) / any_value(q.k), 2))), 0) AS value FROM d{k - 1} c CROSS JOIN q LEFT JOIN (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(i, j)) s ON true LEFT JOIN d{k - 1} n ON n.row = c.row + s.i AND n.col = c.col + s.j GROUP BY c.row, c.col, c.value)".replace("any_value(q.k)", "q.k").replace("GROUP BY c.row, c.col, c.value", "GROUP BY c.row, c.col, c.value, q.k")


@query("perona_malik", "cells", more=W3 + ",\nq AS (SELECT quantile_cont(sqrt(zx * zx + zy * zy), 0.9) AS k FROM g3 WHERE zx IS NOT NULL AND zy IS NOT NULL),\nd0 AS (SELECT row, col, value FROM cells),\n" + ",\n".join(_diffused(k) for k in (1, 2, 3)), sql='SELECT row AS "row", col, round(value, 4) AS value FROM d3')
def _(cells):
    return focal.perona_malik(cells, 3).withColumn("value", F.round("value", 4))


@query("non_local_means", "cells", more="o AS (SELECT i.v AS i, j.v AS j FROM (SELECT unnest(range(-2, 3)) AS v) i, (SELECT unnest(range(-2, 3)) AS v) j),\ndiffs AS (SELECT o.i, o.j, c.row, c.col, (n.value - c.value) * (n.value - c.value) AS d, n.value AS moved FROM cells c, o, cells n WHERE n.row = c.row - o.i AND n.col = c.col - o.j),\nwide AS (SELECT i, j, row + a.v AS row, col + b.v AS col, avg(d) AS d FROM diffs, (SELECT unnest(range(-1, 2)) AS v) a, (SELECT unnest(range(-1, 2)) AS v) b GROUP BY 1, 2, 3, 4)", sql='SELECT m.row AS "row", m.col, round(sum(exp(-w.d / 9000000.0) * m.moved) / sum(exp(-w.d / 9000000.0)), 4) AS value FROM diffs m JOIN wide w ON w.i = m.i AND w.j = m.j AND w.row = m.row AND w.col = m.col GROUP BY 1, 2')
def _(cells):
    return focal.non_local_means(cells, 2, 1, 3000.0).withColumn("value", F.round("value", 4))


_LOOKS = ", ".join(f"({k}, {round(-d * math.cos(2 * math.pi * k / 8))}, {round(d * math.sin(2 * math.pi * k / 8))})" for k in range(8) for d in range(1, 6))


@query("topographic_shielding", "cells", more=f"h AS (SELECT c.row, c.col, k.k, greatest(0, coalesce(max(atan2(n.value - c.value, 30.0 * sqrt(CAST(k.i * k.i + k.j * k.j AS DOUBLE)))), 0)) AS h FROM cells c JOIN (VALUES {_LOOKS}) k(k, i, j) ON true LEFT JOIN cells n ON n.row = c.row + k.i AND n.col = c.col + k.j GROUP BY 1, 2, 3)", sql='SELECT row AS "row", col, round(1 - sum(power(sin(h), 3.3)) / 8, 6) AS shielding FROM h GROUP BY 1, 2')
def _(cells):
    return rounded(focal.shielding(cells, 30.0, 5), "shielding")


@query("power_spectrum", "cells")
def _(cells):
    return focal.spectrum(cells, spec().nrows, spec().ncols)


@query("bandpass_filter", "cells")
def _(cells):
    return focal.frequency_filter(cells, spec().nrows, spec().ncols, 1.0, 0.02, 0.2)


@query("wiener_filter", "cells")
def _(cells):
    return focal.wiener(cells, spec().nrows, spec().ncols)


def _gap_round(k: int) -> str:
    return f"f{k} AS (SELECT c.row, c.col, coalesce(c.value, avg(n.value)) AS value FROM f{k - 1} c JOIN (SELECT * FROM {STEPS_SQL}) k ON true LEFT JOIN f{k - 1} n ON n.row = c.row + k.dr AND n.col = c.col + k.dc GROUP BY c.row, c.col, c.value)"


@query("nodata_fill", "cells", more="f0 AS (SELECT CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, v.value FROM (SELECT unnest(range(0, n)) AS i FROM size) r CROSS JOIN (SELECT unnest(range(0, n)) AS i FROM size) c LEFT JOIN cells v ON v.row = r.i AND v.col = c.i AND v.value >= 50000),\n" + ",\n".join(_gap_round(k) for k in range(1, 11)), sql='SELECT row AS "row", col, round(value + 1e-7::DOUBLE, 5) AS value FROM f10 WHERE value IS NOT NULL')
def _(cells):
    return focal.fill_gaps(algebra.mask_below(cells, 50000), spec().nrows, spec().ncols).withColumn("value", F.round(F.col("value") + 1e-7, 5))


@query("depression_fill", "cells", recursive=True, more=f"""rim AS (SELECT c.row, c.col, c.value, count(n.row) < 8 AS edge FROM cells c JOIN {STEPS_SQL} ON true LEFT JOIN cells n ON n.row = c.row + k.dr AND n.col = c.col + k.dc GROUP BY 1, 2, 3),
sunk(row, col, z, w, step, moved) AS (SELECT row, col, value, CASE WHEN edge THEN value ELSE 'infinity'::DOUBLE END, 0, true FROM rim
  UNION ALL SELECT row, col, z, new, step + 1, bool_or(new < w) OVER () FROM (
    SELECT s.row, s.col, s.z, s.w, s.step, least(s.w, greatest(s.z, min(n.w) + 0.001)) AS new FROM sunk s JOIN {STEPS_SQL} ON true LEFT JOIN sunk n ON n.row = s.row + k.dr AND n.col = s.col + k.dc WHERE s.moved GROUP BY 1, 2, 3, 4, 5))""", sql='SELECT row AS "row", col, round(min(w), 6) AS value FROM sunk GROUP BY 1, 2')
def _(cells):
    return rounded(flow.fill(cells, 0.001), "value")


@query("skeleton", "cells")
def _(cells):
    return morphology.thin(algebra.to_mask(cells, F.col("value") > 50000).where("value = 1"))


@query("skeleton_end_points", "cells")
def _(cells):
    return morphology.end_points(morphology.thin(algebra.to_mask(cells, F.col("value") > 50000).where("value = 1")))


@query("stability_index", "cells", more="""s AS (SELECT row, col, 0.1::DOUBLE + (value % 500) / 1000 AS a FROM cells),
g AS (SELECT (unnest(range(0, 20)) + 0.5::DOUBLE) / 20 AS v), c AS (SELECT 0.3::DOUBLE * v AS c FROM g), t AS (SELECT 0.4::DOUBLE + (0.8::DOUBLE - 0.4::DOUBLE) * v AS t FROM g), r AS (SELECT 0.0005::DOUBLE + (0.002::DOUBLE - 0.0005::DOUBLE) * v AS r FROM g),
m AS (SELECT s.row, s.col, avg(CASE WHEN (c.c + cos(s.a) * (1 - least(1.0::DOUBLE, r.r * 200.0 / sin(s.a)) * 0.5) * t.t) / sin(s.a) > 1 THEN 1.0::DOUBLE ELSE 0 END) AS chance FROM s, c, t, r GROUP BY 1, 2),
w AS (SELECT row, col, (cos(a) * (1 - least(1.0::DOUBLE, 0.002::DOUBLE * 200.0 / sin(a)) * 0.5) * 0.4) / sin(a) AS worst FROM s)""", sql='SELECT m.row AS "row", m.col, round(CASE WHEN w.worst > 1 THEN least(w.worst, 10) ELSE m.chance END, 6) AS si FROM m JOIN w ON w.row = m.row AND w.col = m.col')
def _(cells):
    s = cells.withColumn("a", 0.1 + (F.col("value") % 500) / 1000)
    bounds = [F.lit(x) for x in (0.0, 0.3, 0.4, 0.8, 0.0005, 0.002)]
    return rounded(s.select("row", "col", soil.stability_index(F.col("a"), F.lit(200.0), *bounds).alias("si")), "si")


@query("median_residuals", "profile", more="f AS (SELECT source_key, regr_slope(elevation, pos) AS s, regr_intercept(elevation, pos) AS i FROM profile GROUP BY 1)", sql="SELECT p.source_key, round(quantile_cont(elevation - s * pos - i, 0.25), 5) AS q1, round(quantile_cont(elevation - s * pos - i, 0.5), 5) AS median, round(quantile_cont(elevation - s * pos - i, 0.75), 5) AS q3 FROM profile p JOIN f ON f.source_key = p.source_key GROUP BY 1")
def _(profile_):
    return profile.median_residuals(profile_, "pos", "elevation").select("source_key", *[F.round(c, 5).alias(c) for c in ("q1", "median", "q3")])


@query("chi_over_movern", "profile", sql="SELECT node, round(sum(power(CAST(1 AS DOUBLE) / (1 + n - pos), 0.3)) OVER (PARTITION BY source_key ORDER BY pos), 5) AS chi_0_3, round(sum(power(CAST(1 AS DOUBLE) / (1 + n - pos), 0.6)) OVER (PARTITION BY source_key ORDER BY pos), 5) AS chi_0_6 FROM (SELECT *, count(*) OVER (PARTITION BY source_key) AS n FROM profile)")
def _(profile_):
    p = profile_.withColumns({"area": 1 + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos"), "dx": F.lit(1.0)})
    return profile.chi_over(p, [0.3, 0.6], "area", "dx").select("node", F.round("chi_0_3", 5).alias("chi_0_3"), F.round("chi_0_6", 5).alias("chi_0_6"))


@query("points_within_radius", "points", "cells", more=FAR_SQL, sql="SELECT p.id, f.id2, round(sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)), 6) AS distance FROM points p JOIN far f ON (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) <= 25")
def _(points, cells):
    targets = cells.where("value > 68000").select(spec().node().alias("id2"), spec().x(F.col("col")).alias("x"), spec().y(F.col("row")).alias("y"))
    return rounded(joins.within(points, targets, 5.0), "distance")


from catena import more_queries  # noqa: E402, F401
