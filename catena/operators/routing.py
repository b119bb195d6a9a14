"""Routing beyond single receivers: weighted flow, facet directions, hilltop traces, channel-head moves, breaching."""

from __future__ import annotations

import heapq
import math
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.grid import DIAGONAL, STEPS, GridSpec, window3
from catena.operators import flow
from catena.storage import store

#: Length of the contour that a neighbour receives flow across, in cells (fixed values of the method): sides and corners.
CONTOUR = (0.5, 0.354)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def weighted_edges(cells: DataFrame, method: str = "freeman", power: float = 1.1) -> DataFrame:
    """``row, col, to_row, to_col, w`` of every downhill neighbour; weights of a cell sum to 1.

    freeman: slope to a power; quinn: slope times contour length; two: the two steepest by slope.
    """
    z = window3(cells.where("value IS NOT NULL"))
    parts = []
    for k, (dr, dc) in enumerate(STEPS):
        fall = (F.col("z") - F.col(f"n{k}")) / (DIAGONAL if k % 2 else 1.0)
        weight = F.pow(fall, F.lit(power)) if method == "freeman" else fall * CONTOUR[k % 2] if method == "quinn" else fall
        parts.append(F.struct(F.when(fall > 0, weight).otherwise(0.0).alias("w"), F.lit(-k).alias("k"), (F.col("row") + dr).alias("to_row"), (F.col("col") + dc).alias("to_col")))
    ways = F.array(*parts)
    if method == "two":
        ways = F.slice(F.sort_array(ways, asc=False), 1, 2)
    edges = z.select("row", "col", F.explode(ways).alias("e")).select("row", "col", "e.to_row", "e.to_col", "e.w").where("w > 0")
    return edges.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("row", "col")))


def infinity_edges(cells: DataFrame) -> DataFrame:
    """The same for facet directions: flow is shared by the two neighbours beside the steepest direction."""
    eighth = math.pi / 4
    d = flow.d_infinity(cells).where("angle IS NOT NULL").withColumn("f", (F.floor(F.col("angle") / eighth) % 8).cast("int"))
    share = F.col("angle") / eighth - F.floor(F.col("angle") / eighth)
    # Counter-clockwise from east, neighbours are 2, 1, 0, 7, ...
    ring = [STEPS[(2 - i) % 8] for i in range(9)]
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ring])
    both = d.select("row", "col", F.explode(F.array(F.struct(F.element_at(steps, F.col("f") + 1).alias("s"), (1 - share).alias("w")), F.struct(F.element_at(steps, F.col("f") + 2).alias("s"), share.alias("w")))).alias("e"))
    return both.select("row", "col", (F.col("row") + F.col("e.s.dr")).alias("to_row"), (F.col("col") + F.col("e.s.dc")).alias("to_col"), F.col("e.w").alias("w")).where("w > 0")


def spread_flow(cells: DataFrame, edges: DataFrame, start: float = 1.0) -> DataFrame:
    """``row, col, area``: what arrives at each cell when every cell sends ``start`` down the weighted edges.

    Rounds move all flow one step, so there are as many as the longest way; each writes what moves, and the sum over rounds is
    taken at the end.  Edges that lead outside lose theirs.  Edges must not lead in a circle: this raises once there were
    more rounds than cells.
    """
    edges = store(edges, "edges")
    inside = store(cells.where("value IS NOT NULL").select("row", "col"), "inside")
    moving = [store(inside.withColumn("area", F.lit(start).cast("double")), "moving-0")]
    most = inside.count()
    while moving[-1].take(1):
        if len(moving) > most + 1:
            raise ValueError("the edges lead in a circle")
        moved = moving[-1].join(edges, ["row", "col"]).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum(F.col("area") * F.col("w")).alias("area"))
        moving.append(store(moved.join(inside, ["row", "col"], "left_semi"), f"moving-{len(moving)}"))
        if len(moving) % 64 == 0:
            # Plans of many parts are slow to make: sum up from time to time, and keep what still moves.
            moving = [store(union_all(moving[:-1]).groupBy("row", "col").agg(F.sum("area").alias("area")), "area"), moving[-1]]
    return union_all(moving).groupBy("row", "col").agg(F.sum("area").alias("area"))


def watershed(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """``row, col`` of all cells from which weighted edges lead to one of the outlets (row, col), the outlets among them.

    Rounds go up one step each; a round holds only the cells that are new.
    """
    edges = store(edges.select("row", "col", F.col("to_row").alias("r"), F.col("to_col").alias("c")).distinct(), "steps")
    found = [store(outlets.select("row", "col").distinct(), "watershed-0")]
    while found[-1].take(1):
        up = edges.join(found[-1].select(F.col("row").alias("r"), F.col("col").alias("c")), ["r", "c"]).select("row", "col").distinct()
        found.append(store(up.join(union_all(found), ["row", "col"], "left_anti"), f"watershed-{len(found)}"))
        if len(found) % 64 == 0:
            found = [store(union_all(found[:-1]), "watershed"), found[-1]]
    return union_all(found)


def hillslopes(nodes: DataFrame, hilltops: DataFrame, channel: DataFrame) -> DataFrame:
    """``node, channel_node, length, relief, slope`` from each hilltop (node) down to the first channel node."""
    near = flow.nearest_tag(nodes, channel.select("node", F.lit(1).alias("tag"))).join(hilltops.select("node"), "node", "left_semi")
    z = nodes.select("node", "z")
    j = near.join(z, "node").join(z.select(F.col("node").alias("tag_node"), F.col("z").alias("zc")), "tag_node")
    relief = F.col("z") - F.col("zc")
    return j.select("node", F.col("tag_node").alias("channel_node"), F.col("distance").alias("length"), relief.alias("relief"), F.when(F.col("distance") > 0, relief / F.col("distance")).alias("slope"))


def aspect_traces(cells: DataFrame, starts: DataFrame, stops: DataFrame, spec: GridSpec, step: float = 0.5) -> DataFrame:
    """``start, row, col, length``: where traces along the steepest direction from the starts (row, col) end.

    All traces move ``step`` cells a round by a join with the directions.  One ends at a stop cell (row, col), in a flat,
    outside the data (the cell outside is given), or where it would climb (the last cell before is given); heights fall from cell to cell
    otherwise, so every trace ends and none is left out.
    """
    angles = store(flow.d_infinity(cells).select("row", "col", "angle").join(cells.select("row", "col", F.col("value").alias("z")), ["row", "col"]), "angles")
    halt = store(stops.select("row", "col", F.lit(True).alias("stop")).distinct(), "stops")
    now = starts.select(spec.node().alias("start"), (F.col("row") + 0.5).cast("double").alias("r"), (F.col("col") + 0.5).cast("double").alias("c"), F.lit(0.0).alias("length"), *[F.lit(None).cast("int").alias(n) for n in ("r0", "c0")], F.lit(None).cast("double").alias("z0"))
    done = []
    for k in count():
        at = now.withColumns({"row": F.floor("r").cast("int"), "col": F.floor("c").cast("int")})
        at = at.join(angles, ["row", "col"], "left").join(halt, ["row", "col"], "left")
        moved = (F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))
        at = store(at.withColumn("climbs", F.coalesce((F.col("z") >= F.col("z0")) & moved, F.lit(False))), f"traces-{k}")
        over = F.col("climbs") | F.col("stop").isNotNull() | F.col("angle").isNull()
        where = [F.when(F.col("climbs"), F.col(f"{n[0]}0")).otherwise(F.col(n)).alias(n) for n in ("row", "col")]
        done.append(at.where(over).select("start", *where, "length"))
        now = at.where(~over).select("start", (F.col("r") - F.sin("angle") * step).alias("r"), (F.col("c") + F.cos("angle") * step).alias("c"), (F.col("length") + step * spec.res).alias("length"), F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("z").alias("z0"))
        if not now.take(1):
            return union_all(done)
        if len(done) % 64 == 0:
            done = [store(union_all(done), f"ended-{k}")]


def tag_downstream(nodes: DataFrame, tags: DataFrame, distance: float) -> DataFrame:
    """``node, tag`` of all nodes up to a distance downstream of a tagged one (node, tag).

    A tagged node keeps its own tag; others take that of the tagged node that is fewest steps above them, then the nearest, then the smallest.
    """
    far = flow.distance_from_outlet(nodes).select("node", "distance")
    ways = flow.ancestors(nodes, tags).join(far, "node").join(far.select(F.col("node").alias("ancestor"), F.col("distance").alias("d")), "ancestor")
    near = ways.withColumn("way", F.round(F.col("distance") - F.col("d"), 9)).where(F.col("way") <= distance).join(tags, "node")
    own = tags.select(F.col("node").alias("ancestor"), F.lit(True).alias("own"))
    free = near.join(own, "ancestor", "left").where("steps = 0 OR own IS NULL")
    return free.groupBy(F.col("ancestor").alias("node")).agg(F.min(F.struct("steps", "way", "node", "tag")).alias("b")).select("node", F.col("b.tag").alias("tag"))


def move_heads_up(nodes: DataFrame, heads: DataFrame, distance: float) -> DataFrame:
    """``node, moved``: each head goes up to the node within a distance above it that has the longest way to its own farthest source.

    Of the nodes above, those on the way to the farthest upslope node are taken; the last one within the distance is the new head.
    """
    top = flow.farthest_upslope(nodes).join(heads.select("node"), "node", "left_semi")
    far = flow.distance_from_outlet(nodes).select("node", "distance")
    ways = flow.ancestors(nodes, top.select(F.col("farthest").alias("node"))).select(F.col("node").alias("farthest"), F.col("ancestor").alias("on"), "steps")
    j = top.select("node", "farthest").join(ways, "farthest").join(far.select(F.col("node").alias("on"), F.col("distance").alias("d_on")), "on").join(far.withColumnRenamed("distance", "d"), "node")
    way = F.round(F.col("d_on") - F.col("d"), 9)
    return j.where((way >= 0) & (way <= distance)).groupBy("node").agg(F.min_by("on", "steps").alias("moved"))


def move_heads_down(nodes: DataFrame, heads: DataFrame, distance: float) -> DataFrame:
    """``node, moved``: the last node downstream of each head within a distance."""
    far = flow.distance_from_outlet(nodes).select("node", "distance")
    ways = flow.ancestors(nodes, heads).join(far, "node").join(far.select(F.col("node").alias("ancestor"), F.col("distance").alias("d")), "ancestor")
    return ways.where(F.col("distance") - F.col("d") <= distance).groupBy("node").agg(F.max_by("ancestor", "steps").alias("moved"))


def slope_between(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, length, slope`` for pairs where b is downstream of a."""
    far = flow.distance_from_outlet(nodes).select("node", "distance").join(nodes.select("node", "z"), "node")
    below = flow.ancestors(nodes, pairs.select(F.col("a").alias("node"))).select(F.col("node").alias("a"), F.col("ancestor").alias("b"))
    j = pairs.select("a", "b").join(below, ["a", "b"]).join(far.toDF("a", "da", "za"), "a").join(far.toDF("b", "db", "zb"), "b")
    length = F.col("da") - F.col("db")
    return j.select("a", "b", length.alias("length"), F.when(length > 0, (F.col("za") - F.col("zb")) / length).alias("slope"))


def bearings(paths: DataFrame, places: DataFrame, ahead: int = 5) -> DataFrame:
    """``start, step, node, bearing`` in degrees from north, from each node of a path to the one some steps on."""
    from catena.functions.geo import bearing

    j = paths.join(places.select("node", "x", "y"), "node")
    w = Window.partitionBy("start").orderBy("step")
    dx, dy = F.lead("x", ahead).over(w) - F.col("x"), F.lead("y", ahead).over(w) - F.col("y")
    return j.withColumns({"dx": dx, "dy": dy}).where("dx IS NOT NULL").select("start", "step", "node", bearing(F.col("dx"), F.col("dy")).alias("bearing"))


def upstream_histogram(nodes: DataFrame, outlets: DataFrame, heights: DataFrame, width: float) -> DataFrame:
    """``outlet, bin, n`` of all heights that drain to each outlet."""
    up = flow.upslope_nodes(nodes, outlets)
    return up.join(heights.select("node", "z"), "node").groupBy("outlet", F.floor(F.col("z") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def breach(cells: DataFrame, nrows: int, ncols: int, min_drop: float = 0.0) -> DataFrame:
    """Cut channels out of pits instead of filling them: each pit's way to the edge, by lowest barriers, is lowered to fall.

    Pits are met in order of height over the whole grid, so it is one array in one task (8 bytes a cell and some copies).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z = np.full((nrows, ncols), np.nan)
        z[rows["row"], rows["col"]] = rows["value"]
        seen, back, heap = np.isnan(z), np.full(z.size, -1), []
        edge = np.pad(~np.isnan(z), 1)
        for i, j in zip(rows["row"], rows["col"], strict=True):
            if not edge[i : i + 3, j : j + 3].all():
                heapq.heappush(heap, (z[i, j], int(i) * ncols + int(j)))
                seen[i, j] = True
        while heap:
            level, n = heapq.heappop(heap)
            i, j = divmod(n, ncols)
            for dr, dc in STEPS:
                a, b = i + dr, j + dc
                if 0 <= a < nrows and 0 <= b < ncols and not seen[a, b]:
                    seen[a, b] = True
                    m = a * ncols + b
                    back[m] = n
                    if z[a, b] <= level:
                        # Lower the way out until it falls by itself.
                        want, at = z[a, b], n
                        while at >= 0 and z.flat[at] >= want - min_drop:
                            want -= min_drop
                            z.flat[at] = want
                            at = back[at]
                    heapq.heappush(heap, (max(level, z[a, b]), m))
        return pd.DataFrame({"row": rows["row"], "col": rows["col"], "value": z[rows["row"], rows["col"]]})

    data = cells.where("value IS NOT NULL").select("row", "col", F.col("value").cast("double"), F.lit(0).alias("whole"))
    return data.groupBy("whole").applyInPandas(run, "row int, col int, value double")
