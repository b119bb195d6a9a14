"""Flow over cells: steepest-descent receivers, and everything that follows receivers up or down.

A flow tree is a table of nodes ``node, receiver, dx``; a root is its own receiver with ``dx`` 0.
Walks along receivers double their step each round, so a path of length d takes
log2(d) rounds, each an equi-join over one row a node.  Sums over all that drains to a
node double likewise: after k rounds a node holds the sum over descendants less than
2^k steps away.  No table of all ancestor pairs is built for them.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catena.grid import DIAGONAL, STEPS, GridSpec, spread, window3
from catena.storage import store


def d8(cells: DataFrame, spec: GridSpec, periodic: str = "", base: str = "") -> DataFrame:
    """Nodes with ``node, row, col, z, receiver, direction, dx, drop``.

    The receiver is the neighbour of steepest drop (per unit of distance); of equal ones the
    first clockwise from north; without a drop a cell is its own receiver.
    Cells at the edge of the data look at the neighbours they have; pairs of sides in
    ``periodic`` (ns, ew) wrap around.  Cells on the sides in ``base`` (n, e, s, w) are base level: their own receivers.
    """
    data = cells.where("value IS NOT NULL")
    if periodic:
        data = _wrapped(data, spec, periodic)
    z = window3(data)
    if periodic:
        z = z.where(F.col("row").between(0, spec.nrows - 1) & F.col("col").between(0, spec.ncols - 1))
    # One struct a direction; the largest has the steepest drop, and of equal drops the smallest k.
    ways = [F.struct(F.coalesce((F.col("z") - F.col(f"n{k}")) / (DIAGONAL if k % 2 else 1.0), F.lit(0.0)).alias("drop"), F.lit(-k).alias("minus_k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(STEPS)]
    out = z.select("row", "col", "z", F.array_max(F.array(*ways)).alias("way"))
    sides = {"n": F.col("row") == 0, "e": F.col("col") == spec.ncols - 1, "s": F.col("row") == spec.nrows - 1, "w": F.col("col") == 0}
    level = F.lit(False)
    for side in base:
        level = level | sides[side]
    out = out.withColumn("falls", (F.col("way.drop") > 0) & ~level)
    row, col = F.col("row") + F.when(F.col("falls"), F.col("way.dr")).otherwise(0), F.col("col") + F.when(F.col("falls"), F.col("way.dc")).otherwise(0)
    if "n" in periodic:
        row = F.pmod(row, F.lit(spec.nrows))
    if "e" in periodic:
        col = F.pmod(col, F.lit(spec.ncols))
    direction = F.when(F.col("falls"), -F.col("way.minus_k")).otherwise(-1)
    dx = F.when(~F.col("falls"), 0.0).when(F.col("way.minus_k") % 2 != 0, DIAGONAL * spec.res).otherwise(spec.res)
    receiver = row.cast("long") * spec.ncols + col
    return out.select(spec.node().alias("node"), "row", "col", "z", receiver.alias("receiver"), direction.alias("direction"), dx.cast("double").alias("dx"), F.when(F.col("falls"), F.col("way.drop")).otherwise(0.0).alias("drop"))


def _wrapped(cells: DataFrame, spec: GridSpec, periodic: str) -> DataFrame:
    """A ring of copies from the other side around the grid."""
    out = cells
    for axis, size, on in (("row", spec.nrows, "n" in periodic), ("col", spec.ncols, "e" in periodic)):
        if on:
            first = out.where(F.col(axis) == 0).withColumn(axis, F.lit(size))
            last = out.where(F.col(axis) == size - 1).withColumn(axis, F.lit(-1))
            out = out.unionByName(first).unionByName(last)
    return out


def d8_slope(nodes: DataFrame) -> DataFrame:
    """Fall to the receiver over its distance; 0 at roots."""
    low = nodes.select(F.col("node").alias("receiver"), F.col("z").alias("z_receiver"))
    slope = F.when(F.col("dx") > 0, (F.col("z") - F.col("z_receiver")) / F.col("dx")).otherwise(0.0)
    return nodes.join(low, "receiver").select("node", "row", "col", slope.alias("slope"))


def base_level(nodes: DataFrame) -> DataFrame:
    return nodes.where("node = receiver")


def donors(nodes: DataFrame) -> DataFrame:
    """``node, n_donors`` of every node; 0 where nothing drains directly to it."""
    counts = nodes.where("node <> receiver").groupBy(F.col("receiver").alias("node")).agg(F.count("*").alias("n_donors"))
    return nodes.select("node").join(counts, "node", "left").fillna(0, ["n_donors"])


def to_root(nodes: DataFrame, lengths: dict[str, Column] | None = None) -> DataFrame:
    """``node, root, depth`` and for each name in ``lengths`` the sum of its column over the path, the root left out."""
    lengths = lengths or {}
    first = {name: F.when(F.col("node") == F.col("receiver"), 0.0).otherwise(c) for name, c in lengths.items()}
    now = nodes.select("node", F.col("receiver").alias("root"), F.when(F.col("node") == F.col("receiver"), 0).otherwise(1).cast("long").alias("depth"), *[c.alias(n) for n, c in first.items()])
    rounds = 0
    while True:
        now = store(now, f"to-root-{rounds}")
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("__root"), *[F.col(c).alias(f"__{c}") for c in ["depth", *lengths]])
        # A pointer moves only while it does not stand on a root.
        after = now.join(ahead, "root").select("node", F.col("__root").alias("root"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in ["depth", *lengths]])
        if not now.join(ahead.where("root <> __root").select("root"), "root", "left_semi").take(1):
            return now
        now, rounds = after, rounds + 1


def accumulate(nodes: DataFrame, sums: dict[str, Column], best: dict[str, Column] | None = None) -> DataFrame:
    """For each node the sums over itself and all that drains to it; ``best`` takes the largest value instead.

    Per round: one grouped aggregation by pointer, one join back, one join to move pointers.
    """
    best = best or {}
    names = [*sums, *best]
    now = nodes.select("node", F.when(F.col("receiver") != F.col("node"), F.col("receiver")).alias("up"), *[c.alias(n) for n, c in {**sums, **best}.items()])
    rounds = 0
    while True:
        now = store(now, f"accumulate-{rounds}")
        if not now.where("up IS NOT NULL").take(1):
            return now.drop("up")
        come = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*[F.sum(n).alias(f"__{n}") for n in sums], *[F.max(n).alias(f"__{n}") for n in best])
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("__up"))
        merged = [*[(F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0))).alias(n) for n in sums], *[F.greatest(n, f"__{n}").alias(n) for n in best]]
        now = now.join(come, "node", "left").select("node", "up", *merged).join(ahead, "up", "left").select("node", F.col("__up").alias("up"), *names)
        rounds += 1


def contributing(nodes: DataFrame) -> DataFrame:
    """``node, n_contrib``: how many nodes drain to it, itself among them."""
    return accumulate(nodes, {"n_contrib": F.lit(1).cast("long")})


def drainage_area(nodes: DataFrame, spec: GridSpec) -> DataFrame:
    return contributing(nodes).withColumn("area", F.col("n_contrib") * (spec.res * spec.res))


def upslope_mean(nodes: DataFrame, values: DataFrame, value: str = "value") -> DataFrame:
    """Sum, count and mean of a value (node, value) over all that drains to a node."""
    joined = nodes.join(values.select("node", F.col(value).alias("__v")), "node", "left")
    out = accumulate(joined, {"total": F.coalesce("__v", F.lit(0.0)), "n": F.when(F.col("__v").isNotNull(), 1).otherwise(0).cast("long")})
    return out.withColumn("mean", F.when(F.col("n") > 0, F.col("total") / F.col("n")))


def distance_from_outlet(nodes: DataFrame) -> DataFrame:
    return to_root(nodes, {"distance": F.col("dx")})


def chi(nodes: DataFrame, area: DataFrame, theta: float = 0.5, a0: float = 1.0, area_column: str = "area") -> DataFrame:
    """``node, root, chi``: the sum of dx (A0 / A)^theta from the root up, with the area of each node itself."""
    joined = nodes.join(area.select("node", F.col(area_column).alias("__a")), "node")
    return to_root(joined, {"chi": F.col("dx") * F.pow(F.lit(a0) / F.col("__a"), F.lit(theta))}).drop("depth")


def ancestors(nodes: DataFrame, of: DataFrame | None = None, most_steps: int | None = None) -> DataFrame:
    """``node, ancestor, steps``: all pairs of a node and one downstream of it (itself: 0 steps), from ``of`` (node) or all nodes.

    The table has a row for each step of each path, up to ``most_steps``: meant for chosen nodes or shallow trees.
    """
    jump = store(nodes.where("node <> receiver").select("node", F.col("receiver").alias("far")), "jump-0")
    start = (of if of is not None else nodes).select("node").distinct()
    pairs = start.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    length, k = 1, 0
    while True:
        pairs = store(pairs, f"pairs-{k}")
        if not jump.take(1) or (most_steps is not None and length > most_steps):
            return pairs if most_steps is None else pairs.where(F.col("steps") <= most_steps)
        # Pairs with under `length` steps extend by exactly `length` steps: each longer pair arises once.
        more = pairs.join(jump.select(F.col("node").alias("ancestor"), "far"), "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("steps") + length).alias("steps"))
        pairs = pairs.unionByName(more)
        jump = store(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("__far")), "far").select("node", F.col("__far").alias("far")), f"jump-{k + 1}")
        length, k = 2 * length, k + 1


def flow_paths(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, step, node``: the way of each start (node) to its root."""
    return ancestors(nodes, starts).select(F.col("node").alias("start"), F.col("steps").alias("step"), F.col("ancestor").alias("node"))


def upslope_nodes(nodes: DataFrame, outlets: DataFrame, with_outlet: bool = True) -> DataFrame:
    """``outlet, node`` of all nodes that drain to each outlet (node).

    Every node looks for its nearest outlet, and outlets for those below them; no table of other pairs is built.
    """
    named = outlets.select("node").distinct()
    near = store(nearest_tag(nodes, named.withColumn("tag", F.col("node"))).select("node", F.col("tag_node").alias("outlet")), "nearest-outlet")
    ahead = nodes.join(named, "node", "left_semi").where("node <> receiver").select(F.col("node").alias("top"), F.col("receiver").alias("node")).join(near, "node")
    tree = named.join(ahead.select(F.col("top").alias("node"), "outlet"), "node", "left").select("node", F.coalesce("outlet", "node").alias("receiver"))
    below = ancestors(store(tree, "outlet-tree")).select(F.col("node").alias("outlet"), F.col("ancestor").alias("__o"))
    pairs = near.join(below, "outlet").select(F.col("__o").alias("outlet"), "node")
    return pairs if with_outlet else pairs.where("outlet <> node")


def nearest_tag(nodes: DataFrame, tags: DataFrame, max_distance: float | None = None) -> DataFrame:
    """``node, tag_node, tag, distance`` of the nearest tagged node (node, tag) downstream, itself included.

    Pointers stop at tagged nodes, so this costs log2 of the longest way, not a table of ways.
    """
    marks = tags.select("node", "tag", F.lit(True).alias("__here"))
    cut = nodes.join(marks, "node", "left").select("node", F.when(F.col("__here"), F.col("node")).otherwise(F.col("receiver")).alias("receiver"), F.when(F.col("__here"), 0.0).otherwise(F.col("dx")).alias("dx"))
    found = to_root(cut, {"distance": F.col("dx")}).join(marks.select(F.col("node").alias("root"), "tag"), "root")
    out = found.select("node", F.col("root").alias("tag_node"), "tag", "distance")
    return out if max_distance is None else out.where(F.col("distance") < max_distance)


def farthest_upslope(nodes: DataFrame) -> DataFrame:
    """``node, farthest, distance``: what drains to a node from farthest away; of equally far ones the smallest node.

    Distances count to nine places, so that the order in which steps were added does not decide.
    """
    far = distance_from_outlet(nodes).select("node", F.round("distance", 9).alias("__d"))
    joined = nodes.join(far, "node")
    top = accumulate(joined, {}, {"top": F.struct(F.col("__d").alias("d"), (-F.col("node")).alias("minus"))})
    return top.join(far, "node").select("node", (-F.col("top.minus")).alias("farthest"), F.round(F.col("top.d") - F.col("__d"), 9).alias("distance"))


def edge_influenced(nodes: DataFrame, cells: DataFrame, spec: GridSpec) -> DataFrame:
    """Nodes that drain, or receive flow, from the edge of the data: whoever has an edge cell upstream or is one."""
    inner = window3(cells.where("value IS NOT NULL"))
    edge = inner.where(F.greatest(*[F.col(f"n{k}").isNull().cast("int") for k in range(8)]) == 1).select(spec.node().alias("node"), F.lit(1).alias("edge"))
    marked = nodes.join(edge, "node", "left").fillna(0, ["edge"])
    return accumulate(marked, {}, {"touched": F.col("edge")}).where("touched = 1").select("node")


def sources_by_area(nodes: DataFrame, counts: DataFrame, threshold: int) -> DataFrame:
    """Nodes with at least ``threshold`` contributing nodes whose donors all have fewer."""
    return _heads(nodes, counts.where(F.col("n_contrib") >= threshold).select("node"))


def sources_by_slope_area(nodes: DataFrame, counts: DataFrame, slopes: DataFrame, threshold: float) -> DataFrame:
    """The same with area times squared slope."""
    joined = counts.join(slopes.select("node", "slope"), "node")
    return _heads(nodes, joined.where(F.col("n_contrib") * F.col("slope") * F.col("slope") >= threshold).select("node"))


def _heads(nodes: DataFrame, channel: DataFrame) -> DataFrame:
    fed = nodes.where("node <> receiver").join(channel, "node", "left_semi").select(F.col("receiver").alias("node")).distinct()
    return channel.join(fed, "node", "left_anti")


def _flood(ground: np.ndarray, start: np.ndarray, value: np.ndarray, drop: float) -> np.ndarray:
    """The lowest values above the ground that reach a start by steps that fall by ``drop``, given values that hold already."""
    out = value.copy()
    heap = [(out[i, j], i, j) for i, j in np.argwhere(start & np.isfinite(out)).tolist()]
    heapq.heapify(heap)
    while heap:
        level, i, j = heapq.heappop(heap)
        if level > out[i, j]:
            continue
        for dr, dc in STEPS:
            a, b = i + dr, j + dc
            if 0 <= a < out.shape[0] and 0 <= b < out.shape[1] and ground[a, b] == ground[a, b] and out[a, b] > (new := max(ground[a, b], level + drop)):
                out[a, b] = new
                heapq.heappush(heap, (new, a, b))
    return out


def fill(cells: DataFrame, min_drop: float = 0.0, tile: int = 256) -> DataFrame:
    """Raise pits: the lowest surface, not below the cells, from which every cell has a way to the edge that falls by ``min_drop`` a step.

    Every inner cell starts infinitely high; edge cells keep their value.  In each round every tile floods itself completely from
    what its margin holds so far, so rounds follow the number of tiles that a way crosses, not of cells.
    """
    from catena.operators.focal import tiled

    def kernel(_corner: tuple[int, int], a: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        inside = ~np.isnan(a["ground"])
        return {"sunk": _flood(a["ground"], inside, np.where(inside, a["value"], np.inf), min_drop)}

    edge = F.greatest(*[F.col(f"n{k}").isNull().cast("int") for k in range(8)]) == 1
    ground = window3(cells.where("value IS NOT NULL"))
    now = store(ground.select("row", "col", F.col("z").alias("ground"), F.when(edge, F.col("z")).otherwise(F.lit(float("inf"))).alias("value")), "fill-0")
    for k in count(1):
        sunk = tiled(now, ["ground", "value"], 1, kernel, {"sunk": "double"}, tile)
        after = store(now.join(sunk, ["row", "col"]).select("row", "col", "ground", F.col("sunk").alias("value"), (F.col("sunk") < F.col("value")).alias("moved")), f"fill-{k}")
        now = after.drop("moved")
        if not after.where("moved").take(1):
            return now.select("row", "col", "value")


def multiple_flow(cells: DataFrame, spec: GridSpec, power: float = 1.1) -> DataFrame:
    """``row, col, area`` with flow shared among all lower neighbours by slope to a power."""
    from catena.operators.routing import spread_flow, weighted_edges

    return spread_flow(cells, weighted_edges(cells, "freeman", power), spec.res * spec.res)


def d_infinity(cells: DataFrame) -> DataFrame:
    """``row, col, angle, slope``: the steepest direction over eight triangular facets, counter-clockwise from east; null in flats."""
    z = window3(cells.where("value IS NOT NULL"))
    # Facets: (edge neighbour, corner neighbour, sign, quarter turns).
    facets = [(2, 1, 1, 0), (0, 1, -1, 1), (0, 7, 1, 1), (6, 7, -1, 2), (6, 5, 1, 2), (4, 5, -1, 3), (4, 3, 1, 3), (2, 3, -1, 4)]
    best = []
    quarter = 1.5707963267948966
    for e, c, sign, turns in facets:
        s1, s2 = F.col("z") - F.col(f"n{e}"), F.col(f"n{e}") - F.col(f"n{c}")
        r = F.atan2(s2, s1)
        along = F.when(r < 0, F.lit(0.0)).when(r > quarter / 2, F.lit(quarter / 2)).otherwise(r)
        slope = F.when(r < 0, s1).when(r > quarter / 2, (F.col("z") - F.col(f"n{c}")) / DIAGONAL).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        best.append(F.struct(slope.alias("slope"), (sign * along + turns * quarter).alias("angle")))
    top = z.select("row", "col", F.array_max(F.filter(F.array(*best), lambda f: f["slope"] > 0)).alias("top"))
    return top.select("row", "col", F.pmod(F.col("top.angle"), F.lit(4 * quarter)).alias("angle"), F.coalesce("top.slope", F.lit(0.0)).alias("slope"))
