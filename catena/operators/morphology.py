"""Connected areas, patches and skeletons of binary grids."""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.grid import STEPS, spread, window3
from catena.operators import focal, graph
from catena.storage import store


def _label(have: np.ndarray) -> np.ndarray:
    """The smallest position of each cell's area within one array (-1: no data), by hooking and pointer jumps."""
    n = have.size
    own = np.arange(n).reshape(have.shape)
    parent = np.arange(n)
    label = np.where(have, own, n)
    while True:
        p = np.pad(label, 1, constant_values=n)
        low = label.copy()
        for dr, dc in STEPS:
            low = np.minimum(low, p[1 + dr : 1 + dr + have.shape[0], 1 + dc : 1 + dc + have.shape[1]])
        low[~have] = n
        before = label
        np.minimum.at(parent, label[have], low[have])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = np.where(have, parent[np.where(have, label, 0)], n)
        if (label == before).all():
            return np.where(have, label, -1)


def components(cells: DataFrame, ncols: int, tile: int = focal.TILE) -> DataFrame:
    """``row, col, component``: areas of data cells that touch by edges or corners, numbered by their first cell.

    Tiles label their own areas at once.  Areas that touch across a tile's border are linked, the links' components
    are found (a graph of borders, not of cells), and labels follow their roots.
    """

    def kernel(corner: tuple[int, int], arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        have = ~np.isnan(arrays["value"])
        at = _label(have)
        r, c = np.divmod(np.maximum(at, 0), have.shape[1])
        return {"label": (r + corner[0]).astype(np.int64) * ncols + c + corner[1]}

    local = store(focal.tiled(cells.where("value IS NOT NULL").select("row", "col", F.lit(1).alias("value")), ["value"], 0, kernel, {"label": "long"}, tile), "tile-labels")
    rim = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    border = local.where(rim("row") | rim("col"))
    links = spread(border, STEPS, "label").join(border, ["row", "col"]).where("sent <> label").select(F.col("sent").alias("a"), F.col("label").alias("b"))
    roots = graph.components(links)
    return local.join(roots, local["label"] == roots["node"], "left").select("row", "col", F.coalesce("root", "label").alias("component"))


def in_order(values: DataFrame, first: str, *then: str, bucket: int = 1 << 16) -> DataFrame:
    """Distinct rows of a long column (and more) with their ``number`` from 0 in order.

    Rows are numbered within buckets of the first column's range; only the buckets' counts are ordered as a whole.
    """
    rows = values.select(first, *then).distinct().withColumn("__b", F.floor(F.col(first) / bucket))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(first, *then))
    return rows.withColumn("__p", place).join(starts, "__b").select(first, *then, (F.col("__start") + F.col("__p") - 1).alias("number"))


def numbered(found: DataFrame) -> DataFrame:
    """Components renumbered from 0 in order of their first cells."""
    return found.join(in_order(found, "component"), "component").select("row", "col", F.col("number").alias("component"))


def patches_of_size(found: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Cells of components with at least ``least`` (and at most ``most``) cells."""
    n = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if most is not None:
        n = n.where(F.col("n") <= most)
    return found.join(n, "component").select("row", "col", "component", "n")


def fill_holes(cells: DataFrame, nrows: int, ncols: int, most: int) -> DataFrame:
    """Gaps of at most ``most`` cells inside the data become 1."""
    from catena.operators.algebra import pad

    gaps = pad(cells, nrows, ncols).where("value IS NULL").withColumn("value", F.lit(1))
    small = patches_of_size(components(gaps, ncols), 1, most).select("row", "col", F.lit(1).alias("value"))
    return cells.where("value IS NOT NULL").select("row", "col", F.col("value").cast("int")).unionByName(small)


def _peel(one: np.ndarray, half: int) -> np.ndarray:
    p = np.pad(one, 1)
    n = [p[1 + dr : 1 + dr + one.shape[0], 1 + dc : 1 + dc + one.shape[1]].astype(np.int8) for dr, dc in STEPS]
    count = sum(n)
    turns = sum((n[i] == 0) & (n[(i + 1) % 8] == 1) for i in range(8))
    a, b = ((n[0] * n[2] * n[4], n[2] * n[4] * n[6]), (n[0] * n[2] * n[6], n[0] * n[4] * n[6]))[half]
    return one & ~((count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0))


def thin(cells: DataFrame, tile: int = focal.TILE, passes: int = 16) -> DataFrame:
    """A skeleton one cell wide of a binary grid, by alternate peeling of south-east and north-west rims (Zhang and Suen 1984).

    A pass looks two cells far, so with a margin of twice their number a tile does several passes exactly; rounds go on until none changes.
    """

    def kernel(_corner: tuple[int, int], arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        one = arrays["value"] == 1
        for _ in range(passes):
            one = _peel(_peel(one, 0), 1)
        return {"value": one.astype(np.int32)}

    now = store(cells.where("value = 1").select("row", "col", F.lit(1).alias("value")), "thin-0")
    for k in count(1):
        left = focal.tiled(now, ["value"], 2 * passes, kernel, {"value": "int"}, tile).where("value = 1")
        before, now = now, store(left, f"thin-{k}")
        if now.count() == before.count():
            return now


def end_points(skeleton: DataFrame) -> DataFrame:
    """Cells of a skeleton with one neighbour at most."""
    w = window3(skeleton)
    count = sum((F.when(F.col(f"n{i}") == 1, 1).otherwise(0) for i in range(8)), F.lit(0))
    return w.where(count <= 1).select("row", "col")


def remove_checkerboard(cells: DataFrame) -> DataFrame:
    """Cells that touch the data only by corners go."""
    w = window3(cells.where("value = 1"))
    sides = sum((F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in (0, 2, 4, 6)), F.lit(0))
    return w.where(sides > 0).select("row", "col", F.lit(1).alias("value"))
