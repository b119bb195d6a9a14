"""Joins of points and cells: burning, snapping, nearest, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catena.grid import GridSpec, disc
from catena.storage import store


def in_cells(points: DataFrame, spec: GridSpec) -> DataFrame:
    """Points (x, y) with the row and col of their cell; points outside the grid are left out."""
    return points.where(spec.contains(F.col("x"), F.col("y"))).withColumns({"row": spec.row(F.col("y")), "col": spec.col(F.col("x"))})


def burn(points: DataFrame, cells: DataFrame, spec: GridSpec, name: str = "burned") -> DataFrame:
    """Points with the value of the cell they lie in (null: nodata or outside)."""
    found = points.withColumns({"row": spec.row(F.col("y")), "col": spec.col(F.col("x"))})
    return found.join(cells.select("row", "col", F.col("value").alias(name)), ["row", "col"], "left")


def nearest_within(points: DataFrame, targets: DataFrame, radius: int, key: str = "id") -> DataFrame:
    """For each point (id, row, col) the nearest target cell (row, col, node) within a radius: id, node, distance.

    Targets are sent to the cells of their window that hold points, an equi-join on distinct cells whose minimum combines before
    the shuffle; points then look up their own cell.  Of equally near targets the smallest node is taken.
    """
    asked = points.select("row", "col").distinct()
    looks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i * i + j * j).alias("d2")) for i, j in disc(radius)])
    sent = targets.select("node", F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(looks).alias("m"))
    sent = sent.select((F.col("r0") + F.col("m.i")).alias("row"), (F.col("c0") + F.col("m.j")).alias("col"), F.col("m.d2").alias("d2"), "node")
    best = sent.groupBy("row", "col").agg(F.min(F.struct("d2", "node")).alias("best")).join(asked, ["row", "col"], "left_semi")
    return points.select(key, "row", "col").join(best, ["row", "col"]).select(key, F.col("best.node").alias("node"), F.sqrt("best.d2").alias("distance"))


def greatest_within(points: DataFrame, cells: DataFrame, radius: int, key: str = "id") -> DataFrame:
    """For each point the cell of greatest value in its window."""
    looks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disc(radius, circular=False)])
    sent = points.select(key, F.col("row").alias("r0"), F.col("col").alias("c0"), F.explode(looks).alias("m")).select(key, (F.col("r0") + F.col("m.i")).alias("row"), (F.col("c0") + F.col("m.j")).alias("col"))
    found = sent.join(cells.where("value IS NOT NULL"), ["row", "col"]).groupBy(key).agg(F.max(F.struct("value", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("best"))
    return found.select(key, (-F.col("best.r")).alias("row"), (-F.col("best.c")).alias("col"), F.col("best.value").alias("value"))


def nearest(points: DataFrame, targets: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """The nearest target (id2, x, y) of each point (id, x, y) at any distance: id, id2, distance; null where there is no target.

    Distinct places look for targets: buckets of side ``cell`` are joined with their neighbours; places that found nothing within the
    bucket's side look again with buckets twice as large, until all have found one.  Each round is stored.
    """
    asked = points.select(key, "x", "y")
    targets = store(targets.select(F.col("id2"), F.col("x").alias("tx"), F.col("y").alias("ty")), "targets")
    none = F.lit(None)
    if not targets.take(1):
        return asked.select(key, none.cast(targets.schema["id2"].dataType).alias("id2"), none.cast("double").alias("distance"))
    left, done = store(asked.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct(), "places"), []
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    bucket = lambda c, size: F.floor(F.col(c) / size)
    while left.take(1):
        here = left.select("x", "y", bucket("x", cell).alias("bx"), bucket("y", cell).alias("by"), F.explode(around).alias("m"))
        here = here.select("x", "y", (F.col("bx") + F.col("m.i")).alias("bx"), (F.col("by") + F.col("m.j")).alias("by"))
        there = targets.withColumns({"bx": bucket("tx", cell), "by": bucket("ty", cell)})
        d = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
        found = here.join(there, ["bx", "by"]).groupBy("x", "y").agg(F.min(F.struct(d.alias("d"), "id2")).alias("best")).where(F.col("best.d") <= cell)
        done.append(store(found.select("x", "y", F.col("best.id2").alias("id2"), F.col("best.d").alias("distance")), f"nearest-{len(done)}"))
        left = store(left.join(done[-1].select("x", "y"), ["x", "y"], "left_anti"), f"left-{len(done)}")
        cell *= 2
    if not done:
        return asked.select(key, none.cast(targets.schema["id2"].dataType).alias("id2"), none.cast("double").alias("distance"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return asked.join(every, ["x", "y"], "left").select(key, "id2", "distance")


def in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: a ray to the east crosses its border an odd number of times."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 != y2:
            side = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossed = crossed + F.when(side & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1


def bilinear(points: DataFrame, cells: DataFrame, spec: GridSpec, key: str = "id") -> DataFrame:
    """``id, value`` interpolated between the centres of the four cells around a point; null if one has no data."""
    u, v = (F.col("x") - spec.xmin) / spec.res - 0.5, (F.lit(float(spec.nrows)) - (F.col("y") - spec.ymin) / spec.res) - 0.5
    p = points.select(key, u.alias("u"), v.alias("v")).withColumns({"c0": F.floor("u"), "r0": F.floor("v")})
    fu, fv = F.col("u") - F.col("c0"), F.col("v") - F.col("r0")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), ((fv if i else 1 - fv) * (fu if j else 1 - fu)).alias("w")) for i in (0, 1) for j in (0, 1)])
    sent = p.select(key, "r0", "c0", F.explode(corners).alias("m")).select(key, (F.col("r0") + F.col("m.i")).cast("int").alias("row"), (F.col("c0") + F.col("m.j")).cast("int").alias("col"), F.col("m.w").alias("w"))
    found = sent.where("w > 0").join(cells.select("row", "col", "value"), ["row", "col"], "left")
    return found.groupBy(key).agg(F.when(F.count("*") == F.count("value"), F.sum(F.col("w") * F.col("value"))).alias("value"))


def within(points: DataFrame, targets: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """``id, id2, distance`` of all targets (id2, x, y) within a radius of each point, by buckets of the radius."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    bucket = lambda c: F.floor(F.col(c) / radius)
    here = points.select(key, "x", "y", bucket("x").alias("bx"), bucket("y").alias("by"), F.explode(around).alias("m")).select(key, "x", "y", (F.col("bx") + F.col("m.i")).alias("bx"), (F.col("by") + F.col("m.j")).alias("by"))
    there = targets.select("id2", F.col("x").alias("tx"), F.col("y").alias("ty"), bucket("x").alias("bx"), bucket("y").alias("by"))
    d = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    return here.join(there, ["bx", "by"]).select(key, "id2", d.alias("distance")).where(F.col("distance") <= radius)
