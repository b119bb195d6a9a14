"""Ridges, hilltops, valleys, channel heads and swaths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.grid import window3
from catena.operators import flow, focal, network
from catena.operators.morphology import in_order
from catena.storage import store


def ridges(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Cells (row, col, basin) on the border of basins with another basin: the divides."""
    edge = network.perimeter(members)
    touching = network.spread_labels(members).join(edge.select("row", "col", "basin"), ["row", "col"])
    return touching.where("near <> basin").select("row", "col", "basin").distinct()


def hilltops(ridge: DataFrame, slopes: DataFrame, gentler: float) -> DataFrame:
    """Ridge cells with a slope (row, col, slope) below a bound."""
    return ridge.join(slopes.select("row", "col", "slope"), ["row", "col"]).where(F.col("slope") < gentler)


def hilltop_curvature(hilltop: DataFrame, surface: DataFrame) -> DataFrame:
    """Negative curvature (row, col, curvature) at hilltops; positive values are left out."""
    return hilltop.select("row", "col").join(surface.select("row", "col", "curvature"), ["row", "col"]).where("curvature < 0")


def main_stem(channel: DataFrame, outlets: DataFrame) -> DataFrame:
    """``outlet, node, step``: the longest channel above each outlet, step 0 at its head."""
    top = flow.farthest_upslope(channel).join(outlets.select("node"), "node", "left_semi")
    ways = flow.flow_paths(channel, top.select(F.col("farthest").alias("node")))
    here = top.select(F.col("node").alias("outlet"), F.col("farthest").alias("start"))
    end = ways.join(here, (ways["start"] == here["start"]) & (ways["node"] == here["outlet"])).select("outlet", here["start"].alias("s"), F.col("step").alias("last"))
    return ways.join(end, (ways["start"] == end["s"]) & (ways["step"] <= end["last"])).select("outlet", "node", "step")


def tributaries(channel: DataFrame, stem: DataFrame) -> DataFrame:
    """``outlet, node, junction``: channel nodes that flow into an outlet's main stem and are not part of that stem."""
    inflow = channel.where("node <> receiver").select("node", F.col("receiver").alias("junction")).join(stem.select("outlet", F.col("node").alias("junction")), "junction")
    return inflow.join(stem.select("outlet", "node"), ["outlet", "node"], "left_anti").select("outlet", "node", "junction")


def split_channels(profile: DataFrame, length: float, distance: str = "flow_distance") -> DataFrame:
    """``reach`` numbers for stretches of a length along each channel, unique over all channels."""
    reach = F.floor(F.col(distance) / length).cast("long")
    named = in_order(profile.select("source_key", reach.alias("r")), "source_key", "r").withColumn("reach", F.col("number") + 1).drop("number")
    return profile.withColumn("r", reach).join(named, ["source_key", "r"]).drop("r")


def reach_hillslopes(nodes: DataFrame, reaches: DataFrame) -> DataFrame:
    """Every node with the reach (node, reach) that it drains to first."""
    return flow.nearest_tag(nodes, reaches.select("node", F.col("reach").alias("tag"))).select("node", F.col("tag").alias("reach"))


def chi_heads(profile: DataFrame, least: int = 10) -> DataFrame:
    """``source_key, node, score``: the likely channel head of each profile (pos upstream, chi, elevation).

    Of all splits into a lower and an upper part the one where the lower part is most like a line in chi and the upper
    one least: its correlation minus half of how far the upper residuals' Durbin-Watson statistic is above 2.
    """

    def kernel(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y = rows["chi"].astype(float), rows["elevation"].astype(float)
        best = (-math.inf, 0)
        for cut in range(least, len(x) - least + 1):
            r = np.corrcoef(x[:cut], y[:cut])[0, 1] if y[:cut].std() > 0 and x[:cut].std() > 0 else 0.0
            m, b = np.polyfit(x[cut:], y[cut:], 1) if x[cut:].std() > 0 else (0.0, y[cut:].mean())
            e = y[cut:] - m * x[cut:] - b
            dw = (np.diff(e) ** 2).sum() / max(1e-300, (e**2).sum())
            best = max(best, (round(r * r - (dw - 2) / 2, 9), cut))
        ok = math.isfinite(best[0])
        return {"node": rows["node"][[best[1] - 1 if ok else 0]], "score": np.array([best[0] if ok else np.nan])}

    from catena.operators.kernels import by_channel

    found = by_channel(profile, ["node", "chi", "elevation"], kernel, "source_key long, node long, score double")
    return found.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def curved_channels(cells: DataFrame, radius_cells: int, res: float, threshold: float | None = None, quantile: float = 0.95) -> DataFrame:
    """Cells where the tangential curvature exceeds a threshold, or else where it leaves a normal distribution's upper quantile."""
    t = focal.polynomial_surface(cells, radius_cells, res).select("row", "col", F.col("tangential").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    if threshold is None:
        from catena.functions.stats import normal_quantile

        s = t.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).head()
        threshold = (s["m"] or 0.0) + normal_quantile(quantile) * (s["s"] or 0.0)
    return t.where(F.col("value") > threshold).select("row", "col", F.lit(1).alias("value"))


def curvature_heads(cells: DataFrame, nodes: DataFrame, radius_cells: int, res: float = 1.0, times: float = 3.0, threshold: float | None = None) -> DataFrame:
    """``node``: channel heads where the tangential curvature exceeds a threshold and nowhere upstream does (Pelletier 2013).

    Without a threshold it is a number of deviations of the curvature over the grid; only whole windows are fitted.
    """
    t = store(focal.polynomial_surface(cells, radius_cells, res, partial=False).select("row", "col", "tangential").where("tangential IS NOT NULL AND NOT isnan(tangential)"), "tangential")
    if threshold is None:
        threshold = times * (t.agg(F.stddev_pop("tangential")).head()[0] or 0.0)
    marked = nodes.join(t.where(F.col("tangential") > threshold).select("row", "col", F.lit(1).cast("long").alias("__m")), ["row", "col"], "left").fillna(0, ["__m"])
    found = flow.accumulate(marked, {"above": F.col("__m")})
    return marked.where("__m = 1").select("node").join(found.where("above = 1").select("node"), "node")


def terraces_by_relief(relief: DataFrame, slopes: DataFrame, relief_share: float = 0.25, slope_share: float = 0.25) -> DataFrame:
    """Cells low above their channel and gentle: below the given quantiles of relief and slope over the grid."""
    j = relief.select("node", "relief").join(slopes.select("node", "row", "col", "slope"), "node")
    q = j.agg(F.percentile(F.col("relief"), F.lit(relief_share)).alias("r"), F.percentile(F.col("slope"), F.lit(slope_share)).alias("s")).head()
    return j.where((F.col("relief") <= (q["r"] or 0.0)) & (F.col("slope") <= (q["s"] or 0.0))).select("row", "col", F.lit(1).alias("value"))


def swath_coordinates(points: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """``along`` and ``across`` of points (x, y) beside a line of vertices, by its nearest segment; across is positive on the left."""
    options, run = [], 0.0
    for (x1, y1), (x2, y2) in zip(line[:-1], line[1:], strict=True):
        n = math.hypot(x2 - x1, y2 - y1)
        u, v = (x2 - x1) / n, (y2 - y1) / n
        t = F.greatest(F.lit(0.0), F.least(F.lit(n), (F.col("x") - x1) * u + (F.col("y") - y1) * v))
        dx, dy = F.col("x") - x1 - t * u, F.col("y") - y1 - t * v
        d = F.sqrt(dx * dx + dy * dy)
        side = F.when((F.col("y") - y1) * u - (F.col("x") - x1) * v >= 0, d).otherwise(-d)
        options.append(F.struct(d.alias("d"), (F.lit(run) + t).alias("along"), side.alias("across")))
        run += n
    best = points.withColumn("__b", F.array_min(F.array(*options)))
    return best.withColumns({"along": F.col("__b.along"), "across": F.col("__b.across")}).drop("__b")


def valley_widths(floodplain: DataFrame, line: DataFrame, reach: int) -> DataFrame:
    """``node, width`` in cells: how far the flood plain (row, col) goes on both sides, square to the channel (node, row, col, bearing).

    Each node looks along its cross line cell by cell, an equi-join; the width ends at the first cell outside on each side.
    """
    looks = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("i")
    across = F.radians(F.col("bearing") + 90)
    seen = line.select("node", "row", "col", across.alias("a"), looks)
    # To nine places first, so that the last digit of a sine does not decide where half a cell goes.
    cell = lambda x: F.round(F.round(x, 9)).cast("int")
    seen = seen.select("node", "i", cell(F.col("row") - F.cos("a") * F.col("i")).alias("row"), cell(F.col("col") + F.sin("a") * F.col("i")).alias("col"))
    inside = floodplain.select("row", "col", F.lit(True).alias("inside"))
    j = seen.join(inside, ["row", "col"], "left")
    ends = j.groupBy("node").agg(F.min(F.when(F.col("inside").isNull() & (F.col("i") >= 0), F.col("i"))).alias("right"), F.max(F.when(F.col("inside").isNull() & (F.col("i") <= 0), F.col("i"))).alias("left"))
    right, left = F.coalesce("right", F.lit(reach + 1)), F.coalesce("left", F.lit(-reach - 1))
    return ends.select("node", F.greatest(F.lit(0), right - left - 1).alias("width"))


def bordered_by_nodata(cells: DataFrame) -> DataFrame:
    """Data cells with a gap among their eight neighbours."""
    w = window3(cells.where("value IS NOT NULL"))
    gaps = sum((F.col(f"n{k}").isNull().cast("int") for k in range(8)), F.lit(0))
    return w.select("row", "col", gaps.alias("gaps")).where("gaps > 0")


def terrain_shape(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """Mean height over the eight neighbours per mean distance to them (McNab 1989); whole windows only."""
    w = window3(cells.where("value IS NOT NULL"))
    apart = (12 * res + 8 * math.sqrt(2) * res) / 20
    total = sum((F.col("z") - F.col(f"n{k}") for k in range(8)), F.lit(0.0))
    return w.select("row", "col", (total / 8 / apart).alias("value")).where("value IS NOT NULL")


# Corners (shape index, elevation) of the vegetation types' areas (Bolstad and others 1998).
COVE = [(0, 1065), (3500, 1182), (3500, 600), (0, 600)]
DECIDUOUS = [(3500, 1182), (6562.5, 1287), (7812.5, 1322), (7812.5, 839), (7375, 755), (6562.5, 720), (5250, 600), (3500, 600)]
XERIC = [(5250, 600), (6562.5, 720), (7375, 755), (7812.5, 839), (7812.5, 1322), (10001, 1322), (10001, 600)]
NORTHERN = [(0, 1065), (3500, 1182), (6562.5, 1287), (7812.5, 1322), (10001, 1322), (10001, 1600), (0, 1600)]


def vegetation(shape: DataFrame, heights: DataFrame) -> DataFrame:
    """1 cove hardwood, 2 mixed deciduous, 3 oak and pine, 4 northern hardwood, null elsewhere."""
    from catena.operators.joins import in_polygon

    j = shape.select("row", "col", F.col("value").alias("t")).join(heights.select("row", "col", F.col("value").alias("h")), ["row", "col"])
    kinds = [F.when(in_polygon(F.col("t"), F.col("h"), p), k) for k, p in enumerate((COVE, DECIDUOUS, XERIC, NORTHERN), 1)]
    return j.select("row", "col", F.coalesce(*kinds).alias("value"))


def landslides(safety: DataFrame, heights: DataFrame, ncols: int, least_cells: int) -> DataFrame:
    """Connected unstable areas (factor of safety below 1) of some size, with the heights they span."""
    from catena.operators import morphology

    unstable = safety.where("value < 1").select("row", "col", F.lit(1).alias("value"))
    areas = morphology.patches_of_size(morphology.components(unstable, ncols), least_cells)
    return areas.join(heights, ["row", "col"]).groupBy("component").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def sediment_flux(cells: DataFrame, erosion: DataFrame, fertility: DataFrame, spec_area: float) -> DataFrame:
    """Share of each rock type (row, col, litho) in the sediment: area times erosion times fertility, summed up."""
    j = cells.select("row", "col", "litho").join(erosion.select("row", "col", F.col("value").alias("e")), ["row", "col"]).join(fertility.select("litho", "fertility"), "litho")
    s = j.groupBy("litho").agg((F.sum(F.col("e") * F.col("fertility")) * spec_area).alias("flux"))
    return s.withColumn("share", F.col("flux") / F.sum("flux").over(Window.partitionBy()))


def cast_shadows(cells: DataFrame, res: float, altitude: float, azimuth: float, reach: int) -> DataFrame:
    """1 where a cell within ``reach`` toward the sun stands above the line to it, else 0."""
    a, rise = math.radians(azimuth), math.tan(math.radians(altitude)) * res

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        dark = np.zeros_like(z)
        p = np.pad(z, reach, constant_values=np.nan)
        for d in range(1, reach + 1):
            i, j = round(-d * math.cos(a)), round(d * math.sin(a))
            far = p[reach + i : reach + i + z.shape[0], reach + j : reach + j + z.shape[1]]
            dark = np.where(far > z + rise * math.hypot(i, j), 1.0, dark)
        return {"shadow": dark}

    return focal.on_tiles(cells, reach, kernel, ["shadow"])
