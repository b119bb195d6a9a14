"""Whole analyses from a grid of elevations: surface metrics, drainage, chi, valleys.

An analysis returns a dictionary of lazy tables; only what a caller writes is computed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.grid import GridSpec
from catena.operators import algebra, flow, focal, kernels, morphology, network, profile

SURFACE_DEFAULTS: dict[str, Any] = {
    "remove_seas": False, "minimum_elevation": 0.0, "maximum_elevation": 30000.0, "surface_fitting_radius": 3, "print_hillshade": False, "hillshade_altitude": 45.0, "hillshade_azimuth": 315.0,
    "print_relief_raster": False, "relief_window": 3.0, "print_polyfit": True, "print_roughness": False, "roughness_radius": 3,
}
DRAINAGE_DEFAULTS: dict[str, Any] = {"min_slope_for_fill": 0.0001, "raster_is_filled": False, "threshold_contributing_pixels": 10, "a_0": 1.0, "m_over_n": 0.5, "minimum_basin_size_pixels": 10, "maximum_basin_size_pixels": 1_000_000_000, "sigma": 10.0, "minimum_segment_length": 5, "tvd_lambda": 1.0}


def _seas(cells: DataFrame, p: dict[str, Any]) -> DataFrame:
    if not p["remove_seas"]:
        return cells
    return algebra.mask_above(algebra.mask_below(cells, p["minimum_elevation"]), p["maximum_elevation"])


def surface_metrics(cells: DataFrame, spec: GridSpec, params: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Hillshade, relief, fitted surface and roughness, as switched on."""
    p = SURFACE_DEFAULTS | (params or {})
    data = _seas(cells, p)
    out = {}
    if p["print_hillshade"]:
        out["hillshade"] = focal.hillshade(data, spec.res, p["hillshade_altitude"], p["hillshade_azimuth"])
    if p["print_relief_raster"]:
        out["relief"] = focal.neighbourhood(data, p["relief_window"]).select("row", "col", "relief")
    if p["print_polyfit"]:
        out["surface"] = focal.polynomial_surface(data, p["surface_fitting_radius"], spec.res)
    if p["print_roughness"]:
        out["roughness"] = focal.roughness(data, p["roughness_radius"], spec.res)
    return out


def drainage(cells: DataFrame, spec: GridSpec, params: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Filled surface, flow tree, contributing area, channels with order, junctions, basins and chi."""
    p = DRAINAGE_DEFAULTS | (params or {})
    filled = cells if p["raster_is_filled"] else flow.fill(cells, p["min_slope_for_fill"])
    nodes = flow.d8(filled, spec)
    counts = flow.contributing(nodes)
    area = counts.withColumn("area", F.col("n_contrib") * spec.res * spec.res)
    sources = flow.sources_by_area(nodes, counts, p["threshold_contributing_pixels"])
    channel = network.channel_nodes(nodes, sources)
    order = network.strahler(channel)
    outlets = network.prune_by_size(counts.join(flow.base_level(nodes).select("node"), "node"), p["minimum_basin_size_pixels"], p["maximum_basin_size_pixels"])
    return {
        "filled": filled, "nodes": nodes, "area": area, "sources": sources, "channel": channel, "order": order, "junctions": network.junctions(channel, order),
        "outlets": outlets, "basins": network.basins(nodes, outlets), "chi": flow.chi(nodes, area, p["m_over_n"], p["a_0"]), "source_keys": network.source_keys(channel, sources),
    }


def chi_profiles(parts: dict[str, DataFrame], params: dict[str, Any] | None = None) -> dict[str, DataFrame]:
    """Channel profiles from ``drainage``: chi data, fitted segments, denoised steepness and its steps."""
    p = DRAINAGE_DEFAULTS | (params or {})
    distance = flow.distance_from_outlet(parts["nodes"]).select("node", "distance")
    data = parts["source_keys"].join(parts["nodes"].select("node", F.col("z").alias("elevation"), "dx"), "node").join(parts["area"].select("node", "area"), "node").join(parts["chi"].select("node", "root", "chi"), "node").join(distance, "node")
    data = data.select("source_key", F.col("root").alias("basin_key"), "node", "chi", "elevation", F.col("distance").alias("flow_distance"), F.col("area").alias("drainage_area"), "dx")
    from pyspark.sql import Window

    data = data.withColumn("pos", F.row_number().over(Window.partitionBy("source_key").orderBy("flow_distance", "node")).cast("long"))
    fitted = kernels.segment_channels(data, p["sigma"], p["minimum_segment_length"])
    smooth = kernels.denoise(fitted, "m_chi", p["tvd_lambda"])
    return {"chi_data": data, "segments": fitted, "steps": profile.changes(smooth, "denoised"), "slope_area": profile.slope_area(data.withColumnRenamed("drainage_area", "area"), 2.0)}


def valleys(parts: dict[str, DataFrame], spec: GridSpec, relief_below: float, slope_below: float, least_cells: int) -> dict[str, DataFrame]:
    """Flat low ground beside channels: patches of cells little above their channel and gently sloping."""
    heights = parts["nodes"].select("node", "z")
    relief = network.to_channel(parts["nodes"], parts["channel"], heights)
    slope = flow.d8_slope(parts["nodes"])
    low = relief.join(slope, "node").where((F.col("relief") <= relief_below) & (F.col("slope") <= slope_below)).select("row", "col", F.lit(1).alias("value"))
    found = morphology.patches_of_size(morphology.components(low, spec.ncols), least_cells)
    touching = found.join(parts["channel"].select("row", "col"), ["row", "col"], "left_semi").select("component").distinct()
    return {"floodplain": found.join(touching, "component", "left_semi"), "terraces": found.join(touching, "component", "left_anti"), "relief": relief}


def cosmogenic(samples: DataFrame, basins: DataFrame, nodes: DataFrame, latitude: float, spec: GridSpec, nuclide: str = "be10") -> DataFrame:
    """Erosion rate of each sampled basin (basin, concentration), with Stone's scaling at every cell's height."""
    from catena.functions import nuclide as n

    cells = basins.join(nodes.select("node", "z"), "node").withColumn("scaling", n.stone_scaling(F.lit(latitude), n.pressure(F.col("z"))))
    return n.basin_erosion(cells, samples, nuclide)
