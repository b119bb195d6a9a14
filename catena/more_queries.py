"""More terrain queries: single-column operations, files, small operators; registered beside those of ``catena.queries``."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from catena.functions import geo, nuclide, soil, stats
from catena.grid import GridSpec
from catena.operators import algebra, flow, focal, joins, landforms, network, profile
from catena.queries import CHANNEL_SQL, COMPONENT_SQL, D8_WAYS, GRID_SQL, INFINITE_SQL, KEYS_SQL, NUDGE, ORDER_SQL, OUTS, ROOTED, SLOPES, SPOTS_SQL, STEPS_SQL, STRAHLER_SQL, _collinear_sql, _F, _DF, _fit_sql, _stone_sql, _STONE_SQL, _theta_sql, channel_of, d8, nudged, outlets_of, query, r6, rooted, rounded, spec
from catena.sources import grids, tables
from catena.storage import folder

# --- map algebra and columns ---


@query("raster_scale_add", "cells", sql='SELECT row AS "row", col, round(value * 2.5::DOUBLE + 10 + 3e-8::DOUBLE, 6) AS value FROM cells')
def _(cells):
    return nudged(algebra.scale_by(cells, 2.5, 10.0), "value")


@query("feet_to_metres", "cells", sql=f'SELECT row AS "row", col, round(value * {algebra.FEET}::DOUBLE, 6) AS value FROM cells')
def _(cells):
    return rounded(algebra.feet_to_metres(cells), "value")


@query("centimetres_to_metres", "cells", sql=f'SELECT row AS "row", col, round(value * 0.01::DOUBLE + {NUDGE}::DOUBLE, 6) AS value FROM cells')
def _(cells):
    return nudged(algebra.centimetres_to_metres(cells), "value")


@query("normalised_index", "cells", sql='SELECT row AS "row", col, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM cells')
def _(cells):
    return rounded(algebra.rescale(cells, 0.0, 1.0), "value")


@query("mask_above", "cells", sql='SELECT row AS "row", col, CASE WHEN value <= 55000 THEN value END AS value FROM cells')
def _(cells):
    return algebra.mask_above(cells, 55000)


@query("extract_by_mask", "cells", "cells2", sql='SELECT a.row AS "row", a.col, a.value FROM cells a JOIN cells2 b ON a.row = b.row AND a.col = b.col WHERE b.value > 26')
def _(cells, cells2):
    return algebra.extract(cells, algebra.to_mask(cells2, F.col("value") > 26))


@query("cut_out_by_mask", "cells", "cells2", sql='SELECT a.row AS "row", a.col, a.value FROM cells a JOIN cells2 b ON a.row = b.row AND a.col = b.col WHERE b.value <= 26')
def _(cells, cells2):
    return algebra.extract(cells, algebra.to_mask(cells2, F.col("value") > 26), inside=False)


@query("border_nodata", "cells", sql='SELECT c.row AS "row", c.col, CASE WHEN c.row BETWEEN 2 AND size.n - 3 AND c.col BETWEEN 2 AND size.n - 3 THEN value END AS value FROM cells c, size')
def _(cells):
    return algebra.border_nodata(cells, spec().nrows, spec().ncols, 2)


@query("padded_grid", "cells", sql='SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS col, v.value FROM (SELECT unnest(range(0, n)) AS i FROM size) r CROSS JOIN (SELECT unnest(range(0, n)) AS i FROM size) c LEFT JOIN cells v ON v.row = r.i AND v.col = c.i AND v.value >= 60000')
def _(cells):
    return algebra.pad(cells.where("value >= 60000"), spec().nrows, spec().ncols)


@query("replace_cells", "cells", sql='SELECT row AS "row", col, CASE WHEN (row + col) % 7 = 0 THEN CAST(row AS DOUBLE) ELSE value END AS value FROM cells')
def _(cells):
    points = cells.where("(row + col) % 7 = 0").select("row", "col", F.col("row").cast("double").alias("value"))
    return algebra.replace_cells(cells, points)


@query("point_in_raster", "points", more=SPOTS_SQL, sql="SELECT id, x * 1.5::DOUBLE < n AND y * 1.5::DOUBLE - 5 >= 0 AND y * 1.5::DOUBLE - 5 < n AS inside FROM spots")
def _(points):
    return points.select("id", spec().contains(F.col("x") * 1.5, F.col("y") * 1.5 - 5).alias("inside"))


@query("fill_between", "cells", more="f0 AS (SELECT CAST(r.i AS INT) AS row, CAST(c.i AS INT) AS col, v.value FROM (SELECT unnest(range(0, n)) AS i FROM size) r CROSS JOIN (SELECT unnest(range(0, n)) AS i FROM size) c LEFT JOIN cells v ON v.row = r.i AND v.col = c.i AND v.value >= 50000),\n"
       "s AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, first_value(value IGNORE NULLS) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b, last_value(value IGNORE NULLS) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c, first_value(value IGNORE NULLS) OVER (PARTITION BY col ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS d FROM f0)",
       sql='SELECT * FROM (SELECT row AS "row", col, round(coalesce(value, (a + b + c + d) / 4) + 1e-7::DOUBLE, 5) AS value FROM s) WHERE value IS NOT NULL')
def _(cells):
    return focal.fill_between(algebra.mask_below(cells, 50000), spec().nrows, spec().ncols, 3).withColumn("value", F.round(F.col("value") + 1e-7, 5))


@query("column_operations", "points", sql="SELECT id, round(value + 2.5::DOUBLE, 4) AS added, round(value + x, 4) AS summed, round(value * 3.0::DOUBLE, 4) AS times, -9999.0::DOUBLE AS replaced, CAST(value AS FLOAT)::DOUBLE AS as_float, CAST(floor(value) AS INT) AS as_int FROM points")
def _(points):
    v = F.col("value")
    return points.select("id", F.round(v + 2.5, 4).alias("added"), F.round(v + F.col("x"), 4).alias("summed"), F.round(v * 3.0, 4).alias("times"), F.lit(-9999.0).alias("replaced"), v.cast("float").cast("double").alias("as_float"), F.floor(v).cast("int").alias("as_int"))


@query("rows_by_value_list", "profile", sql="SELECT node, kind FROM profile WHERE kind IN ('click', 'purchase')")
def _(profile_):
    return profile_.where(F.col("kind").isin("click", "purchase")).select("node", "kind")


@query("map_by_node", "cells", more=GRID_SQL, sql="SELECT a.node, a.value, b.value AS below FROM grid a JOIN grid b ON b.row = a.row + 1 AND b.col = a.col")
def _(cells):
    named = cells.select(spec().node().alias("node"), "value")
    below = named.select((F.col("node") - spec().ncols).alias("node"), F.col("value").alias("below"))
    return named.join(below, "node")


@query("sort_with_index", "profile", sql="SELECT node, pos AS index_before, row_number() OVER (PARTITION BY source_key ORDER BY elevation DESC, pos) AS index_after FROM profile")
def _(profile_):
    order = Window.partitionBy("source_key").orderBy(F.col("elevation").desc(), "pos")
    return profile_.select("node", F.col("pos").alias("index_before"), F.row_number().over(order).cast("long").alias("index_after"))


@query("extreme_places", "cells", sql='SELECT max(value) AS high, min(value) AS low, arg_max(row * 100000 + col, (value, -row, -col)) AS high_at, arg_min(row * 100000 + col, (value, row, col)) AS low_at FROM cells')
def _(cells):
    at = F.col("row") * 100000 + F.col("col")
    return cells.agg(F.max("value").alias("high"), F.min("value").alias("low"), F.max_by(at, F.struct("value", -F.col("row"), -F.col("col"))).alias("high_at"), F.min_by(at, F.struct("value", "row", "col")).alias("low_at"))


@query("sampled_rows", "points", sql="SELECT id FROM (SELECT id, row_number() OVER (ORDER BY md5('1:' || id), id) AS k FROM points) WHERE k <= 100")
def _(points):
    return stats.sample_rows(points, 100, "id").select("id")


@query("residual_likelihood", "profile", more="f AS (SELECT source_key, regr_slope(elevation, pos) AS s, regr_intercept(elevation, pos) AS i FROM profile GROUP BY 1), r AS (SELECT p.source_key, elevation - s * pos - i AS r FROM profile p JOIN f ON f.source_key = p.source_key)", sql="SELECT source_key, round(exp(-sum(r * r) / 20000000), 6) AS mle, round(avg(abs(r)), 6) AS mae FROM r GROUP BY 1")
def _(profile_):
    fit = stats.regression(profile_, ["source_key"], "pos", "elevation").select("source_key", "slope", "intercept")
    r = F.col("elevation") - F.col("slope") * F.col("pos") - F.col("intercept")
    return rounded(profile_.join(fit, "source_key").groupBy("source_key").agg(stats.likelihood(r, math.sqrt(1e7)).alias("mle"), F.avg(F.abs(r)).alias("mae")), "mle", "mae")


@query("normal_quantile_points", "profile", sql="SELECT CAST(i AS INT) AS i, round(m + s * z, 4) AS normal_quantile FROM (SELECT avg(elevation) AS m, stddev_pop(elevation) AS s FROM profile), (VALUES (1, -0.6744897501960817::DOUBLE), (2, 0.0::DOUBLE), (3, 0.6744897501960817::DOUBLE)) q(i, z)")
def _(profile_):
    return stats.quantile_points(profile_, "elevation", 3).select(F.col("i").cast("int").alias("i"), F.round("normal_quantile", 4).alias("normal_quantile"))


# --- places ---


@query("bearings", "points", sql="SELECT id, round(b - 360 * floor(b / 360), 6) AS bearing, round(acos(greatest(-1.0, least(1.0, (x * 3 + y * 4) / (sqrt(x * x + y * y) * 5)))), 6) AS angle FROM (SELECT *, degrees(atan2(x - 10.25::DOUBLE, y - 20.75::DOUBLE)) AS b FROM points)")
def _(points):
    x, y = F.col("x"), F.col("y")
    return points.select("id", r6(geo.bearing(x - 10.25, y - 20.75)).alias("bearing"), r6(geo.angle_between(x, y, F.lit(3.0), F.lit(4.0))).alias("angle"))


@query("utm_inverse", "samples", sql="SELECT sample, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude FROM samples")
def _(samples):
    east, north = geo.to_utm(F.col("latitude"), F.col("longitude"))
    lat, lon = geo.from_utm(east, north, geo.utm_zone(F.col("longitude")), F.col("latitude") < 0)
    return samples.select("sample", F.round(lat + 1e-7, 4).alias("latitude"), F.round(lon + 1e-7, 4).alias("longitude"))


_E2 = geo._e2()
_AN, _AC, _AR = geo._albers_terms(29.5, 45.5, 23.0, geo.A, _E2)
_LN, _LF, _LR = geo._lambert_terms(33.0, 45.0, 23.0, geo.A, _E2)
_ECC = math.sqrt(_E2)
CONIC_SQL = f"""p AS (SELECT sample, radians(latitude) AS la, radians(longitude + 96.0) AS dl FROM samples WHERE latitude > -50),
q AS (SELECT *, {1 - _E2!r}::DOUBLE * (sin(la) / (1 - {_E2!r}::DOUBLE * sin(la) * sin(la)) - ln((1 - {_ECC!r}::DOUBLE * sin(la)) / (1 + {_ECC!r}::DOUBLE * sin(la))) / {2 * _ECC!r}::DOUBLE) AS q,
  tan(pi() / 4 - la / 2) / power((1 - {_ECC!r}::DOUBLE * sin(la)) / (1 + {_ECC!r}::DOUBLE * sin(la)), {_ECC / 2!r}::DOUBLE) AS t FROM p),
r AS (SELECT sample, dl, sqrt({_AC!r}::DOUBLE - {_AN!r}::DOUBLE * q) * {geo.A / _AN!r}::DOUBLE AS ra, power(t, {_LN!r}::DOUBLE) * {_LF!r}::DOUBLE AS rl FROM q)"""


@query("conic_forward", "samples", more=CONIC_SQL, sql=f"SELECT sample, round(ra * sin(dl * {_AN!r}::DOUBLE), 2) AS ax, round({_AR!r}::DOUBLE - ra * cos(dl * {_AN!r}::DOUBLE), 2) AS ay, round(rl * sin(dl * {_LN!r}::DOUBLE), 2) AS lx, round({_LR!r}::DOUBLE - rl * cos(dl * {_LN!r}::DOUBLE), 2) AS ly FROM r")
def _(samples):
    lat, lon = F.col("latitude"), F.col("longitude")
    (ax, ay), (lx, ly) = geo.albers(lat, lon, 29.5, 45.5, 23.0, -96.0), geo.lambert(lat, lon, 33.0, 45.0, 23.0, -96.0)
    return samples.where("latitude > -50").select("sample", *[F.round(c, 2).alias(n) for c, n in ((ax, "ax"), (ay, "ay"), (lx, "lx"), (ly, "ly"))])


@query("conic_inverse", "samples", sql="SELECT sample, round(latitude, 4) AS alat, round(longitude, 4) AS alon, round(latitude, 4) AS llat, round(longitude, 4) AS llon FROM samples WHERE latitude BETWEEN -30 AND 80 AND longitude BETWEEN -170 AND -20")
def _(samples):
    lat, lon = F.col("latitude"), F.col("longitude")
    a = geo.albers_inverse(*geo.albers(lat, lon, 29.5, 45.5, 23.0, -96.0), 29.5, 45.5, 23.0, -96.0)
    c = geo.lambert_inverse(*geo.lambert(lat, lon, 33.0, 45.0, 23.0, -96.0), 33.0, 45.0, 23.0, -96.0)
    some = samples.where("latitude BETWEEN -30 AND 80 AND longitude BETWEEN -170 AND -20")
    return some.select("sample", *[F.round(x + 1e-6, 4).alias(n) for x, n in zip((*a, *c), ("alat", "alon", "llat", "llon"), strict=True)])


@query("geocentric", "samples", sql=f"SELECT sample, round((n + 100) * cos(la) * cos(lo), 3) AS x, round((n + 100) * cos(la) * sin(lo), 3) AS y, round((n * {1 - _E2!r}::DOUBLE + 100) * sin(la), 3) AS z FROM (SELECT sample, radians(latitude) AS la, radians(longitude) AS lo, {geo.A}::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * sin(radians(latitude)) * sin(radians(latitude))) AS n FROM samples)")
def _(samples):
    x, y, z = geo.to_geocentric(F.col("latitude"), F.col("longitude"), F.lit(100.0))
    return samples.select("sample", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


# --- soil, nuclides, vegetation ---

SLOPED = SLOPES + ", angled AS (SELECT s.node, atan(s.slope / 10000) AS a, c.n_contrib FROM slopes s JOIN counts c ON c.node = s.node WHERE s.slope > 0)"


def sloped(cells):
    nodes = d8(cells)
    slope = flow.d8_slope(nodes).where("slope > 0").select("node", F.atan(F.col("slope") / 10000).alias("a"))
    return slope.join(flow.contributing(nodes), "node")


WET = D8_WAYS + ",\ncounts AS (SELECT ancestor AS node, count(*) AS n_contrib FROM ways GROUP BY ancestor),\n" + SLOPED


@query("wetness_index", "cells", recursive=True, more=WET, sql="SELECT node, round(ln(n_contrib / tan(a)), 6) AS twi FROM angled")
def _(cells):
    return sloped(cells).select("node", r6(soil.wetness_index(F.col("n_contrib"), F.col("a"))).alias("twi"))


@query("slope_stability", "cells", recursive=True, more=WET, sql="SELECT node, round(2.0 * sin(a) / n_contrib, 6) AS supply, round(least(1.0::DOUBLE, 0.05::DOUBLE * n_contrib / (2.0 * sin(a))), 6) AS wetness, round((0.1::DOUBLE + cos(a) * (1 - least(1.0::DOUBLE, 0.05::DOUBLE * n_contrib / (2.0 * sin(a))) * 0.5) * tan(0.7::DOUBLE)) / sin(a), 5) AS fs FROM angled")
def _(cells):
    s, n = F.col("a"), F.col("n_contrib")
    wet = soil.relative_wetness(F.lit(0.05), F.lit(2.0), n, s)
    return sloped(cells).select("node", r6(soil.saturation_supply(F.lit(2.0), n, s)).alias("supply"), r6(wet).alias("wetness"), F.round(soil.factor_of_safety(F.lit(0.1), wet, 0.5, s, F.lit(0.7)), 5).alias("fs"))


@query("snow_depth", "cells", sql='SELECT row AS "row", col, round(greatest(5.0::DOUBLE, least(60.0::DOUBLE, value / 1000 * 0.8::DOUBLE + 5)), 6) AS linear, round(70.0 * power(1 + (1.5 - 1) * exp(-0.2::DOUBLE * (value / 1000 - 50)), 1 / (1 - 1.5)), 6) AS richards FROM cells')
def _(cells):
    h = F.col("value") / 1000
    return cells.select("row", "col", r6(nuclide.snow_depth_linear(h, 5.0, 0.8, 60.0)).alias("linear"), r6(nuclide.snow_depth_richards(h, 0.2, 50.0, 70.0, 1.5)).alias("richards"))


@query("shielding_of_depth", "cells", sql='SELECT row AS "row", col, round(160.0 / d * (1 - exp(-d / 160.0)), 6) AS shielding FROM (SELECT row, col, 1 + value / 1000 AS d FROM cells)')
def _(cells):
    return cells.select("row", "col", r6(nuclide.shielding_of_depth(1 + F.col("value") / 1000)).alias("shielding"))


def _steady_sql(name: str, rate: str) -> str:
    terms = " + ".join(f"{s!r}::DOUBLE / ({rate} / {g}::DOUBLE + {nuclide.DECAY[name]!r}::DOUBLE)" for s, g in zip(nuclide.SHARES[name], nuclide.ATTENUATION, strict=True) if s)
    return f"{nuclide.PRODUCTION[name]}::DOUBLE * ({terms})"


@query("steady_concentrations", "samples", more="e AS (SELECT sample, CAST(conc AS DOUBLE) / 1e8 AS rate FROM samples)", sql="SELECT sample, " + ", ".join(f"round({_steady_sql(n, 'rate')}, 2) AS {n}" for n in nuclide.DECAY) + " FROM e")
def _(samples):
    return samples.select("sample", *[F.round(nuclide.steady_concentration(F.col("conc") / 1e8, n), 2).alias(n) for n in nuclide.DECAY])


_LAM = nuclide.DECAY["be10"]
_STEP = " + ".join(f"{s!r}::DOUBLE / (rate / {g}::DOUBLE + {_LAM!r}::DOUBLE) * (1 - exp(-(rate / {g}::DOUBLE + {_LAM!r}::DOUBLE) * years))" for s, g in zip(nuclide.SHARES["be10"], nuclide.ATTENUATION, strict=True) if s)


@query("step_concentration", "samples", more="e AS (SELECT sample, CAST(conc AS DOUBLE) AS before, CAST(conc AS DOUBLE) / 1e8 AS rate, 1000.0::DOUBLE * (1 + sample % 9) AS years FROM samples)", sql=f"SELECT sample, round(before * exp(-{_LAM!r}::DOUBLE * years) + {nuclide.PRODUCTION['be10']}::DOUBLE * ({_STEP}), 3) AS conc FROM e")
def _(samples):
    c = F.col("conc").cast("double")
    years = F.lit(1000.0) * (1 + F.col("sample") % 9)
    return samples.select("sample", F.round(nuclide.step_concentration(c, years, c / 1e8), 3).alias("conc"))


EROSION_SQL = f"""area_of AS (SELECT r.basin, c.value FROM rooted r JOIN cells c ON c.row = r.row AND c.col = r.col),
scaled AS (SELECT basin, {_STONE_SQL} AS scaling FROM (SELECT basin, 42.0::DOUBLE AS l, {_stone_sql('hpa')} AS t FROM (SELECT basin, 1013.25 * exp(-0.03417 / 0.0065 * (ln(288.15) - ln(288.15 - value / 40 * 0.0065))) AS hpa FROM area_of))),
mean_of AS (SELECT basin, avg(scaling) AS scaling, count(*) AS n_cells, CAST(200000 + basin % 1000 * 100 AS DOUBLE) AS conc FROM scaled GROUP BY 1),
newton(basin, conc, top, u, k) AS (SELECT basin, conc, 4.30::DOUBLE * scaling, ln(greatest(1e-12::DOUBLE, 160.0 * (4.30::DOUBLE * scaling / conc - 4.99e-7::DOUBLE))), 0 FROM mean_of
  UNION ALL SELECT basin, conc, top, u - greatest(-2, least(2, ({_F} - conc) / (({_DF}) * exp(u)))), k + 1 FROM newton WHERE k < 40)"""


@query("basin_erosion", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED + ",\n" + EROSION_SQL, sql="SELECT m.basin, m.n_cells, round(m.scaling, 6) AS scaling, round(exp(n.u), 9) AS erosion FROM mean_of m JOIN newton n ON n.basin = m.basin AND n.k = 40")
def _(cells):
    parts = rooted(cells).join(cells, ["row", "col"]).select("basin", nuclide.stone_scaling(F.lit(42.0), nuclide.pressure(F.col("value") / 40)).alias("scaling"))
    samples = parts.select("basin").distinct().withColumn("concentration", (F.lit(200000) + F.col("basin") % 1000 * 100).cast("double"))
    return nuclide.basin_erosion(parts, samples).select("basin", "n_cells", r6("scaling").alias("scaling"), F.round("erosion", 9).alias("erosion"))


@query("concentration_downstream", "cells", recursive=True, more=D8_WAYS + ",\nk AS (SELECT node, 1e5::DOUBLE / (1 + z / 10000) AS conc, z / 1e6 AS rate FROM nodes)", sql="SELECT w.ancestor AS node, round(sum(k.conc * k.rate) / sum(k.rate), 4) AS conc FROM ways w JOIN k ON k.node = w.node GROUP BY 1")
def _(cells):
    nodes = d8(cells)
    local = nodes.select("node", (F.lit(1e5) / (1 + F.col("z") / 10000)).alias("conc"), (F.col("z") / 1e6).alias("rate"))
    return nuclide.accumulated(nodes, local).select("node", F.round("conc", 4).alias("conc"))


def _inside_sql(corners: list[tuple[float, float]]) -> str:
    return "(" + " + ".join(f"CASE WHEN ({y1} > h) <> ({y2} > h) AND t < ({x2} - {x1}) * (h - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True) if y1 != y2) + ") % 2 = 1"


@query("vegetation_kinds", "cells", "cells2", sql='SELECT row AS "row", col, CASE ' + " ".join(f"WHEN {_inside_sql([(float(x), float(y)) for x, y in p])} THEN {k}" for k, p in enumerate((landforms.COVE, landforms.DECIDUOUS, landforms.XERIC, landforms.NORTHERN), 1)) + " END AS value FROM (SELECT a.row, a.col, a.value % 9973 AS t, 550 + b.value * 19 AS h FROM cells a JOIN cells2 b ON a.row = b.row AND a.col = b.col)")
def _(cells, cells2):
    return landforms.vegetation(cells.withColumn("value", F.col("value") % 9973), cells2.withColumn("value", 550 + F.col("value") * 19))


@query("landslide_areas", "cells", recursive=True, more=COMPONENT_SQL + ", c AS (SELECT row, col, min(label) AS component FROM reach GROUP BY 1, 2)", sql="SELECT c.component, count(*) AS n, min(v.value) AS low, max(v.value) AS high FROM c JOIN cells v ON v.row = c.row AND v.col = c.col GROUP BY 1 HAVING count(*) >= 3")
def _(cells):
    return landforms.landslides(cells.withColumn("value", F.when(F.col("value") > 56000, 0.5).otherwise(2.0)), cells, spec().ncols, 3)


@query("sediment_shares", "litho", "cells", more="s AS (SELECT l.litho, sum(c.value * (1 + l.litho * 0.5::DOUBLE)) * 4 AS flux FROM litho l JOIN cells c ON c.row = l.row AND c.col = l.col GROUP BY 1)", sql="SELECT litho, round(flux, 3) AS flux, round(flux / sum(flux) OVER (), 6) AS share FROM s")
def _(litho, cells):
    fertility = litho.select("litho").distinct().withColumn("fertility", 1 + F.col("litho") * 0.5)
    found = landforms.sediment_flux(litho, cells, fertility, 4.0)
    return found.select("litho", F.round("flux", 3).alias("flux"), r6("share").alias("share"))


# --- networks ---


@query("channel_length_upstream", "cells", recursive=True, more=CHANNEL_SQL, sql="SELECT w.ancestor AS node, round(sum(n.dx), 6) AS length FROM ways w JOIN channel n ON n.node = w.node JOIN channel a ON a.node = w.ancestor GROUP BY 1")
def _(cells):
    channel = channel_of(cells)[2]
    return rounded(flow.accumulate(channel, {"length": F.col("dx")}), "length")


@query("tokunaga_counts", "tree", more=ORDER_SQL, sql="SELECT a.stream_order AS i, b.stream_order AS j, count(*) AS n FROM orders_of a JOIN tree t ON t.node = a.node JOIN orders_of b ON b.node = t.receiver WHERE t.node <> t.receiver AND a.stream_order < b.stream_order GROUP BY 1, 2")
def _(tree):
    tree = flow.store(tree, "tree")
    return network.tokunaga(tree, network.strahler(tree))


@query("channel_lengths", "cells", recursive=True, more=KEYS_SQL, sql="SELECT p.source_key AS link, round(sum(n.dx), 6) AS length, count(*) AS n FROM pick p JOIN nodes n ON n.node = p.node WHERE p.place = 1 GROUP BY 1")
def _(cells):
    nodes, counts, channel = channel_of(cells)
    keys = network.source_keys(channel, flow.sources_by_area(nodes, counts, 3))
    return rounded(network.link_lengths(keys.join(nodes.select("node", "dx"), "node").withColumnRenamed("source_key", "link")), "length")


@query("channel_drops", "cells", recursive=True, more=KEYS_SQL + STRAHLER_SQL, sql='SELECT p.source_key AS link, round(max(n.z) - min(n.z), 6) AS "drop", max(s.stream_order) AS stream_order FROM pick p JOIN nodes n ON n.node = p.node JOIN strahler s ON s.node = p.node WHERE p.place = 1 GROUP BY 1')
def _(cells):
    nodes, counts, channel = channel_of(cells)
    keys = network.source_keys(channel, flow.sources_by_area(nodes, counts, 3)).withColumnRenamed("source_key", "link")
    return rounded(network.link_drops(network.strahler(channel), keys, nodes), "drop")


@query("junction_orders", "cells", recursive=True, more=CHANNEL_SQL + STRAHLER_SQL, sql="SELECT f.node AS junction, f.n_donors, s.stream_order FROM feeds f JOIN strahler s ON s.node = f.node WHERE f.n_donors <> 1 OR f.root")
def _(cells):
    channel = channel_of(cells)[2]
    return network.junctions(channel, network.strahler(channel))


NEXT_SQL = """,
knots AS (SELECT node, root FROM feeds WHERE n_donors <> 1 OR root),
ahead AS (SELECT a.node AS junction, w.ancestor AS receiver_junction, w.distance, row_number() OVER (PARTITION BY a.node ORDER BY w.steps) AS place FROM knots a JOIN ways w ON w.node = a.node JOIN knots b ON b.node = w.ancestor WHERE w.steps > 0 OR a.root)"""


@query("next_junctions", "cells", recursive=True, more=CHANNEL_SQL + NEXT_SQL, sql="SELECT junction, receiver_junction, round(distance, 6) AS distance FROM ahead WHERE place = 1")
def _(cells):
    channel = channel_of(cells)[2]
    return rounded(network.junction_receivers(channel, network.junctions(channel, network.strahler(channel))), "distance")


@query("next_order_junctions", "cells", recursive=True, more=CHANNEL_SQL + STRAHLER_SQL + ",\nup AS (SELECT w.node, w.ancestor, row_number() OVER (PARTITION BY w.node ORDER BY w.steps) AS place FROM ways w JOIN strahler a ON a.node = w.node JOIN strahler b ON b.node = w.ancestor WHERE b.stream_order > a.stream_order)", sql="SELECT node, ancestor AS next_node FROM up WHERE place = 1")
def _(cells):
    channel = channel_of(cells)[2]
    return network.next_order(channel, network.strahler(channel))


LINKS_SQL = CHANNEL_SQL + NEXT_SQL + """,
reach AS (SELECT a.junction AS link, a.receiver_junction AS "end", w.ancestor AS node, w.steps FROM ahead a JOIN ways e ON e.node = a.junction AND e.ancestor = a.receiver_junction JOIN ways w ON w.node = a.junction AND w.steps <= e.steps WHERE a.place = 1 AND a.junction <> a.receiver_junction),
placed AS (SELECT r.*, n.z, n.col + 0.5::DOUBLE AS x, -n.row - 0.5::DOUBLE AS y, CASE WHEN r.node <> r."end" THEN n.dx ELSE 0 END AS dx FROM reach r JOIN nodes n ON n.node = r.node),
sums AS (SELECT link, "end", count(*) AS n, sum(dx) AS length, arg_min(z, steps) - arg_max(z, steps) AS fall, arg_max(x, steps) - arg_min(x, steps) AS lx, arg_max(y, steps) - arg_min(y, steps) AS ly, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM placed GROUP BY 1, 2),
turned AS (SELECT *, atan2(2 * round(xy, 9), round(xx - yy, 9)) / 2 AS turn FROM sums),
links AS (SELECT *, cos(turn) * CASE WHEN cos(turn) * lx + sin(turn) * ly >= 0 THEN 1 ELSE -1 END AS ux, sin(turn) * CASE WHEN cos(turn) * lx + sin(turn) * ly >= 0 THEN 1 ELSE -1 END AS uy, CASE WHEN round(xx, 9) > 0 AND round(yy, 9) > 0 THEN xy * xy / (xx * yy) ELSE 1 END AS r2 FROM turned)"""


def links_of(cells):
    nodes, counts, channel = channel_of(cells)
    places = nodes.select("node", spec().x(F.col("col")).alias("x"), spec().y(F.col("row")).alias("y"), "z")
    return counts, channel, flow.store(network.links(channel, places), "reaches")


@query("link_bearings", "cells", recursive=True, more=LINKS_SQL, sql='SELECT link, "end", round(degrees(atan2(lx, ly)) - 360 * floor(degrees(atan2(lx, ly)) / 360), 6) AS bearing, round(fall / length, 6) AS gradient FROM links')
def _(cells):
    return rounded(network.link_bearings(links_of(cells)[2]), "bearing", "gradient")


@query("junction_angles_complete", "cells", recursive=True, more=LINKS_SQL + STRAHLER_SQL + """,
good AS (SELECT *, degrees(atan2(ux, uy)) AS down, degrees(atan2(-ux, -uy)) AS up FROM links WHERE n >= 2),
pairs AS (SELECT "end" AS junction, count(*) AS k, min(link) AS d1, max(link) AS d2 FROM links GROUP BY 1 HAVING count(*) = 2),
met AS (SELECT p.junction, p.d1, p.d2, r."end" AS receiver, round(a.up - r.down, 9) AS t1, round(b.up - r.down, 9) AS t2, a.r2 AS r2_1, b.r2 AS r2_2, r.r2 AS r2_r FROM pairs p JOIN good a ON a.link = p.d1 JOIN good b ON b.link = p.d2 JOIN good r ON r.link = p.junction),
spun AS (SELECT * REPLACE (t1 - 360 * floor(t1 / 360) AS t1, t2 - 360 * floor(t2 / 360) AS t2) FROM met)""", sql="""SELECT s.junction, s.d1, s.d2, s.receiver, round(abs(t2 - t1), 4) AS angle_12, round(CASE WHEN t2 > t1 THEN t1 ELSE 360 - t1 END, 4) AS angle_1r, round(CASE WHEN t2 > t1 THEN 360 - t2 ELSE t2 END, 4) AS angle_2r,
  oj.stream_order AS order_j, o1.stream_order AS order_1, o2.stream_order AS order_2, o3.stream_order AS order_r, c1.n_contrib AS area_1, c2.n_contrib AS area_2, c3.n_contrib AS area_r, round(r2_1, 6) AS r2_1, round(r2_2, 6) AS r2_2, round(r2_r, 6) AS r2_r
  FROM spun s JOIN strahler oj ON oj.node = s.junction JOIN strahler o1 ON o1.node = s.d1 JOIN strahler o2 ON o2.node = s.d2 JOIN strahler o3 ON o3.node = s.receiver JOIN counts c1 ON c1.node = s.d1 JOIN counts c2 ON c2.node = s.d2 JOIN counts c3 ON c3.node = s.receiver""")
def _(cells):
    counts, channel, found = links_of(cells)
    out = network.junction_angles_complete(found, network.strahler(channel), counts.withColumnRenamed("n_contrib", "area"), 2)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("angle_12", "angle_1r", "angle_2r")}), "r2_1", "r2_2", "r2_r")


@query("move_heads_up", "cells", recursive=True, more=D8_WAYS + ",\nfar AS (SELECT w.ancestor AS node, w.node AS top, row_number() OVER (PARTITION BY w.ancestor ORDER BY round(w.distance, 9) DESC, w.node) AS place FROM ways w), moved AS (SELECT f.node, w.ancestor AS moved, row_number() OVER (PARTITION BY f.node ORDER BY w.steps) AS first FROM far f JOIN ways w ON w.node = f.top JOIN ways v ON v.node = w.ancestor AND v.ancestor = f.node WHERE f.place = 1 AND v.distance <= 2.5)", sql="SELECT node, moved FROM moved WHERE first = 1")
def _(cells):
    from catena.operators import routing

    nodes = d8(cells)
    return routing.move_heads_up(nodes, nodes.select("node"), 2.5)


@query("prune_edge", "cells", recursive=True, more=OUTS + f",\nrim AS (SELECT c.node FROM grid c JOIN {STEPS_SQL} ON true LEFT JOIN cells n ON n.row = c.row + k.dr AND n.col = c.col + k.dc GROUP BY 1 HAVING count(n.row) < 8), touched AS (SELECT DISTINCT w.ancestor AS node FROM ways w JOIN rim ON rim.node = w.node)", sql="SELECT node FROM outs WHERE node NOT IN (SELECT node FROM touched)")
def _(cells):
    nodes, _counts, outlets = outlets_of(cells)
    return network.prune_edge(nodes, outlets, flow.edge_influenced(nodes, cells, spec()))


@query("union_of_basins", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED, sql='SELECT row AS "row", col, 1 AS value FROM rooted WHERE basin % 3 IN (0, 1)')
def _(cells):
    members = rooted(cells)
    one, two = (members.where(F.col("basin") % 3 == k).select("row", "col", F.lit(1).alias("value")) for k in (0, 1))
    return algebra.union_of(one, two)


@query("nodes_not_in_list", "cells", recursive=True, more=CHANNEL_SQL, sql="SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM channel)")
def _(cells):
    nodes, _counts, channel = channel_of(cells)
    return nodes.select("node").join(channel.select("node"), "node", "left_anti")


@query("points_mean_in_basins", "cells", "points", recursive=True, more=D8_WAYS + ",\n" + ROOTED + ",\n" + SPOTS_SQL, sql="SELECT r.basin, round(avg(p.value) + 1e-6::DOUBLE, 4) AS mean, count(*) AS n FROM spots p JOIN rooted r ON r.row = p.r0 AND r.col = p.c0 GROUP BY 1")
def _(cells, points):
    found = joins.in_cells(points, spec()).join(rooted(cells), ["row", "col"]).groupBy("basin")
    return found.agg(F.round(F.avg("value") + 1e-6, 4).alias("mean"), F.count("*").alias("n"))


@query("reaches", "profile", sql="SELECT node, dense_rank() OVER (ORDER BY source_key, floor(pos / 7.0)) AS reach FROM profile")
def _(profile_):
    return landforms.split_channels(profile_.withColumn("flow_distance", F.col("pos").cast("double")), 7.0).select("node", F.col("reach").cast("long").alias("reach"))


@query("swath_across", "points", sql="SELECT id, round(sqrt(dx * dx + dy * dy) * CASE WHEN (y - 10) * 0.6 - (x - 5) * 0.8 >= 0 THEN 1 ELSE -1 END, 6) AS across FROM (SELECT id, x, y, x - 5 - t * 0.6 AS dx, y - 10 - t * 0.8 AS dy FROM (SELECT *, greatest(0.0::DOUBLE, least(50.0::DOUBLE, (x - 5) * 0.6 + (y - 10) * 0.8)) AS t FROM points))")
def _(points):
    return rounded(landforms.swath_coordinates(points, [(5.0, 10.0), (35.0, 50.0)]).select("id", "across"), "across")


@query("hilltop_curvature", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED + ",\n" + _fit_sql(2) + f",\nedge AS (SELECT DISTINCT b.row, b.col FROM rooted b JOIN {STEPS_SQL} ON true JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc WHERE n.basin <> b.basin)", sql='SELECT e.row AS "row", e.col, round(2 * f.a + 2 * f.b + 1e-6::DOUBLE, 4) AS curvature FROM edge e JOIN fit f ON f.row = e.row AND f.col = e.col WHERE 2 * f.a + 2 * f.b < 0')
def _(cells):
    ridge = landforms.ridges(cells, rooted(cells)).select("row", "col").distinct()
    found = landforms.hilltop_curvature(ridge, focal.polynomial_surface(cells, 2, partial=False).where("curvature IS NOT NULL"))
    return found.withColumn("curvature", F.round(F.col("curvature") + 1e-6, 4))


@query("curvature_heads", "cells", recursive=True, more=D8_WAYS + ",\n" + _fit_sql(2) + """,
curved AS (SELECT row, col, CASE WHEN e * e + f * f > 0 THEN (2 * a * f * f - 2 * d * e * f + 2 * b * e * e) / ((e * e + f * f) * sqrt(1 + e * e + f * f)) ELSE 0 END AS t FROM fit),
marks AS (SELECT n.node FROM curved c JOIN nodes n ON n.row = c.row AND n.col = c.col WHERE c.t > 1.2::DOUBLE * (SELECT stddev_pop(t) FROM curved))""", sql="SELECT m.node FROM marks m JOIN ways w ON w.ancestor = m.node JOIN marks u ON u.node = w.node GROUP BY m.node HAVING count(*) = 1")
def _(cells):
    return landforms.curvature_heads(cells, d8(cells), 2, times=1.2)


@query("d_infinity_watershed", "cells", recursive=True, more=INFINITE_SQL + """,
lowest AS (SELECT arg_min(row, (value, row, col)) AS row, arg_min(col, (value, row, col)) AS col FROM cells),
up(row, col) AS (SELECT row, col FROM lowest UNION SELECT w.row, w.col FROM up u JOIN weighed w ON w.to_row = u.row AND w.to_col = u.col)""", sql='SELECT row AS "row", col FROM up')
def _(cells):
    from catena.operators import routing

    outlet = cells.orderBy("value", "row", "col").limit(1)
    return routing.watershed(routing.infinity_edges(cells), outlet)


@query("gentle_hilltops", "cells", recursive=True, more=D8_WAYS + ",\n" + ROOTED + ",\n" + SLOPES + f",\nedge AS (SELECT DISTINCT b.row, b.col, b.basin FROM rooted b JOIN {STEPS_SQL} ON true JOIN rooted n ON n.row = b.row + k.dr AND n.col = b.col + k.dc WHERE n.basin <> b.basin)", sql='SELECT e.row AS "row", e.col, e.basin FROM edge e JOIN nodes n ON n.row = e.row AND n.col = e.col JOIN slopes s ON s.node = n.node WHERE s.slope < 12000')
def _(cells):
    nodes = d8(cells)
    return landforms.hilltops(landforms.ridges(cells, rooted(cells)), flow.d8_slope(nodes), 12000.0).select("row", "col", "basin")


# --- concavity ---


@query("collinearity_points", "profile", more="pts0 AS (SELECT source_key, source_key % 10 AS basin_key, CAST(pos AS DOUBLE) AS chi, elevation, source_key < 10 AS reference FROM profile),\nspan0 AS (SELECT basin_key, source_key, min(chi) AS lo, max(chi) AS hi FROM pts0 WHERE NOT reference GROUP BY 1, 2),\nasked AS (SELECT basin_key, source_key, lo + o.o AS chi FROM span0, (VALUES (2.5::DOUBLE), (10.25::DOUBLE), (20.5::DOUBLE)) o(o) WHERE lo + o.o <= hi),\nlower_ends AS (SELECT a.*, n.chi AS xa, n.elevation AS ya FROM asked a ASOF JOIN (SELECT * FROM pts0 WHERE NOT reference) n ON a.basin_key = n.basin_key AND a.source_key = n.source_key AND a.chi >= n.chi),\nat_points AS (SELECT l.*, n.chi AS xb, n.elevation AS yb FROM lower_ends l ASOF JOIN (SELECT * FROM pts0 WHERE NOT reference) n ON l.basin_key = n.basin_key AND l.source_key = n.source_key AND l.chi <= n.chi),\npts AS (SELECT source_key, basin_key, chi, elevation, reference FROM pts0 WHERE reference UNION ALL SELECT source_key, basin_key, chi, CASE WHEN xa = xb THEN ya ELSE ya + (chi - xa) / (xb - xa) * (yb - ya) END, false FROM at_points),\n" + _collinear_sql("basin_key"), sql="SELECT basin_key, source_key, round(exp(-sum(r * r) / 200), 6) AS mle, round(avg(abs(r)), 5) AS mae, round(sqrt(avg(r * r)), 5) AS rmse, count(*) AS n FROM resid GROUP BY 1, 2")
def _(profile_):
    p = profile_.withColumns({"chi": F.col("pos").cast("double"), "basin_key": F.col("source_key") % 10})
    found = profile.collinearity_points(p, F.col("source_key") < 10, [2.5, 10.25, 20.5])
    return found.withColumns({"mle": r6("mle"), "mae": F.round("mae", 5), "rmse": F.round("rmse", 5)})


@query("collinearity_sampled", "profile", more="pts AS (SELECT p.source_key, p.source_key % 10 AS basin_key, r.round, CAST(p.pos AS DOUBLE) AS chi, p.elevation, p.source_key < 10 AS reference FROM profile p, (SELECT unnest(range(1, 5)) AS round) r WHERE p.source_key < 10 OR CAST(('0x' || substr(md5('1:' || r.round || ':' || p.node), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 < 0.5),\n" + _collinear_sql("basin_key, round"), sql='SELECT basin_key, CAST(round AS INT) AS "round", round(exp(-sum(r * r) / 2e8), 6) AS mle, round(avg(abs(r)) + 1e-7::DOUBLE, 5) AS mae, count(*) AS n FROM resid GROUP BY 1, 2')
def _(profile_):
    p = profile_.withColumns({"chi": F.col("pos").cast("double"), "basin_key": F.col("source_key") % 10})
    found = profile.collinearity_sampled(p, F.col("source_key") < 10, "node", 4, sigma=10000.0)
    return found.select("basin_key", F.col("round").cast("int").alias("round"), r6("mle").alias("mle"), F.round(F.col("mae") + 1e-7, 5).alias("mae"), "n")


@query("disorder_discharge", "profile", more=_theta_sql("(1 + n - pos) * (0.5 + source_key % 4)").partition(",\nref AS")[0] + ",\ns AS (SELECT *, abs(chi - lag(chi) OVER (PARTITION BY basin_key, theta ORDER BY elevation, chi)) AS d FROM pts)", sql="SELECT basin_key, theta, round((coalesce(sum(d), 0) - (max(chi) - min(chi))) / CASE WHEN max(chi) > min(chi) THEN max(chi) - min(chi) END, 4) AS disorder, count(*) AS n FROM s GROUP BY 1, 2")
def _(profile_):
    area = (F.lit(1.0) + F.count("*").over(Window.partitionBy("source_key")) - F.col("pos")) * (0.5 + F.col("source_key") % 4)
    p = profile_.withColumns({"area": area, "dx": F.lit(1.0), "basin_key": F.col("source_key") % 10})
    return profile.disorder_over(p, [0.3, 0.5], "area", "dx", ["basin_key"]).withColumn("disorder", F.round("disorder", 4))


@query("steepness_window", "profile", sql="SELECT node, round(avg(elevation) OVER (PARTITION BY source_key ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM profile")
def _(profile_):
    return rounded(profile.smooth(profile_, "elevation", 3).select("node", "smoothed"), "smoothed")


# --- files: written to the shared folder and read back ---


def _file(name: str) -> str:
    """A fresh place for one file below the shared folder, as a path of this machine."""
    import os
    import uuid

    from pyspark.sql import SparkSession

    place = f"{folder(SparkSession.getActiveSession()).removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex[:12]}"
    os.makedirs(place, exist_ok=True)
    return f"{place}/{name}"


for _kind, _type, _sql in (("asc", "f4", "value"), ("flt", "f4", "CAST(CAST(value AS FLOAT) AS DOUBLE)"), ("bil", "f8", "value")):

    @query(f"grid_file_{_kind}", "cells", sql=f'SELECT row AS "row", col, {_sql} AS value FROM cells')
    def _(cells, kind=_kind, dtype=_type):
        path = _file(f"dem.{kind}")
        grids.write_grid(cells, GridSpec(spec().nrows, spec().ncols, 100.0, 200.0, 2.0), path, dtype)
        grids.register(cells.sparkSession)
        return cells.sparkSession.read.format("grid").load(path).where("value IS NOT NULL")


@query("grid_file_integers", "cells", sql='SELECT row AS "row", col, CAST(floor(value) AS BIGINT) AS value FROM cells')
def _(cells):
    path = _file("dem.bil")
    grids.write_grid(cells.withColumn("value", F.floor("value")), spec(), path, "i4")
    grids.register(cells.sparkSession)
    return cells.sparkSession.read.format("grid").load(path).where("value IS NOT NULL")


@query("grid_file_header", "cells", sql="SELECT size.n AS nrows, size.n + 1 AS ncols, 100.0::DOUBLE AS xmin, 200.0::DOUBLE AS ymin, 2.0::DOUBLE AS res FROM size")
def _(cells):
    path = _file("dem.flt")
    grids.write_grid(cells, GridSpec(spec().nrows, spec().ncols + 1, 100.0, 200.0, 2.0), path)
    s = grids.read_layout(path).spec
    return cells.sparkSession.createDataFrame([(s.nrows, s.ncols, s.xmin, s.ymin, s.res)], "nrows int, ncols int, xmin double, ymin double, res double")


@query("points_csv", "samples", sql="SELECT CAST(sample AS VARCHAR) AS sample, latitude, longitude, CAST(conc AS VARCHAR) AS conc FROM samples")
def _(samples):
    path = f"file://{_file('points.csv')}"
    tables.write_csv(samples, path)
    return tables.read_points(samples.sparkSession, path)


@query("points_geojson", "samples", sql="""SELECT '{"type":"Feature","properties":{"sample":' || sample || ',"conc":' || conc || '},"geometry":{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']}}' AS value FROM samples""")
def _(samples):
    path = f"file://{_file('points.geojson')}"
    tables.write_geojson(tables.point_features(samples.select("sample", "conc", "latitude", "longitude")), path)
    return samples.sparkSession.read.text(path)


@query("lines_geojson", "samples", sql="""SELECT '{"type":"Feature","properties":{"line":' || line || '},"geometry":{"type":"LineString","coordinates":[' || string_agg('[' || longitude || ',' || latitude || ']', ',' ORDER BY sample) || ']}}' AS value FROM (SELECT *, sample % 4 AS line FROM samples) GROUP BY line""")
def _(samples):
    path = f"file://{_file('lines.geojson')}"
    tables.write_geojson(tables.line_features(samples.withColumn("line", F.col("sample") % 4), "line", "sample"), path)
    return samples.sparkSession.read.text(path)


@query("channel_heads_csv", "cells", recursive=True, more=CHANNEL_SQL, sql="SELECT node FROM feeds WHERE n_donors = 0")
def _(cells):
    nodes, counts, _channel = channel_of(cells)
    path = f"file://{_file('heads.csv')}"
    tables.write_csv(flow.sources_by_area(nodes, counts, 3), path)
    return tables.read_channel_heads(cells.sparkSession, path)


@query("flat_csv", "cells", sql="SELECT col + 0.5::DOUBLE AS x, size.n - row - 0.5::DOUBLE AS y, value FROM cells, size")
def _(cells):
    path = f"file://{_file('flat.csv')}"
    tables.write_csv(tables.flatten(cells, spec()), path)
    return tables.read_points(cells.sparkSession, path).select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "value")])


@query("network_csv", "cells", recursive=True, more=CHANNEL_SQL + STRAHLER_SQL, sql="SELECT c.node, c.row AS \"row\", c.col, c.receiver, c.z, s.stream_order, c.col + 0.5::DOUBLE AS x, size.n - c.row - 0.5::DOUBLE AS y, k.n_contrib FROM channel c JOIN strahler s ON s.node = c.node JOIN counts k ON k.node = c.node, size")
def _(cells):
    _nodes, counts, channel = channel_of(cells)
    path = f"file://{_file('network.csv')}"
    tables.write_csv(tables.network_table(channel, network.strahler(channel), spec(), counts), path)
    kinds = {"node": "long", "row": "int", "col": "int", "receiver": "long", "z": "double", "stream_order": "int", "x": "double", "y": "double", "n_contrib": "long"}
    return tables.read_points(cells.sparkSession, path).select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


@query("rainfall_series", "profile", sql="SELECT CAST(pos AS BIGINT) AS hour, round(elevation, 2) AS rain FROM profile WHERE source_key = 1")
def _(profile_):
    path = f"file://{_file('rain.csv')}"
    profile_.where("source_key = 1").select("pos", "elevation").write.csv(path)
    return tables.read_series(profile_.sparkSession, path, "hour long, rain double").withColumn("rain", F.round("rain", 2))


# --- streams, as a table ---


@query("windowed_events", "raw_events", sql="SELECT user_id AS source_key, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1, 2")
def _(events):
    from catena.streaming.events import windowed

    return rounded(windowed(events), "mean")

