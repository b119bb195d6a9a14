"""Grids with known answers, and properties that hold for any grid."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catena.functions import columns, geo, nuclide
from catena.grid import GridSpec
from catena.operators import flow, focal, kernels, landforms, morphology, network, routing
from catena.plans import analyses, params
from catena.sources import clouds, grids, shapes, surfaces, tables

SPEC = GridSpec(12, 10)


def frame(spark, z):
    r, c = np.indices(z.shape)
    df = pd.DataFrame({"row": r.ravel().astype("int32"), "col": c.ravel().astype("int32"), "value": z.ravel().astype(float)})
    return spark.createDataFrame(df[~df["value"].isna()], "row int, col int, value double")


def array(df, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", column).collect():
        out[r[0], r[1]] = r[2] if r[2] is not None else np.nan
    return out


def test_plane_slope_and_aspect(spark):
    s = array(focal.polynomial_surface(surfaces.plane(spark, SPEC, 0.3, 0.4), 2), (12, 10), "slope")
    assert np.allclose(s, 0.5)
    a = array(focal.polynomial_surface(surfaces.plane(spark, SPEC, 0.0, 1.0), 2), (12, 10), "aspect")
    assert np.allclose(a, 180)  # falls to the south


def test_paraboloid_curvature(spark):
    z = surfaces.grid_of(spark, SPEC, F.col("x") * F.col("x") * 0.5 + F.col("y") * F.col("y") * 0.25)
    c = array(focal.polynomial_surface(z, 2), (12, 10), "curvature")
    assert np.allclose(c[2:-2, 2:-2], 1.5)


def test_tiles_do_not_show(spark):
    z = surfaces.noise(spark, GridSpec(20, 20), seed=3)
    kernel = lambda a: {"value": np.nanmean(np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, constant_values=np.nan), (3, 3)), axis=(-1, -2))}
    small, large = (array(focal.on_tiles(z, 1, kernel, ["value"], tile=t), (20, 20)) for t in (6, 64))
    assert np.allclose(small, large)


def test_valley_drains_to_its_outlet(spark):
    z = surfaces.grid_of(spark, SPEC, F.abs(F.col("col") - 4) * 2.0 + (11 - F.col("row")) * 0.1)
    nodes = flow.d8(z, SPEC)
    count = {r["node"]: r["n_contrib"] for r in flow.contributing(nodes).collect()}
    assert count[11 * 10 + 4] == 120
    roots = flow.base_level(nodes).collect()
    assert sum(count[r["node"]] for r in roots) == 120


def test_accumulation_on_a_long_chain(spark):
    n = 1000
    nodes = spark.range(n).select(F.col("id").alias("node"), F.greatest(F.col("id") - 1, F.lit(0)).alias("receiver"), F.when(F.col("id") > 0, 1.5).otherwise(0.0).alias("dx"))
    nodes = flow.store(nodes, "chain")
    assert {r["node"]: r["n_contrib"] for r in flow.contributing(nodes).collect()} == {i: n - i for i in range(n)}
    assert all(r["depth"] == r["node"] and r["distance"] == 1.5 * r["node"] for r in flow.distance_from_outlet(nodes).collect())


def priority_flood(z, drop):
    import heapq

    out, seen, heap = z.copy(), np.zeros(z.shape, bool), []
    for i, j in np.ndindex(z.shape):
        if i in (0, z.shape[0] - 1) or j in (0, z.shape[1] - 1):
            heapq.heappush(heap, (z[i, j], i, j))
            seen[i, j] = True
    while heap:
        v, i, j = heapq.heappop(heap)
        for a in range(max(0, i - 1), min(z.shape[0], i + 2)):
            for b in range(max(0, j - 1), min(z.shape[1], j + 2)):
                if not seen[a, b]:
                    seen[a, b] = True
                    out[a, b] = max(z[a, b], v + drop)
                    heapq.heappush(heap, (out[a, b], a, b))
    return out


def test_fill_equals_priority_flood(spark):
    z = np.random.default_rng(2).uniform(0, 10, (12, 10))
    got = array(flow.fill(frame(spark, z), 0.01, tile=5), z.shape)
    assert np.allclose(got, priority_flood(z, 0.01))
    roots = flow.base_level(flow.d8(frame(spark, got), SPEC)).collect()
    assert all(r["row"] in (0, 11) or r["col"] in (0, 9) for r in roots)


def test_multiple_flow_keeps_water(spark):
    z = surfaces.plane(spark, SPEC, 0.3, 0.7)
    area = array(flow.multiple_flow(z, SPEC), (12, 10), "area")
    assert np.isclose(area[-1, 0], 120) and area.min() == 1


def test_d_infinity_on_a_plane(spark):
    a = array(flow.d_infinity(surfaces.plane(spark, SPEC, -1.0, 0.0)), (12, 10), "angle")
    assert np.allclose(a[1:-1, 1:-1], 0)  # falls to the east


def strahler_plain(receiver):
    donors = {n: [d for d, r in receiver.items() if r == n and d != n] for n in receiver}

    def order(n):
        o = sorted((order(d) for d in donors[n]), reverse=True)
        return 1 if not o else o[0] + (len(o) > 1 and o[0] == o[1])

    return {n: order(n) for n in receiver}


def test_strahler_on_a_random_tree(spark):
    rng = np.random.default_rng(5)
    receiver = {0: 0} | {i: int(rng.integers(max(0, i - 6), i)) for i in range(1, 120)}
    nodes = spark.createDataFrame([(n, r, float(n != r)) for n, r in receiver.items()], "node long, receiver long, dx double")
    assert {r["node"]: r["stream_order"] for r in network.strahler(nodes).collect()} == strahler_plain(receiver)


def test_components_are_invariant_under_transpose(spark):
    z = np.where(np.random.default_rng(4).random((12, 10)) < 0.45, 1.0, np.nan)
    a = array(morphology.components(frame(spark, z), 10), z.shape, "component")
    b = array(morphology.components(frame(spark, z.T), 12, tile=4), z.T.shape, "component").T
    pairs = {(x, y) for x, y in zip(a[~np.isnan(a)], b[~np.isnan(b)], strict=True)}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_thinning_leaves_a_line(spark):
    z = np.full((9, 12), np.nan)
    z[3:6, 1:11] = 1
    kept = array(morphology.thin(frame(spark, z)), z.shape)
    assert np.nansum(kept) <= 10 and (np.nansum(kept, axis=0) <= 1).all()
    small = array(morphology.thin(frame(spark, z), tile=5, passes=1), z.shape)
    assert np.array_equal(np.nan_to_num(kept), np.nan_to_num(small))


def objective(x, y, lam):
    return 0.5 * ((x - y) ** 2).sum() + lam * np.abs(np.diff(x)).sum()


def test_total_variation_is_optimal():
    rng = np.random.default_rng(1)
    for n, lam in ((1, 1.0), (2, 0.3), (30, 0.7), (80, 3.0)):
        y = rng.normal(size=n).cumsum()
        x = kernels.total_variation(y, lam)
        best = objective(x, y, lam)
        assert all(best <= objective(x + rng.normal(scale=s, size=n), y, lam) + 1e-9 for s in (1e-3, 1e-2, 1e-1) for _ in range(50))
        # The residual's running sum stays in the tube, which with its ends characterises the minimum.
        u = np.cumsum(y - x)
        assert np.abs(u).max() <= lam + 1e-9 and abs(u[-1]) < 1e-9


def test_segments_find_the_break():
    x = np.arange(60.0)
    y = np.where(x < 25, 2 * x, 50 + 0.5 * (x - 25))
    found = kernels.best_segments(x, y, 0.1, 5, 5)
    assert [(a, b) for a, b, *_ in found] in ([(0, 25), (25, 60)], [(0, 26), (26, 60)])


def test_utm_round_trip(spark):
    rows = [(float(lat), float(lon)) for lat in range(-78, 84, 9) for lon in range(-179, 180, 23)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    e, n = geo.to_utm(F.col("lat"), F.col("lon"))
    df = df.withColumns({"e": e, "n": n, "zone": geo.utm_zone(F.col("lon"))})
    lat, lon = geo.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    assert all(abs(r["a"] - r["lat"]) < 1e-5 and abs(r["b"] - r["lon"]) < 1e-5 for r in df.withColumns({"a": lat, "b": lon}).collect())


@pytest.mark.parametrize("there, back", [(geo.albers, geo.albers_inverse), (geo.lambert, geo.lambert_inverse)])
def test_conic_round_trips(spark, there, back):
    df = spark.createDataFrame([(30.0, -100.0), (45.0, -80.0), (52.3, -111.1)], "lat double, lon double")
    x, y = there(F.col("lat"), F.col("lon"), 29.5, 45.5, 23.0, -96.0)
    df = df.withColumns({"x": x, "y": y})
    lat, lon = back(F.col("x"), F.col("y"), 29.5, 45.5, 23.0, -96.0)
    assert all(abs(r["a"] - r["lat"]) < 1e-9 and abs(r["b"] - r["lon"]) < 1e-9 for r in df.withColumns({"a": lat, "b": lon}).collect())


def test_geocentric_round_trip(spark):
    df = spark.createDataFrame([(51.5, -0.1, 30.0), (-33.9, 151.2, 800.0)], "lat double, lon double, h double")
    x, y, z = geo.to_geocentric(F.col("lat"), F.col("lon"), F.col("h"))
    df = df.withColumns({"x": x, "y": y, "z": z})
    a, b, c = geo.from_geocentric(F.col("x"), F.col("y"), F.col("z"))
    assert all(abs(r["a"] - r["lat"]) < 1e-9 and abs(r["c"] - r["h"]) < 1e-5 for r in df.withColumns({"a": a, "b": b, "c": c}).collect())


def test_erosion_inverts_concentration(spark):
    df = spark.createDataFrame([(1e-3,), (1e-2,), (0.3,)], "e double").withColumns({"scaling": F.lit(2.5)})
    df = df.withColumn("n", nuclide.steady_concentration(F.col("e"), "be10", F.col("scaling")))
    assert all(abs(r["erosion"] / r["e"] - 1) < 1e-6 for r in nuclide.apparent_erosion(df, "n", "scaling").collect())


def test_scaling_at_sea_level(spark):
    s = spark.range(1).select(nuclide.stone_scaling(F.lit(70.0), F.lit(1013.25))).head()[0]
    assert abs(s - 1) < 0.02


@pytest.mark.parametrize("kind", ["asc", "flt", "bil"])
def test_grid_files_round_trip(spark, tmp_path, kind):
    z = np.round(np.random.default_rng(3).uniform(0, 99, (7, 5)), 1)
    z[2, 3] = np.nan
    spec = GridSpec(7, 5, 100.0, 200.0, 2.0)
    path = str(tmp_path / f"dem.{kind}")
    grids.write_grid(frame(spark, z), spec, path)
    found = grids.read_layout(path).spec
    assert found.same_place(spec) and found.nodata == spec.nodata
    grids.register(spark)
    assert np.allclose(array(spark.read.format("grid").load(path), z.shape), z, equal_nan=True, atol=1e-4)


def test_points_csv_and_geojson(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id, Lat ,Lon\na b,1.5,190\nc,-2,3\n")
    df = tables.read_points(spark, str(tmp_path / "p.csv"))
    assert [(r["id"], r["latitude"]) for r in df.orderBy("latitude").collect()] == [("c", -2.0), ("ab", 1.5)]
    text = [r[0] for r in tables.point_features(df).collect()]
    assert any('"coordinates":[-170.0,1.5]' in t for t in text)


def test_shapefile_points(spark, tmp_path):
    import struct

    body = struct.pack("<i2d", 1, 3.5, 4.5)
    data = struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body
    (tmp_path / "p.shp").write_bytes(data)
    shapes.register(spark)
    r = spark.read.format("shapes").load(str(tmp_path / "p.shp")).head()
    assert (r["shape"], r["x"], r["y"]) == (1, 3.5, 4.5)


def test_parameter_files():
    raw = params.parse("# head\nRemove_Seas: true\nradius: 7 # cells\nnames: a, b\nunknown: 1\nempty:\n")
    assert params.typed(raw, {"remove_seas": False, "radius": 3, "names": ["x"], "empty": 2.5}) == {"remove_seas": True, "radius": 7, "names": ["a", "b"], "empty": 2.5}


def test_drainage_analysis(spark):
    z = surfaces.noise(spark, SPEC, 0, 10, 9)
    parts = analyses.drainage(z, SPEC, {"threshold_contributing_pixels": 4})
    assert parts["basins"].count() <= 120 and parts["order"].agg(F.max("stream_order")).head()[0] >= 1
    chi = {r["node"]: r["chi"] for r in parts["chi"].collect()}
    assert all(chi[r["node"]] >= chi[r["receiver"]] for r in parts["nodes"].collect())


def test_steady_profile_slope(spark):
    nodes = flow.d8(surfaces.plane(spark, SPEC, 0.0, 1.0), SPEC)
    counts = flow.contributing(nodes)
    z = {r["node"]: r["z"] for r in surfaces.steady_profile(nodes, counts, 1e-3, 1e-3).collect()}
    assert math.isclose(z[10 * 10 + 3] - z[11 * 10 + 3], 1 / math.sqrt(11), rel_tol=1e-9)


def test_british_grid(spark):
    # The worked example of the projection's guide is 651409.903, 313177.270 at 52 39 27.2531 N, 1 43 4.5177 E on the old datum.
    df = spark.createDataFrame([(651409.903, 313177.270)], "e double, n double")
    r = df.select(geo.from_british_grid(F.col("e"), F.col("n")).alias("p")).select("p.*").head()
    assert abs(r["lat"] - 52.65798) < 2e-4 and abs(r["lon"] - 1.71605) < 3e-4


def test_breaching_leaves_no_pits(spark):
    z = np.random.default_rng(8).uniform(0, 10, (12, 10))
    got = array(routing.breach(frame(spark, z), 12, 10, 0.001), z.shape)
    assert (got <= z + 1e-12).all()
    roots = flow.base_level(flow.d8(frame(spark, got), SPEC)).collect()
    assert all(r["row"] in (0, 11) or r["col"] in (0, 9) for r in roots)


def test_facet_flow_keeps_water(spark):
    z = surfaces.plane(spark, SPEC, 0.3, 0.7)
    edges = routing.infinity_edges(z)
    total = edges.groupBy("row", "col").agg(F.sum("w").alias("w"))
    assert all(abs(r["w"] - 1) < 1e-9 for r in total.collect())
    assert array(routing.spread_flow(z, edges), (12, 10), "area").min() >= 1


def test_las_points(spark, tmp_path):
    import struct

    head = bytearray(227)
    head[:4] = b"LASF"
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<HI", head, 105, 20, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.1, 1000.0, 0.0, 0.0)
    points = b"".join(struct.pack("<3i", x, y, z) + bytes([0, 0, 0, c]) + bytes(4) for x, y, z, c in [(100, 200, 30, 2), (150, 250, 70, 5)])
    (tmp_path / "p.las").write_bytes(bytes(head) + points)
    clouds.register(spark)
    df = spark.read.format("las").load(str(tmp_path / "p.las"))
    assert sorted((r["x"], r["z"], r["class"]) for r in df.collect()) == [(1001.0, 3.0, 2), (1001.5, 7.0, 5)]
    assert clouds.ground(df).count() == 1 and clouds.to_cells(df, GridSpec(5, 5, 1000.0, 0.0)).count() == 1


def test_rain_lowers_safety(spark):
    df = spark.createDataFrame([(1, 0.6, 2.0, 5e-6, 5e-7, 4000.0, 0.6)], "site int, slope double, table double, diffusivity double, conductivity double, cohesion double, friction double")
    rows = columns.lowest_safety(df, [(5e-7, 86400.0)], [0.0, 3 * 86400.0, 1000 * 86400.0], [0.5, 1.0, 1.5, 2.0]).orderBy("time").collect()
    assert rows[1]["safety"] < rows[0]["safety"] and rows[2]["safety"] > rows[1]["safety"]


def test_main_stem_and_tributaries(spark):
    # 0 <- 1 <- 2 <- 3 <- 4, with 5 -> 2 and 6 -> 1.
    receiver = {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 2, 6: 1}
    nodes = flow.store(spark.createDataFrame([(n, r, float(n != r)) for n, r in receiver.items()], "node long, receiver long, dx double"), "tree")
    stem = flow.store(landforms.main_stem(nodes, nodes.where("node = 0").select("node")), "stem")
    assert [r["node"] for r in stem.orderBy("step").collect()] == [4, 3, 2, 1, 0]
    assert {(r["node"], r["junction"]) for r in landforms.tributaries(nodes, stem).collect()} == {(5, 2), (6, 1)}


def test_scaling_models_agree_at_sea_level(spark):
    r = spark.range(1).select(nuclide.dunai_scaling(F.lit(1013.25), F.lit(0.0)).alias("a"), nuclide.desilets_scaling(F.lit(1013.25), F.lit(0.0)).alias("b"), nuclide.lifton_scaling(F.lit(1013.25), F.lit(0.0)).alias("c")).head()
    assert all(0.9 < x < 1.1 for x in r)
