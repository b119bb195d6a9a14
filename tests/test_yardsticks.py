"""Queries that SQL can't express against plain versions over the same cells and channels."""

import heapq
import math
from collections import defaultdict
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from catena.adapters import adapter, grid_size
from catena.operators import kernels, routing
from catena.queries import QUERIES

STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


@pytest.fixture(scope="module")
def z(spark, sf_dir):
    n = grid_size(spark, sf_dir)
    out = np.full((n, n), np.nan)
    for r in adapter(spark, sf_dir, "cells", n).collect():
        out[r["row"], r["col"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def channels(spark, sf_dir):
    found = defaultdict(list)
    for r in adapter(spark, sf_dir, "profile").orderBy("source_key", "pos").collect():
        found[r["source_key"]].append((r["pos"], r["node"], r["elevation"]))
    return found


def gridded(spark, sf_dir, name, shape, column="value"):
    out = np.full(shape, np.nan)
    for r in QUERIES[name](spark, sf_dir).collect():
        out[r["row"], r["col"]] = r[column]
    return out


def transform(n):
    return np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n)


def frequencies(shape):
    f = [np.array([(k if k < (n + 1) // 2 else k - n) / n for k in range(n)]) for n in shape]
    return np.sqrt(f[0][:, None] ** 2 + f[1][None, :] ** 2)


def spectrum_of(z):
    return transform(z.shape[0]) @ z @ transform(z.shape[1]).T


def back(s):
    return (transform(s.shape[0]).conj() @ s @ transform(s.shape[1]).conj().T).real / s.size


def test_bandpass_filter(spark, sf_dir, z):
    full = np.where(np.isnan(z), np.nanmean(z), z)
    f = frequencies(z.shape)
    want = back(spectrum_of(full) * (1 - np.exp(-((f / 0.02) ** 2) / 2)) * np.exp(-((f / 0.2) ** 2) / 2))
    assert np.allclose(gridded(spark, sf_dir, "bandpass_filter", z.shape), np.where(np.isnan(z), np.nan, want), equal_nan=True)


def test_wiener_filter(spark, sf_dir, z):
    full = np.where(np.isnan(z), np.nanmean(z), z)
    s, f = spectrum_of(full - full.mean()), frequencies(z.shape)
    power = np.abs(s) ** 2
    noise = power[f >= 0.75 * f.max()].mean()
    want = back(s * np.maximum(0, power - noise) / np.maximum(power, 1e-300)) + full.mean()
    assert np.allclose(gridded(spark, sf_dir, "wiener_filter", z.shape), np.where(np.isnan(z), np.nan, want), equal_nan=True, rtol=1e-5)


def test_power_spectrum(spark, sf_dir, z):
    rows, cols = z.shape
    y, x = np.mgrid[:rows, :cols]
    design = np.stack([x.ravel(), y.ravel(), np.ones(z.size)], axis=1).astype(float)
    full = np.nan_to_num(z)
    flat = full - (design @ np.linalg.solve(design.T @ design, design.T @ full.ravel())).reshape(z.shape)
    taper = [0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) for n in z.shape]
    w = np.outer(*taper)
    power = np.abs(spectrum_of(flat * w)) ** 2 / (z.size * (w**2).sum())
    f = frequencies(z.shape)
    at = np.minimum((f / 0.5 * 20).astype(int), 19)
    got = {r["bin"]: (r["frequency"], r["power"], r["n"]) for r in QUERIES["power_spectrum"](spark, sf_dir).collect()}
    assert set(got) == set(at.ravel().tolist())
    for b, (mean, p, n) in got.items():
        assert n == (at == b).sum() and math.isclose(mean, f[at == b].mean(), rel_tol=1e-9) and math.isclose(p, power[at == b].mean(), rel_tol=1e-6)


def test_breach(spark, sf_dir, z):
    rows, cols = z.shape
    out, parent, seen, queue = z.copy(), {}, set(), []
    inside = lambda i, j: 0 <= i < rows and 0 <= j < cols and not math.isnan(z[i, j])
    for i in range(rows):
        for j in range(cols):
            if inside(i, j) and not all(inside(i + a, j + b) for a, b in STEPS):
                heapq.heappush(queue, (z[i, j], i * cols + j))
                seen.add((i, j))
    while queue:
        level, at = heapq.heappop(queue)
        for a, b in STEPS:
            i, j = at // cols + a, at % cols + b
            if inside(i, j) and (i, j) not in seen:
                seen.add((i, j))
                parent[i, j] = (at // cols, at % cols)
                if out[i, j] <= level:
                    need, way = out[i, j], parent[i, j]
                    while way is not None and out[way] >= need - 0.001:
                        need -= 0.001
                        out[way] = need
                        way = parent.get(way)
                heapq.heappush(queue, (max(level, out[i, j]), i * cols + j))
    assert np.allclose(gridded(spark, sf_dir, "breach", z.shape), out, equal_nan=True)


def surface(z, radius=2):
    """Coefficients of the six-term surface around each cell, from the cells that the window has."""
    out = np.full((*z.shape, 6), np.nan)
    for i, j in np.argwhere(~np.isnan(z)):
        near = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius and 0 <= i + a < z.shape[0] and 0 <= j + b < z.shape[1] and not math.isnan(z[i + a, j + b])]
        if len(near) < 6:
            continue
        x, y = np.array([b for _, b in near], dtype=float), np.array([-a for a, _ in near], dtype=float)
        design = np.stack([x * x, y * y, x * y, x, y, np.ones(len(near))], axis=1)
        out[i, j] = np.linalg.lstsq(design, np.array([z[i + a, j + b] for a, b in near]), rcond=None)[0]
    return np.moveaxis(out, -1, 0)


def tangential(z):
    a, b, c, d, e, _ = surface(z)
    p = d * d + e * e
    return (2 * a * e * e - 2 * c * d * e + 2 * b * d * d) / (p * np.sqrt(1 + p))


def test_polynomial_surface(spark, sf_dir, z):
    a, b, c, d, e, f = surface(z)
    got = {name: gridded(spark, sf_dir, "polynomial_surface", z.shape, name) for name in ("elevation", "slope", "aspect", "curvature", "tangential", "profile", "gradient_x", "gradient_y")}
    p = d * d + e * e
    want = {"elevation": f, "slope": np.sqrt(p), "aspect": np.degrees(np.arctan2(-d, -e)) % 360, "curvature": 2 * a + 2 * b, "tangential": tangential(z), "profile": (2 * a * d * d + 2 * c * d * e + 2 * b * e * e) / (p * (1 + p) ** 1.5), "gradient_x": d, "gradient_y": e}
    for name, values in want.items():
        assert np.allclose(got[name], values, equal_nan=True, rtol=1e-5, atol=1e-7), name


def test_curved_channels(spark, sf_dir, z):
    t = tangential(z)
    bound = np.nanmean(t) + NormalDist().inv_cdf(0.95) * np.nanstd(t)
    got = {(r["row"], r["col"]) for r in QUERIES["curved_channels"](spark, sf_dir).collect()}
    assert got == {tuple(x) for x in np.argwhere(t > bound).tolist()} and got


def test_roughness(spark, sf_dir, z):
    rows, cols = z.shape
    normal = {}
    for i in range(1, rows - 1):
        for j in range(1, cols - 1):
            v = np.array([-(z[i, j + 1] - z[i, j - 1]) / 2, (z[i + 1, j] - z[i - 1, j]) / 2, 1.0])
            if not np.isnan(v).any():
                normal[i, j] = v / np.sqrt((v * v).sum())
    got = {(r["row"], r["col"]): (r["s1"], r["s2"], r["s3"]) for r in QUERIES["roughness"](spark, sf_dir).collect()}
    for (i, j), values in got.items():
        near = [normal[i + a, j + b] for a in range(-2, 3) for b in range(-2, 3) if (i + a, j + b) in normal]
        want = sorted(np.linalg.eigvals(sum(np.outer(v, v) for v in near) / len(near)).real, reverse=True)
        assert np.allclose(values, want, atol=1e-9)


def peeled(one):
    """The plain form: rims are marked over the whole grid, then taken off, until none is left to take."""
    one = {tuple(x) for x in np.argwhere(one).tolist()}
    while True:
        before = len(one)
        for half in (0, 1):
            gone = set()
            for i, j in one:
                p = [(i + a, j + b) in one for a, b in STEPS]
                turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                north, east, south, west = p[0], p[2], p[4], p[6]
                rim = (not (north and east and south) and not (east and south and west)) if half == 0 else (not (north and east and west) and not (north and south and west))
                if 2 <= sum(p) <= 6 and turns == 1 and rim:
                    gone.add((i, j))
            one -= gone
        if len(one) == before:
            return one


def test_skeleton_and_its_ends(spark, sf_dir, z):
    want = peeled(z > 50000)
    assert {(r["row"], r["col"]) for r in QUERIES["skeleton"](spark, sf_dir).collect()} == want
    ends = {(i, j) for i, j in want if sum((i + a, j + b) in want for a, b in STEPS) <= 1}
    assert {(r["row"], r["col"]) for r in QUERIES["skeleton_end_points"](spark, sf_dir).collect()} == ends


def smoothed(rows):
    found = defaultdict(list)
    for r in rows:
        found[r["source_key"]].append((r["pos"], r["denoised"]))
    return {k: np.array([v for _, v in sorted(x)]) for k, x in found.items()}


def test_tv_denoise(spark, sf_dir, channels):
    """What characterises the minimum: the residual's running sum stays within the bound, touches it where the result rises or falls, and ends at 0."""
    got = smoothed(QUERIES["tv_denoise"](spark, sf_dir).collect())
    assert set(got) == set(channels)
    for key, x in got.items():
        y = np.array([v for *_, v in channels[key]])
        u = np.cumsum(y - x)
        step = np.diff(x)
        assert len(x) == len(y) and abs(u[-1]) < 1e-6 and np.abs(u).max() <= 20 + 1e-6
        assert np.allclose(u[:-1][step > 1e-9], -20, atol=1e-6) and np.allclose(u[:-1][step < -1e-9], 20, atol=1e-6)


def test_knickpoint_chain(spark, sf_dir, channels):
    smooth = smoothed(kernels.denoise(adapter(spark, sf_dir, "profile"), "elevation", 30.0).collect())
    want = []
    for key, x in smooth.items():
        if len(x) < 6:
            continue
        at = [(i + 2, d) for i, d in enumerate(np.diff(x)) if d != 0]
        groups = []
        for pos, d in at:
            if groups and pos - groups[-1][-1][0] <= 3.0:
                groups[-1].append((pos, d))
            else:
                groups.append([(pos, d)])
        want += [(key, i, round(sum(d for _, d in g), 6), g[0][0], g[-1][0], len(g)) for i, g in enumerate(groups) if abs(sum(d for _, d in g)) >= 5.0]
    got = [(r["source_key"], r["knick"], round(r["delta"], 6), r["first"], r["last"], r["n"]) for r in QUERIES["knickpoint_chain"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and got


def fitted(x, y, sigma, least, most):
    """Best criterion over all segmentations: one fit a segment, by recursion over the last break."""
    cost = {}
    for i in range(len(x)):
        for j in range(i + least, len(x) + 1):
            m, b = np.polyfit(x[i:j], y[i:j], 1)
            cost[i, j] = ((y[i:j] - m * x[i:j] - b) ** 2).sum()
    best = {(1, j): (cost[0, j], ()) for j in range(least, len(x) + 1)}
    for k in range(2, most + 1):
        for j in range(k * least, len(x) + 1):
            ways = [(best[k - 1, i][0] + cost[i, j], (*best[k - 1, i][1], i)) for i in range((k - 1) * least, j - least + 1) if (k - 1, i) in best]
            if ways:
                best[k, j] = min(ways)
    scored = []
    for k in range(1, most + 1):
        if (k, len(x)) in best:
            p = 2 * k
            extra = 2 * p * (p + 1) / (len(x) - p - 1) if len(x) - p - 1 > 0 else math.inf
            scored.append((2 * p + best[k, len(x)][0] / sigma**2 + extra, best[k, len(x)][1]))
    return min(scored)[1] if scored else ()


def test_segment_channels(spark, sf_dir, channels):
    rows = defaultdict(list)
    for r in QUERIES["segment_channels"](spark, sf_dir).collect():
        rows[r["source_key"]].append((r["pos"], r["segment"], r["m_chi"], r["b_chi"]))
    assert set(rows) == set(channels)
    for key in sorted(channels, key=lambda k: (len(channels[k]), k))[:: max(1, len(channels) // 8)]:
        own = sorted(rows[key])
        x, y = np.array([float(p) for p, *_ in channels[key]]), np.array([v for *_, v in channels[key]])
        cuts = tuple(i for i in range(1, len(own)) if own[i][1] != own[i - 1][1])
        if len(x) >= 8:
            assert cuts == fitted(x, y, 20.0, 8, 6)
            for lo, hi in zip((0, *cuts), (*cuts, len(x))):
                m, b = np.polyfit(x[lo:hi], y[lo:hi], 1)
                assert math.isclose(own[lo][2], m, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(own[lo][3], b, rel_tol=1e-6, abs_tol=1e-6)


def test_long_channels_are_fitted_whole():
    """Costs by ends give the same breaks as the square of all costs."""
    rng = np.random.default_rng(3)
    x = np.arange(300.0)
    y = np.interp(x, [0, 90, 140, 299], [0, 40, 200, 210]) + rng.normal(0, 3, 300)
    assert kernels.best_segments(x, y, 3.0, 10, 6) == kernels.best_segments(x, y, 3.0, 10, 6, square=0)
    assert math.isclose(kernels.rescaled_likelihood(math.exp(-8 / (2 * 4)), 2.0, 4.0), math.exp(-8 / (2 * 16)))


def test_sampled_segments_on_lines(spark):
    """On straight channels every sample gives the line itself."""
    rows = [(k, p, 100 * k + p, float(p), 3.0 * k + (k + 1) * p) for k in range(3) for p in range(1, 60)]
    df = spark.createDataFrame(rows, "source_key long, pos long, node long, chi double, elevation double")
    got = kernels.sampled_segments(df, 1.0, rounds=6).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["m_mean"] - r["source_key"] - 1) < 1e-6 and r["m_sd"] < 1e-6 and abs(r["b_mean"] - 3 * r["source_key"]) < 1e-4


def test_concavity_chain_finds_the_concavity(spark):
    """Channels that are straight in chi at 0.4 and bent at any other value."""
    rows = []
    for s in range(4):
        chi = 0.0
        for p in range(1, 80):
            area = (400.0 - 3 * p) * (1 + 3 * s)
            chi += 10 * area**-0.4
            rows.append((s, 0, p, area, 10.0, 800 * chi))
    df = spark.createDataFrame(rows, "source_key long, basin_key long, pos long, area double, dx double, elevation double")
    r = kernels.concavity_chain(df, "basin_key", "area", "dx", steps=1500, width=0.001, sigma=2.0).head()
    assert abs(r["theta"] - 0.4) < 0.03 and 0.02 < r["accepted"] < 0.98


def test_by_channel_is_independent_of_batches(spark):
    """Channels that span batches and batches that span channels."""
    rows = [(k, p, 10_000 * k + p, float((7 * p + k) % 13)) for k, n in enumerate([1, 400, 3, 3, 900, 50]) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "source_key long, pos long, node long, elevation double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got = smoothed(kernels.denoise(df.repartition(3), "elevation", 2.0).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(6):
        assert np.allclose(got[k], kernels.total_variation(np.array([v for s, *_, v in rows if s == k]), 2.0))


def test_flow_in_circles_raises(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "row int, col int, value double")
    edges = spark.createDataFrame([(0, 0, 0, 1, 1.0), (0, 1, 0, 0, 1.0)], "row int, col int, to_row int, to_col int, w double")
    with pytest.raises(ValueError):
        routing.spread_flow(cells, edges)


def test_traces_all_end(spark):
    """Two slopes that face each other: traces end at the bottom, not in an endless swing across it."""
    from catena.grid import GridSpec

    cells = spark.createDataFrame([(i, j, abs(j - 6) * 1.0 + 0.01 * abs(i - 4)) for i in range(9) for j in range(13)], "row int, col int, value double")
    starts = cells.where("row BETWEEN 1 AND 7 AND col IN (1, 11)").select("row", "col")
    got = routing.aspect_traces(cells, starts, starts.limit(0), GridSpec(9, 13)).collect()
    assert len(got) == 14 and all(abs(r["col"] - 6) <= 1 for r in got)


def test_moves_and_tags(spark):
    # 0 <- 1 <- 2 <- 3 <- 4, with 5 -> 2.
    receiver = {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 2}
    nodes = spark.createDataFrame([(n, r, float(n != r)) for n, r in receiver.items()], "node long, receiver long, dx double")
    heads = spark.createDataFrame([(2,), (4,)], "node long")
    assert {r["node"]: r["moved"] for r in routing.move_heads_up(nodes, heads, 1.5).collect()} == {2: 3, 4: 4}
    assert {r["node"]: r["moved"] for r in routing.move_heads_down(nodes, heads, 1.5).collect()} == {2: 1, 4: 3}
    tags = spark.createDataFrame([(4, 7), (5, 9)], "node long, tag long")
    assert {r["node"]: r["tag"] for r in routing.tag_downstream(nodes, tags, 2.0).collect()} == {4: 7, 5: 9, 3: 7, 2: 9, 1: 9}


def test_nearest_without_targets(spark):
    from catena.operators import joins

    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 900.0, 3.0)], "id long, x double, y double")
    targets = spark.createDataFrame([(7, 1.0, 1.0)], "id2 long, x double, y double")
    assert [(r["id"], r["id2"]) for r in joins.nearest(points, targets, 2.0).orderBy("id").collect()] == [(1, 7), (2, 7)]
    assert [(r["id"], r["id2"], r["distance"]) for r in joins.nearest(points, targets.limit(0), 2.0).orderBy("id").collect()] == [(1, None, None), (2, None, None)]


def test_large_windows_on_tiles(spark):
    from catena.operators import focal

    z = np.random.default_rng(4).uniform(0, 9, (14, 11))
    z[3, 4] = np.nan
    rows = [(int(i), int(j), float(z[i, j])) for i, j in np.argwhere(~np.isnan(z))]
    got = {(r["row"], r["col"]): r for r in focal.neighbourhood(spark.createDataFrame(rows, "row int, col int, value double"), 3).collect()}
    assert len(got) == len(rows)
    for i, j, _ in rows:
        near = np.array([v for a, b, v in rows if (a - i) ** 2 + (b - j) ** 2 <= 9])
        r = got[i, j]
        assert r["n"] == len(near) and np.allclose([r["mean"], r["sd"], r["low"], r["high"], r["relief"]], [near.mean(), near.std(), near.min(), near.max(), np.ptp(near)])


def test_numbers_in_order(spark):
    from catena.operators import morphology

    values = [5, 70_000, 5, 12, 10**12, 65_535, 65_536]
    got = {r["v"]: r["number"] for r in morphology.in_order(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}


def test_imaginary_error_function(spark):
    from catena.functions.stats import erfi

    # Known values.
    want = {0.0: 0.0, 0.5: 0.6149520946965110, 1.0: 1.6504257587975429, 2.0: 18.564802414575553}
    df = spark.createDataFrame([(x,) for x in want], "x double").withColumn("y", erfi(F.col("x")))
    assert all(math.isclose(r["y"], want[r["x"]], rel_tol=1e-9, abs_tol=1e-12) for r in df.collect())


def test_shared_folder_on_a_cluster(spark):
    """Without a named folder only threads of one process share files."""
    from types import SimpleNamespace

    from catena import storage

    conf = SimpleNamespace(get=lambda key, default: default)
    for master, good in (("local", True), ("local[4]", True), ("spark://host:7077", False), ("local-cluster[2,1,1024]", False), ("yarn", False)):
        context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master=master, applicationId="app")
        session = SimpleNamespace(sparkContext=context, conf=conf)
        if good:
            assert storage.folder(session).endswith("/app")
        else:
            with pytest.raises(RuntimeError):
                storage.folder(session)
