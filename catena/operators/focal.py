"""Neighbourhood operators: window statistics, surface fits, shading, filters.

Small windows send values to the cells around and gather them in one grouped
aggregation.  Larger ones work on square tiles as arrays: each cell also goes to the tiles
whose margin it lies in, so the data grow by the margin's share only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.grid import disc, spread, window3

TILE = 256


def neighbourhood(cells: DataFrame, radius: float, circular: bool = True) -> DataFrame:
    """``row, col, mean, sd, low, high, relief, n`` over the window around each data cell.

    Up to radius 2 values are sent to the cells around them; larger windows are taken on tiles, where only margins are copied.
    """
    data = cells.where("value IS NOT NULL")
    if radius > 2:
        return _windowed(data, int(radius), disc(radius, circular))
    sent = spread(data, disc(radius, circular))
    found = sent.groupBy("row", "col").agg(F.avg("sent").alias("mean"), F.stddev_pop("sent").alias("sd"), F.min("sent").alias("low"), F.max("sent").alias("high"), F.count("*").alias("n"))
    return found.join(data.select("row", "col"), ["row", "col"], "left_semi").withColumn("relief", F.col("high") - F.col("low"))


def _windowed(data: DataFrame, reach: int, offsets: list[tuple[int, int]]) -> DataFrame:
    """``neighbourhood`` on tiles: the shifted copies of a tile are gone through one by one."""

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        p = np.pad(z, reach, constant_values=np.nan)
        n, total, square = np.zeros_like(z), np.zeros_like(z), np.zeros_like(z)
        low, high = np.full_like(z, np.inf), np.full_like(z, -np.inf)
        # About the cell's own value, so that squares stay small.
        for i, j in offsets:
            d = p[reach + i : reach + i + z.shape[0], reach + j : reach + j + z.shape[1]] - z
            have = ~np.isnan(d)
            d0 = np.where(have, d, 0.0)
            n, total, square = n + have, total + d0, square + d0 * d0
            low, high = np.where(have, np.minimum(low, d0), low), np.where(have, np.maximum(high, d0), high)
        with np.errstate(all="ignore"):
            mean = total / n
            return {"mean": z + mean, "sd": np.sqrt(np.maximum(0, square / n - mean * mean)), "low": z + low, "high": z + high, "relief": high - low, "n": n}

    found = on_tiles(data, reach, kernel, ["mean", "sd", "low", "high", "relief", "n"])
    return found.select("row", "col", "mean", "sd", "low", "high", F.col("n").cast("long").alias("n"), "relief")


def fraction_where(cells: DataFrame, radius: float, low: float, high: float) -> DataFrame:
    """The share of the window's data cells with values in a range."""
    data = cells.where("value IS NOT NULL")
    sent = spread(data, disc(radius)).groupBy("row", "col").agg(F.avg(F.when(F.col("sent").between(low, high), 1.0).otherwise(0.0)).alias("fraction"))
    return sent.join(data.select("row", "col"), ["row", "col"], "left_semi")


def gradient3(cells: DataFrame, res: float = 1.0) -> DataFrame:
    """``row, col, z, zx, zy`` by weighted differences over the 3 x 3 window; only cells with all neighbours."""
    w = window3(cells)
    n = [F.col(f"n{k}") for k in range(8)]
    zx = ((n[1] + 2 * n[2] + n[3]) - (n[7] + 2 * n[6] + n[5])) / (8 * res)
    zy = ((n[7] + 2 * n[0] + n[1]) - (n[5] + 2 * n[4] + n[3])) / (8 * res)
    return w.select("row", "col", "z", zx.alias("zx"), zy.alias("zy")).where("zx IS NOT NULL AND zy IS NOT NULL")


def hillshade(cells: DataFrame, res: float = 1.0, altitude: float = 45.0, azimuth: float = 315.0, z_factor: float = 1.0) -> DataFrame:
    """Brightness from 0 to 255 under a sun of given altitude and compass azimuth."""
    g = gradient3(cells, res)
    zenith, north = math.radians(90 - altitude), math.radians(azimuth)
    zx, zy = F.col("zx") * z_factor, F.col("zy") * z_factor
    # The cosine between the surface normal (-zx, -zy, 1) and the sun.
    sun = (math.sin(north) * math.sin(zenith), math.cos(north) * math.sin(zenith), math.cos(zenith))
    light = (-zx * sun[0] - zy * sun[1] + sun[2]) / F.sqrt(1 + zx * zx + zy * zy)
    return g.select("row", "col", (255 * F.greatest(light, F.lit(0.0))).alias("hillshade"))


def tiled(df: DataFrame, columns: list[str], margin: int, kernel: Callable[[tuple[int, int], dict[str, np.ndarray]], dict[str, np.ndarray]], result: dict[str, str], tile: int = TILE) -> DataFrame:
    """Apply an array kernel to square tiles with a margin: ``row, col`` and the columns of ``result`` for every row of ``df``.

    The kernel gets the row and column of its array's corner and a (rows, cols) array of doubles for each column, NaN where there
    is no row; it returns an array of that size for each result.
    """
    data = df.select("row", "col", *[F.col(c).cast("double").alias(c) for c in columns])
    low = lambda c: F.floor((F.col(c) - margin) / tile)
    high = lambda c: F.floor((F.col(c) + margin) / tile)
    dealt = data.withColumn("tr", F.explode(F.sequence(low("row"), high("row")))).withColumn("tc", F.explode(F.sequence(low("col"), high("col"))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        side, top, left = tile + 2 * margin, int(key[0]) * tile - margin, int(key[1]) * tile - margin
        r, c = rows["row"].to_numpy() - top, rows["col"].to_numpy() - left
        arrays = {}
        for name in columns:
            arrays[name] = np.full((side, side), np.nan)
            arrays[name][r, c] = rows[name].to_numpy()
        inner = (r >= margin) & (r < margin + tile) & (c >= margin) & (c < margin + tile)
        if not inner.any():
            return pd.DataFrame({k: [] for k in ["row", "col", *result]})
        found = kernel((top, left), arrays)
        out = {"row": rows["row"].to_numpy()[inner], "col": rows["col"].to_numpy()[inner]}
        return pd.DataFrame(out | {k: found[k][r[inner], c[inner]] for k in result})

    return dealt.groupBy("tr", "tc").applyInPandas(run, "row int, col int, " + ", ".join(f"{k} {t}" for k, t in result.items()))


def on_tiles(cells: DataFrame, margin: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: list[str], tile: int = TILE) -> DataFrame:
    """``tiled`` for one grid: the kernel gets its values and returns an array of doubles for each column."""
    return tiled(cells.where("value IS NOT NULL"), ["value"], margin, lambda _corner, a: kernel(a["value"]), {k: "double" for k in columns}, tile)


def _windows(z: np.ndarray, radius: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(z, radius, constant_values=np.nan), (2 * radius + 1, 2 * radius + 1))


SURFACE = ["elevation", "slope", "aspect", "curvature", "planform", "profile", "tangential", "kind", "gradient_x", "gradient_y"]


def polynomial_surface(cells: DataFrame, radius_cells: int, res: float = 1.0, circular: bool = True, partial: bool = True) -> DataFrame:
    """Surface metrics from z = ax^2 + by^2 + cxy + dx + ey + f, fitted around each cell by least squares.

    Elevation, slope (gradient), aspect (degrees from north), mean curvature 2a + 2b, planform, profile and tangential
    curvature, kind (1 peak, 2 pit, 3 saddle, 0 none), and the gradients along both axes (east, north).  Windows with gaps are fitted on the cells that they have, or
    give no values unless ``partial``.
    """
    r = radius_cells
    y, x = np.mgrid[r : -r - 1 : -1, -r : r + 1] * res
    use = ((x * x + y * y) <= (r * res) ** 2 + 1e-9) if circular else np.ones_like(x, dtype=bool)
    design = np.stack([x * x, y * y, x * y, x, y, np.ones_like(x)], axis=-1)[use]

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        w = _windows(z, r)[:, :, use]
        have = ~np.isnan(w)
        whole = have.all(axis=-1)
        co = np.full((*z.shape, 6), np.nan)
        co[whole] = w[whole] @ np.linalg.pinv(design).T
        some = ~whole & (have.sum(axis=-1) >= 6) & ~np.isnan(z) & partial
        for i, j in np.argwhere(some):
            h = have[i, j]
            co[i, j] = np.linalg.lstsq(design[h], w[i, j][h], rcond=None)[0]
        a, b, c, d, e, f = np.moveaxis(co, -1, 0)
        fx, fy, fxx, fyy, fxy = d, e, 2 * a, 2 * b, c
        p = fx * fx + fy * fy
        with np.errstate(all="ignore"):
            flat = p == 0
            plan = np.where(flat, 0, (fxx * fy * fy - 2 * fxy * fx * fy + fyy * fx * fx) / np.sqrt(p**3))
            prof = np.where(flat, 0, (fxx * fx * fx + 2 * fxy * fx * fy + fyy * fy * fy) / (p * np.sqrt((1 + p) ** 3)))
            tang = np.where(flat, 0, (fxx * fy * fy - 2 * fxy * fx * fy + fyy * fx * fx) / (p * np.sqrt(1 + p)))
            slope = np.sqrt(p)
            level = slope < np.tan(np.radians(0.1))
            det = fxx * fyy - fxy * fxy
            kind = np.where(~level, 0, np.where(det < 0, 3, np.where((fxx < 0) & (det > 0), 1, np.where(det > 0, 2, 0))))
            aspect = np.degrees(np.arctan2(-fx, -fy)) % 360
        return dict(zip(SURFACE, [f, slope, aspect, fxx + fyy, plan, prof, tang, kind.astype(float), d, e], strict=True))

    return on_tiles(cells, r, kernel, SURFACE)


def gaussian(cells: DataFrame, sigma: float, reach: float = 3.0) -> DataFrame:
    """Gaussian smoothing; near gaps the weights of what is there are scaled up."""
    r = max(1, math.ceil(reach * sigma))
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        have = (~np.isnan(z)).astype(float)
        blur = lambda a: np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 0, a, g, "same"), g, "same")
        return {"value": blur(np.nan_to_num(z)) / np.maximum(blur(have), 1e-300)}

    return on_tiles(cells, r, kernel, ["value"])


def perona_malik(cells: DataFrame, rounds: int = 5, step: float = 0.1, contrast: float | None = None) -> DataFrame:
    """Edge-keeping diffusion: flow between neighbours fades where the gradient exceeds the contrast."""

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        u = z.copy()
        k2 = contrast
        for _ in range(rounds):
            total = np.zeros_like(u)
            for axis in (0, 1):
                for way in (1, -1):
                    d = np.roll(u, way, axis) - u
                    edge = [slice(None), slice(None)]
                    edge[axis] = 0 if way == 1 else -1
                    d[tuple(edge)] = 0
                    d = np.nan_to_num(d)
                    total += d * np.exp(-((d / k2) ** 2))
            u = u + step * total
        return {"value": u}

    if contrast is None:
        gap = gradient3(cells).select(F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy")).alias("g"))
        contrast = gap.agg(F.percentile(F.col("g"), F.lit(0.9))).head()[0] or 1.0
    return on_tiles(cells, rounds + 1, kernel, ["value"])


def non_local_means(cells: DataFrame, window: int = 3, similar: int = 1, strength: float = 1.0) -> DataFrame:
    """Average of the window's cells weighted by how alike their surroundings are."""

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        total, weight = np.zeros_like(z), np.zeros_like(z)
        for i in range(-window, window + 1):
            for j in range(-window, window + 1):
                moved = np.roll(z, (i, j), (0, 1))
                d = np.nanmean(_windows((moved - z) ** 2, similar), axis=(-1, -2))
                w = np.where(np.isnan(moved) | np.isnan(d), 0, np.exp(-np.nan_to_num(d) / strength**2))
                total += w * np.nan_to_num(moved)
                weight += w
        with np.errstate(all="ignore"):
            return {"value": total / weight}

    return on_tiles(cells, window + similar, kernel, ["value"])


def roughness(cells: DataFrame, radius_cells: int, res: float = 1.0) -> DataFrame:
    """``s1, s2, s3``: eigenvalues (largest first, sum 1) of the direction cosines of surface normals in the window."""

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        zy, zx = np.gradient(z, res)
        n = np.stack([-zx, zy, np.ones_like(z)], axis=-1)
        n /= np.linalg.norm(n, axis=-1, keepdims=True)
        t = np.einsum("ijk,ijl->ijkl", n, n)
        mean = np.stack([np.nanmean(_windows(t[..., a, b], radius_cells), axis=(-1, -2)) for a in range(3) for b in range(3)], axis=-1).reshape(*z.shape, 3, 3)
        bad = np.isnan(mean).any(axis=(-1, -2))
        values = np.linalg.eigvalsh(np.where(bad[..., None, None], np.eye(3), mean))[..., ::-1]
        values[bad] = np.nan
        return {f"s{i + 1}": values[..., i] for i in range(3)}

    return on_tiles(cells, radius_cells + 1, kernel, ["s1", "s2", "s3"])


def shielding(cells: DataFrame, res: float, reach: int, directions: int = 8) -> DataFrame:
    """Topographic shielding from 0 to 1: the share of cosmic rays not blocked by the horizon up to ``reach`` cells away."""

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        blocked = np.zeros_like(z)
        for k in range(directions):
            a = 2 * math.pi * k / directions
            horizon = np.zeros_like(z)
            for d in range(1, reach + 1):
                i, j = round(-d * math.cos(a)), round(d * math.sin(a))
                far = np.full_like(z, np.nan)
                rows, cols = slice(max(0, -i), z.shape[0] - max(0, i)), slice(max(0, -j), z.shape[1] - max(0, j))
                far[rows, cols] = z[max(0, i) : z.shape[0] + min(0, i), max(0, j) : z.shape[1] + min(0, j)]
                rise = np.arctan2(far - z, res * math.hypot(i, j))
                horizon = np.fmax(horizon, rise)
            blocked += np.sin(np.maximum(horizon, 0)) ** 3.3
        return {"shielding": 1 - blocked / directions}

    return on_tiles(cells, reach, kernel, ["shielding"])


def fill_gaps(cells: DataFrame, nrows: int, ncols: int, radius: float = 1.5, rounds: int = 10) -> DataFrame:
    """Nodata inside the grid becomes the mean of data around it, from the rims inwards, up to ``rounds`` cells deep."""
    from catena.operators.algebra import pad
    from catena.storage import store

    now = store(pad(cells.where("value IS NOT NULL"), nrows, ncols), "gaps-0")
    for k in range(rounds):
        near = spread(now.where("value IS NOT NULL"), disc(radius)).groupBy("row", "col").agg(F.avg("sent").alias("near"))
        now = store(now.join(near, ["row", "col"], "left").select("row", "col", F.coalesce("value", "near").alias("value")), f"gaps-{k + 1}")
        if not now.where("value IS NULL").take(1):
            break
    return now.where("value IS NOT NULL")


def fill_between(cells: DataFrame, nrows: int, ncols: int, width: int, sides: int = 4) -> DataFrame:
    """Nodata that has data within ``width`` cells on at least ``sides`` of its four sides becomes the mean of the nearest ones.

    With four sides only holes that are surrounded are filled, and the outside of an irregular grid stays nodata.
    """
    from pyspark.sql import Window

    from catena.operators.algebra import pad

    full = pad(cells.where("value IS NOT NULL"), nrows, ncols)
    parts = []
    for along, across in (("col", "row"), ("row", "col")):
        w = Window.partitionBy(across).orderBy(along)
        parts += [F.last("value", ignorenulls=True).over(w.rowsBetween(-width, -1)), F.first("value", ignorenulls=True).over(w.rowsBetween(1, width))]
    near = full.withColumns({f"__s{k}": c for k, c in enumerate(parts)})
    found = sum((F.col(f"__s{k}").isNotNull().cast("int") for k in range(4)), F.lit(0))
    mean = sum((F.coalesce(f"__s{k}", F.lit(0.0)) for k in range(4)), F.lit(0.0)) / found
    return near.select("row", "col", F.coalesce("value", F.when(found >= sides, mean)).alias("value")).where("value IS NOT NULL")


def _lines(df: DataFrame, along: str, across: str, n: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 64) -> DataFrame:
    """Apply a kernel to whole lines of complex cells (row, col, re, im): it gets the lines' numbers and a (lines, n) array, and returns such an array.

    A group holds ``block`` lines, so a task holds that many lines of the grid, not the grid.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows[across].min())
        lines = np.zeros((int(rows[across].max()) - first + 1, n), dtype=complex)
        lines[rows[across] - first, rows[along]] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        out = kernel(np.arange(first, first + len(lines)), lines)
        i, j = np.indices(out.shape, dtype=np.int32)
        return pd.DataFrame({across: (i + first).ravel(), along: j.ravel(), "re": out.real.ravel(), "im": out.imag.ravel()})[["row", "col", "re", "im"]]

    return df.groupBy(F.floor(F.col(across) / block).alias("__block")).applyInPandas(run, "row int, col int, re double, im double")


def _spectrum_by_rows(full: DataFrame, ncols: int) -> DataFrame:
    """Each row of a dense grid (row, col, value) transformed."""
    rows = full.select("row", "col", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return _lines(rows, "col", "row", ncols, lambda _at, x: np.fft.fft(x, axis=1))


def _frequency(row: np.ndarray, nrows: int, col: np.ndarray, ncols: int, res: float) -> np.ndarray:
    return np.hypot(np.fft.fftfreq(nrows, res)[row], np.fft.fftfreq(ncols, res)[col])


def _dense(cells: DataFrame, nrows: int, ncols: int, gaps: float) -> DataFrame:
    from catena.operators.algebra import pad

    return pad(cells.select("row", "col", F.col("value").cast("double")), nrows, ncols).withColumn("value", F.coalesce("value", F.lit(gaps)))


def _back(columns: DataFrame, cells: DataFrame, ncols: int) -> DataFrame:
    """The data cells of a grid whose columns are transformed back already."""
    found = _lines(columns, "col", "row", ncols, lambda _at, x: np.fft.ifft(x, axis=1))
    return found.join(cells.where("value IS NOT NULL").select("row", "col"), ["row", "col"], "left_semi").select("row", "col", F.col("re").alias("value"))


def spectrum(cells: DataFrame, nrows: int, ncols: int, res: float = 1.0, bins: int = 20) -> DataFrame:
    """``bin, frequency, power, n``: the radial power spectrum of the detrended, windowed grid; gaps count as 0.

    Rows are transformed first, then columns: two shuffles of the grid, and no task holds more than a block of lines.
    """
    full = _dense(cells, nrows, ncols, 0.0)
    # The plane of least squares over all cells, from sums.
    one = F.lit(1.0)
    terms = [F.col("col"), F.col("row"), one]
    sums = full.agg(*[F.sum(x * y).cast("double") for x in terms for y in [*terms, F.col("value")]]).head()
    m = np.array(sums, dtype=float).reshape(3, 4)
    plane = np.linalg.solve(m[:, :3], m[:, 3])
    taper = lambda c, n: 0.5 - F.cos(F.col(c) * (2 * math.pi / max(1, n - 1))) * 0.5
    flat = full.withColumn("value", (F.col("value") - F.col("col") * float(plane[0]) - F.col("row") * float(plane[1]) - float(plane[2])) * taper("row", nrows) * taper("col", ncols))
    weight = nrows * ncols * float((np.hanning(nrows) ** 2).sum() * (np.hanning(ncols) ** 2).sum())
    both = _lines(_spectrum_by_rows(flat, ncols), "row", "col", nrows, lambda _at, x: np.fft.fft(x, axis=1))

    def frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            f = _frequency(rows["row"].to_numpy(), nrows, rows["col"].to_numpy(), ncols, res)
            yield pd.DataFrame({"f": f, "bin": np.minimum((f / (0.5 / res) * bins).astype(np.int32), bins - 1), "p": (rows["re"] ** 2 + rows["im"] ** 2) / weight})

    placed = both.mapInPandas(frequency, "f double, bin int, p double")
    return placed.groupBy("bin").agg(F.avg("f").alias("frequency"), F.avg("p").alias("power"), F.count("*").alias("n"))


def frequency_filter(cells: DataFrame, nrows: int, ncols: int, res: float, low: float | None, high: float | None) -> DataFrame:
    """Keep wavelengths between frequencies ``low`` and ``high`` (None: open), with smooth shoulders; gaps count as the mean.

    Rows, then columns there and back, then rows back: three shuffles of the grid.
    """
    mean = cells.agg(F.avg("value")).head()[0] or 0.0

    def columns(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        f = _frequency(np.arange(nrows)[None, :], nrows, at[:, None], ncols, res)
        h = np.ones_like(f)
        if low is not None:
            h *= 1 - np.exp(-((f / low) ** 2) / 2)
        if high is not None:
            h *= np.exp(-((f / high) ** 2) / 2)
        return np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1)

    rows = _spectrum_by_rows(_dense(cells, nrows, ncols, mean), ncols)
    return _back(_lines(rows, "row", "col", nrows, columns), cells, ncols)


def wiener(cells: DataFrame, nrows: int, ncols: int, res: float = 1.0) -> DataFrame:
    """Least-squares denoising in frequency space, with the noise taken from the highest quarter of frequencies; gaps count as the mean.

    The spectrum is stored once, as the noise is known only after all of it.
    """
    from catena.storage import store

    mean = cells.agg(F.avg("value")).head()[0] or 0.0
    rows = _spectrum_by_rows(_dense(cells, nrows, ncols, mean).withColumn("value", F.col("value") - mean), ncols)
    both = store(_lines(rows, "row", "col", nrows, lambda _at, x: np.fft.fft(x, axis=1)), "spectrum")
    top = float(np.hypot(np.abs(np.fft.fftfreq(nrows, res)).max(), np.abs(np.fft.fftfreq(ncols, res)).max()))

    def powers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            f = _frequency(part["row"].to_numpy(), nrows, part["col"].to_numpy(), ncols, res)
            p = (part["re"] ** 2 + part["im"] ** 2).to_numpy()[f >= 0.75 * top]
            yield pd.DataFrame({"total": [p.sum()], "n": [len(p)]})

    found = both.mapInPandas(powers, "total double, n long").agg(F.sum("total"), F.sum("n")).head()
    noise = (found[0] or 0.0) / max(1, found[1] or 0)

    def columns(_at: np.ndarray, x: np.ndarray) -> np.ndarray:
        power = np.abs(x) ** 2
        return np.fft.ifft(x * np.maximum(0, power - noise) / np.maximum(power, 1e-300), axis=1)

    back = _back(_lines(both, "row", "col", nrows, columns), cells, ncols)
    return back.withColumn("value", F.col("value") + mean)
