"""Made-up surfaces: planes, waves, noise, midpoint fractals, steady landscapes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.grid import GridSpec


def grid_of(spark: SparkSession, spec: GridSpec, value: Column | None = None) -> DataFrame:
    """Every cell of a grid, with an expression of ``row``, ``col``, ``x`` and ``y`` as value."""
    n = spec.nrows * spec.ncols
    cells = spark.range(n).select(F.floor(F.col("id") / spec.ncols).cast("int").alias("row"), (F.col("id") % spec.ncols).cast("int").alias("col"))
    cells = cells.withColumns({"x": spec.x(F.col("col")), "y": spec.y(F.col("row"))})
    return cells.select("row", "col", (value if value is not None else F.lit(0.0)).cast("double").alias("value"))


def plane(spark: SparkSession, spec: GridSpec, zx: float, zy: float, z0: float = 0.0) -> DataFrame:
    return grid_of(spark, spec, F.col("x") * zx + F.col("y") * zy + z0)


def sine_waves(spark: SparkSession, spec: GridSpec, length: float, height: float) -> DataFrame:
    return grid_of(spark, spec, F.sin(F.col("x") * (2 * np.pi / length)) * F.sin(F.col("y") * (2 * np.pi / length)) * height)


def noise(spark: SparkSession, spec: GridSpec, low: float = 0.0, high: float = 1.0, seed: int = 1) -> DataFrame:
    """Uniform values by a hash of the cell, the same in every run and partitioning."""
    u = F.pmod(F.xxhash64("row", "col", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return grid_of(spark, spec, u * (high - low) + low)


def fractal(spark: SparkSession, spec: GridSpec, beta: float = 2.0, relief: float = 100.0, seed: int = 1) -> DataFrame:
    """A surface with a power-law spectrum, made on the driver (bounded by its memory)."""
    rng = np.random.default_rng(seed)
    f = np.hypot(*np.meshgrid(np.fft.fftfreq(spec.nrows), np.fft.fftfreq(spec.ncols), indexing="ij"))
    f[0, 0] = 1
    z = np.fft.ifft2(np.fft.fft2(rng.standard_normal(f.shape)) * f ** (-beta / 2)).real
    z = (z - z.min()) / max(1e-300, np.ptp(z)) * relief
    row, col = np.divmod(np.arange(z.size, dtype=np.int32), spec.ncols)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"row": row, "col": col, "value": z.ravel()}), "row int, col int, value double")


def diamond_square(spark: SparkSession, spec: GridSpec, order: int, relief: float = 100.0, seed: int = 1) -> DataFrame:
    """Midpoint displacement on a square of 2^order + 1, cut to the grid; made on the driver."""
    import pandas as pd

    rng, n = np.random.default_rng(seed), 2**order + 1
    z = np.zeros((n, n))
    z[:: n - 1, :: n - 1] = rng.uniform(-1, 1, (2, 2))
    step, scale = n - 1, 1.0
    while step > 1:
        h = step // 2
        z[h::step, h::step] = (z[:-1:step, :-1:step] + z[step::step, :-1:step] + z[:-1:step, step::step] + z[step::step, step::step]) / 4 + rng.uniform(-scale, scale, ((n - 1) // step,) * 2)
        p = np.pad(z, h, mode="reflect")
        near = (p[: -2 * h, h:-h] + p[2 * h :, h:-h] + p[h:-h, : -2 * h] + p[h:-h, 2 * h :]) / 4
        for a, b in ((h, 0), (0, h)):
            z[a::step, b::step] = near[a::step, b::step] + rng.uniform(-scale, scale, z[a::step, b::step].shape)
        step, scale = h, scale / 2
    z = z[: spec.nrows, : spec.ncols]
    z = (z - z.min()) / max(1e-300, np.ptp(z)) * relief
    row, col = np.divmod(np.arange(z.size, dtype=np.int32), z.shape[1])
    return spark.createDataFrame(pd.DataFrame({"row": row, "col": col, "value": z.ravel()}), "row int, col int, value double")


def steady_profile(nodes: DataFrame, counts: DataFrame, uplift: float, erodibility: float, m: float = 0.5, n: float = 1.0, res: float = 1.0) -> DataFrame:
    """``node, z`` of the landscape where incision by the stream-power law balances uplift: slopes summed up from the roots."""
    from catena.functions.soil import steady_slope
    from catena.operators.flow import to_root

    slope = steady_slope(uplift, erodibility, F.col("n_contrib") * (res * res), m, n)
    joined = nodes.join(counts.select("node", "n_contrib"), "node")
    return to_root(joined, {"z": F.col("dx") * slope}).select("node", "z")
