"""Cosmogenic nuclides: production scaling, concentrations, apparent erosion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decay constants (1/yr), surface production at sea level and high latitude (atoms/g/yr),
# attenuation lengths (g/cm^2) and the shares of production by spallation and three muon terms.
DECAY = {"be10": 4.99e-7, "al26": 9.83e-7, "c14": 1.21e-4, "cl36": 2.3e-6, "ne21": 0.0, "he3": 0.0}
PRODUCTION = {"be10": 4.30, "al26": 31.10, "c14": 15.21, "cl36": 58.95, "ne21": 18.23, "he3": 121.59}
ATTENUATION = (160.0, 738.6, 2688.0, 4360.0)
SHARES = {"be10": (0.9887, 0.0027, 0.0086, 0.0), "al26": (0.9699, 0.0275, 0.0026, 0.0), "c14": (0.83, 0.0691, 0.0809, 0.02), "cl36": (0.903, 0.0447, 0.05023, 0.0), "ne21": (1.0, 0.0, 0.0, 0.0), "he3": (1.0, 0.0, 0.0, 0.0)}
# Coefficients of the latitude scaling of Stone (2000) at 0, 10, .. 60 degrees: a, b, c, d, e, muon.
STONE = [
    (31.8518, 250.3193, -0.083393, 7.4260e-5, -2.2397e-8, 0.587),
    (34.3699, 258.4759, -0.089807, 7.9457e-5, -2.3697e-8, 0.600),
    (40.3153, 308.9894, -0.106248, 9.4508e-5, -2.8234e-8, 0.678),
    (42.0983, 512.6857, -0.120551, 1.1752e-4, -3.8809e-8, 0.833),
    (56.7733, 649.1343, -0.160859, 1.5463e-4, -5.0330e-8, 0.933),
    (69.0720, 832.4566, -0.199252, 1.9391e-4, -6.3653e-8, 1.000),
    (71.8733, 863.1927, -0.207069, 2.0127e-4, -6.6043e-8, 1.000),
]


def pressure(elevation: Column) -> Column:
    """Standard atmosphere in hPa at a height in metres."""
    return F.exp(-0.03417 / 0.0065 * (F.log(F.lit(288.15)) - F.log(F.lit(288.15) - elevation * 0.0065))) * 1013.25


def stone_scaling(latitude: Column, hpa: Column, spallation: float = 0.978) -> Column:
    """Production relative to sea level at high latitude; between latitudes linear."""
    terms = []
    for a, b, c, d, e, muon in STONE:
        s = F.lit(a) + F.exp(hpa / -150.0) * b + hpa * c + hpa * hpa * d + hpa * hpa * hpa * e
        terms.append(s * spallation + F.exp((F.lit(1013.25) - hpa) / 242.0) * (muon * (1 - spallation)))
    lat = F.least(F.abs(latitude), F.lit(60.0))
    table = F.array(*terms)
    i = F.least(F.floor(lat / 10), F.lit(5)).cast("int")
    share = lat / 10 - i
    return F.element_at(table, i + 1) * (1 - share) + F.element_at(table, i + 2) * share


def cutoff_rigidity(latitude: Column) -> Column:
    """Of a dipole field, in GV."""
    c = F.cos(F.radians(latitude))
    return c * c * c * c * 14.9


def dunai_scaling(hpa: Column, rigidity: Column) -> Column:
    """Dunai (2001); fixed values as published."""
    level = F.lit(0.5221) / F.pow(1 + F.exp((rigidity - 4.2822) / 1.7211), F.lit(0.3345)) + 0.4952
    length = F.lit(17.183) / F.pow(1 + F.exp((rigidity - 2.2964) / -2.060), F.lit(5.9164)) + 130.11
    return level * F.exp((1013.25 - hpa) * 1.019716 / length)


# Coefficients of the attenuation integral of Desilets and others (2006).
DESILETS = (1.0177e-2, 1.0207e-1, -3.9527e-1, (8.5236e-6, -6.3670e-7, -7.0814e-9), (-9.9182e-9, 9.9250e-10, 2.4925e-11), (3.8615e-12, -4.8194e-13, -1.5371e-14))
# Coefficients of Lifton and others (2006).
LIFTON = (1.8399, -1.1854e2, -4.9420e-2, 8.0139e-1, 1.2708e-4, 9.4647e-1, -3.2208e-2, 1.2688)


def desilets_scaling(hpa: Column, rigidity: Column) -> Column:
    """Desilets and others (2006); rigidity is held at 2 GV below that."""
    r, x, sea = F.greatest(rigidity, F.lit(2.0)), hpa * 1.019716, 1033.0

    def integral(depth: Column) -> Column:
        n, alpha, k, *rows = DESILETS
        total = depth * n / (1 + F.exp(F.pow(r, F.lit(-k)) * -alpha))
        for power, (a, b, c) in enumerate(rows, 2):
            total = total + (r * b + r * r * c + a) * F.pow(depth, F.lit(power)) / power
        return total

    # The mean attenuation over the air between cancels out against the depth difference.
    return (1 - F.exp(F.pow(r, F.lit(-0.9615)) * -10.275)) * F.exp(integral(F.lit(sea)) - integral(x))


def lifton_scaling(hpa: Column, rigidity: Column, modulation: float = 0.95) -> Column:
    """Lifton and others (2006); rigidity is held at 1.907 GV below that."""
    r, x, c, s = F.greatest(rigidity, F.lit(1.907)), hpa * 1.019716, LIFTON, modulation
    solar = F.exp(F.lit(c[1] * s) / F.pow(r + 5 * s, F.lit(2 * s))) * -s
    return F.exp(F.log(x * s) * c[0] + solar + F.pow(x, F.lit(c[3])) * c[2] + F.pow((r + 4 * s) * x, F.lit(c[5])) * c[4] + F.pow(r + 4 * s, F.lit(c[7])) * c[6])


def accumulated(nodes: DataFrame, local: DataFrame) -> DataFrame:
    """``node, conc, flux``: the concentration of what leaves each node, from each node's own concentration and rate of erosion (node, conc, rate)."""
    from catena.operators.flow import accumulate

    joined = nodes.join(local.select("node", (F.col("conc") * F.col("rate")).alias("__q"), F.col("rate").alias("__e")), "node")
    out = accumulate(joined, {"atoms": F.col("__q"), "flux": F.col("__e")})
    return out.select("node", F.when(F.col("flux") > 0, F.col("atoms") / F.col("flux")).alias("conc"), "flux")


def nested_erosion(cells: DataFrame, samples: DataFrame, nesting: DataFrame, nuclide: str = "be10") -> DataFrame:
    """``basin, erosion``: of each sampled basin without the sampled basins directly inside it.

    What the inner basins deliver (their production over their own rate) is taken from the whole; ``nesting`` has
    outlet, inside, depth, of which depth 1 is the direct one.  Null where nothing is left.
    """
    whole = basin_erosion(cells, samples, nuclide).select("basin", "erosion", F.col("n_cells").cast("double").alias("n"))
    inner = nesting.where("depth = 1").select(F.col("outlet").alias("basin"), F.col("inside"))
    parts = inner.join(whole.select(F.col("basin").alias("inside"), (F.col("erosion") * F.col("n")).alias("flux"), F.col("n").alias("m")), "inside").groupBy("basin").agg(F.sum("flux").alias("flux"), F.sum("m").alias("m"))
    j = whole.join(parts, "basin", "left").fillna(0.0, ["flux", "m"])
    left = F.col("n") - F.col("m")
    return j.select("basin", F.when(left > 0, (F.col("erosion") * F.col("n") - F.col("flux")) / left).alias("erosion"))


def steady_concentration(erosion: Column, nuclide: str = "be10", scaling: Column | float = 1.0, depth: float = 0.0) -> Column:
    """Atoms/g at an effective depth (g/cm^2) under steady erosion (g/cm^2/yr)."""
    total = F.lit(0.0)
    for share, gamma in zip(SHARES[nuclide], ATTENUATION, strict=True):
        if share:
            total = total + F.lit(share * math.exp(-depth / gamma)) / (erosion / gamma + DECAY[nuclide])
    return total * PRODUCTION[nuclide] * scaling


def step_concentration(before: Column, years: Column, erosion: Column, nuclide: str = "be10", scaling: Column | float = 1.0) -> Column:
    """Surface concentration after some years of new erosion, from an initial one that decays and erodes."""
    lam = DECAY[nuclide]
    total = F.lit(0.0)
    for share, gamma in zip(SHARES[nuclide], ATTENUATION, strict=True):
        if share:
            rate = erosion / gamma + lam
            total = total + F.lit(share) / rate * (1 - F.exp(-rate * years))
    return before * F.exp(-years * lam) + total * PRODUCTION[nuclide] * scaling


def apparent_erosion(samples: DataFrame, concentration: str, scaling: str, nuclide: str = "be10", name: str = "erosion") -> DataFrame:
    """The steady erosion that gives each sample's concentration, by Newton's method on all rows of a batch at once."""
    shares = [(s, g) for s, g in zip(SHARES[nuclide], ATTENUATION, strict=True) if s]
    lam, p0 = DECAY[nuclide], PRODUCTION[nuclide]

    @F.pandas_udf("double")
    def solve(n: pd.Series, k: pd.Series) -> pd.Series:
        goal, top = n.to_numpy(dtype=float), p0 * k.to_numpy(dtype=float)
        # In the logarithm of the rate the function is smooth and monotone.
        u = np.log(np.maximum(1e-12, 160.0 * (top / goal - lam)))
        for _ in range(40):
            e = np.exp(u)
            f = sum(top * s / (e / g + lam) for s, g in shares) - goal
            df = sum(-top * s / (e / g + lam) ** 2 / g for s, g in shares) * e
            u = u - np.clip(f / df, -2, 2)
        return pd.Series(np.exp(u))

    return samples.withColumn(name, solve(F.col(concentration).cast("double"), F.col(scaling).cast("double")))


def snow_depth_linear(elevation: Column, low: float, slope: float, high: float) -> Column:
    """Effective snow depth that rises with height between bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), elevation * slope + low))


def snow_depth_richards(elevation: Column, growth: float, middle: float, most: float, shape: float) -> Column:
    return F.lit(most) * F.pow(1 + F.exp(-(elevation - middle) * growth) * (shape - 1), F.lit(1 / (1 - shape)))


def shielding_of_depth(depth: Column, gamma: float = 160.0) -> Column:
    """Mean production over a slab of some effective depth relative to the surface; 1 for none."""
    return F.when(depth > 0, (1 - F.exp(-depth / gamma)) * gamma / depth).otherwise(1.0)


def basin_erosion(cells: DataFrame, samples: DataFrame, nuclide: str = "be10") -> DataFrame:
    """One erosion rate a basin: the mean production of its cells (basin, scaling) against the sample's concentration."""
    mean = cells.groupBy("basin").agg(F.avg("scaling").alias("scaling"), F.count("*").alias("n_cells"))
    return apparent_erosion(samples.join(mean, "basin"), "concentration", "scaling", nuclide)
