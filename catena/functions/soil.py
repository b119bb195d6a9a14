"""Slope stability, wetness and vegetation expressions."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wetness_index(area: Column, slope: Column) -> Column:
    """ln(a / tan slope), slope in radians; null in flats."""
    return F.when(F.tan(slope) > 0, F.log(area / F.tan(slope)))


def relative_wetness(recharge: Column, transmissivity: Column, area: Column, slope: Column) -> Column:
    """Depth of the water table relative to the soil, at most 1."""
    return F.least(F.lit(1.0), recharge * area / (transmissivity * F.sin(slope)))


def factor_of_safety(cohesion: Column, wetness: Column, density_ratio: float, slope: Column, friction: Column) -> Column:
    """Infinite slope: strength over load; angles in radians, cohesion relative to the soil's weight."""
    return (cohesion + F.cos(slope) * (1 - wetness * density_ratio) * F.tan(friction)) / F.sin(slope)


def saturation_supply(transmissivity: Column, area: Column, slope: Column) -> Column:
    """The steady rain that saturates the soil."""
    return transmissivity * F.sin(slope) / area


def stability_index(*columns: Column) -> Column:
    """See ``_stability`` for the columns."""
    return F.pandas_udf(_stability, "double")(*columns)


def _stability(slope: pd.Series, area: pd.Series, c_low: pd.Series, c_high: pd.Series, t_low: pd.Series, t_high: pd.Series, r_low: pd.Series, r_high: pd.Series) -> pd.Series:
    """Chance that the factor of safety exceeds 1 with cohesion, tan friction and recharge/transmissivity uniform between bounds.

    If even the worst case is stable, its factor of safety.  The chance is a midpoint sum over a grid of the three.
    """
    ratio, steps = 0.5, (np.arange(20) + 0.5) / 20
    s, a = slope.to_numpy(dtype=float)[:, None], area.to_numpy(dtype=float)[:, None]
    span = lambda lo, hi: lo.to_numpy(dtype=float)[:, None] + (hi - lo).to_numpy(dtype=float)[:, None] * steps
    c, t, r = span(c_low, c_high), span(t_low, t_high), span(r_low, r_high)
    with np.errstate(all="ignore"):
        wet = np.minimum(1, r * a / np.sin(s))
        fs = (c[:, :, None, None] + np.cos(s)[:, :, None, None] * (1 - wet[:, None, None, :] * ratio) * t[:, None, :, None]) / np.sin(s)[:, :, None, None]
        worst = (c_low.to_numpy(dtype=float) + np.cos(s[:, 0]) * (1 - np.minimum(1, r_high.to_numpy(dtype=float) * a[:, 0] / np.sin(s[:, 0])) * ratio) * t_low.to_numpy(dtype=float)) / np.sin(s[:, 0])
    return pd.Series(np.where(worst > 1, np.minimum(worst, 10), (fs > 1).mean(axis=(1, 2, 3))))


def stream_power(area: Column, slope: Column, theta: float = 0.5) -> Column:
    """Steepness normalised by area."""
    return slope * F.pow(area, F.lit(theta))


def steady_slope(uplift: float, erodibility: float, area: Column, m: float, n: float) -> Column:
    """The slope at which incision balances uplift."""
    return F.pow(F.lit(uplift / erodibility) / F.pow(area, F.lit(m)), F.lit(1 / n))


