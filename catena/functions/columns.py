"""Pore pressure in soil columns under rain, and the safety of slopes by depth (Iverson 2000)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_erfc = np.vectorize(math.erfc, otypes=[float])


def response(t: np.ndarray) -> np.ndarray:
    """Pressure head after a unit step of rain, at scaled times; 0 before."""
    with np.errstate(all="ignore"):
        s = np.maximum(t, 1e-12)
        return np.where(t > 0, np.sqrt(s / math.pi) * np.exp(-1 / s) - _erfc(1 / np.sqrt(s)), 0.0)


def pressure_head(depths: np.ndarray, t: float, rain: list[tuple[float, float]], slope: float, table: float, diffusivity: float, conductivity: float) -> np.ndarray:
    """Head at each depth at a time: steady part, and the response to each spell of rain (rate, duration), capped by the column of water above."""
    beta = math.cos(slope) ** 2
    d = 4 * diffusivity * math.cos(slope) ** 2
    head = (depths - table) * beta
    start = 0.0
    for rate, duration in rain:
        for sign, at in ((1, start), (-1, start + duration)):
            head = head + sign * depths * rate / conductivity * response((t - at) * d / np.maximum(depths, 1e-9) ** 2)
        start += duration
    return np.minimum(head, depths * beta)


def safety(depths: np.ndarray, head: np.ndarray, slope: float, cohesion: float, friction: float, soil: float = 19000.0, water: float = 9800.0) -> np.ndarray:
    """Factor of safety at each depth."""
    load = soil * depths * math.sin(slope) * math.cos(slope)
    return math.tan(friction) / math.tan(slope) + (cohesion - head * water * math.tan(friction)) / load


def lowest_safety(sites: DataFrame, rain: list[tuple[float, float]], times: list[float], depths: list[float], key: str = "site") -> DataFrame:
    """``site, time, depth, head, safety`` of the least safe depth of each site (slope, table, diffusivity, conductivity, cohesion, friction) at each time."""
    z = np.array(depths, dtype=float)

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            found = []
            for r in rows.to_dict("records"):
                for t in times:
                    head = pressure_head(z, t, rain, r["slope"], r["table"], r["diffusivity"], r["conductivity"])
                    fs = safety(z, head, r["slope"], r["cohesion"], r["friction"])
                    i = int(fs.argmin())
                    found.append((r[key], t, z[i], head[i], fs[i]))
            yield pd.DataFrame(found, columns=[key, "time", "depth", "head", "safety"])

    kind = dict(sites.dtypes)[key]
    return sites.mapInPandas(run, f"{key} {kind}, time double, depth double, head double, safety double")
