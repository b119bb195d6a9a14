"""Map projections as column expressions, on the WGS84 ellipsoid unless told otherwise."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Semi-axis and flattening of WGS84, scale and offsets of UTM.
A, INV_F = 6378137.0, 298.257223563
K0, EAST0, SOUTH0 = 0.9996, 500000.0, 10000000.0


def utm_zone(longitude: Column) -> Column:
    return F.least(F.lit(60), F.floor((longitude + 180) / 6) + 1).cast("int")


def _e2(inv_f: float = INV_F) -> float:
    f = 1 / inv_f
    return f * (2 - f)


def _meridian(lat: Column, a: float, e2: float) -> Column:
    """Length of the meridian from the equator, lat in radians."""
    c0, c2 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    c4, c6 = 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072
    return (lat * c0 - F.sin(lat * 2) * c2 + F.sin(lat * 4) * c4 - F.sin(lat * 6) * c6) * a


def to_utm(latitude: Column, longitude: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in the zone of the longitude, or in a given one; degrees."""
    zone = zone if zone is not None else utm_zone(longitude)
    e2 = _e2()
    ep = e2 / (1 - e2)
    lat = F.radians(latitude)
    lon0 = (zone - 1) * 6 - 180 + 3
    t, c = F.tan(lat) * F.tan(lat), F.cos(lat) * F.cos(lat) * ep
    n = F.lit(A) / F.sqrt(1 - F.sin(lat) * F.sin(lat) * e2)
    q = F.radians(longitude - lon0) * F.cos(lat)
    east = n * (q + (1 - t + c) * q * q * q / 6 + (5 - t * 18 + t * t + c * 72 - 58 * ep) * q * q * q * q * q / 120) * K0 + EAST0
    north = (_meridian(lat, A, e2) + n * F.tan(lat) * (q * q / 2 + (5 - t + c * 9 + c * c * 4) * q * q * q * q / 24 + (61 - t * 58 + t * t + c * 600 - 330 * ep) * q * q * q * q * q * q / 720)) * K0
    return east, north + F.when(latitude < 0, SOUTH0).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    e2 = _e2()
    ep, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    x, y = east - EAST0, north - F.when(south, SOUTH0).otherwise(0.0)
    mu = y / K0 / (A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = mu + F.sin(mu * 2) * (3 * e1 / 2 - 27 * e1**3 / 32) + F.sin(mu * 4) * (21 * e1**2 / 16 - 55 * e1**4 / 32) + F.sin(mu * 6) * (151 * e1**3 / 96)
    s2 = F.sin(foot) * F.sin(foot) * e2
    n = F.lit(A) / F.sqrt(1 - s2)
    r = F.lit(A * (1 - e2)) / ((1 - s2) * F.sqrt(1 - s2))
    t, c, d = F.tan(foot) * F.tan(foot), F.cos(foot) * F.cos(foot) * ep, x / (n * K0)
    lat = foot - n * F.tan(foot) / r * (d * d / 2 - (5 + t * 3 + c * 10 - c * c * 4 - 9 * ep) * d * d * d * d / 24 + (61 + t * 90 + c * 298 + t * t * 45 - 252 * ep - c * c * 3) * d * d * d * d * d * d / 720)
    lon = (d - (1 + t * 2 + c) * d * d * d / 6 + (5 - c * 2 + t * 28 - c * c * 3 + 8 * ep + t * t * 24) * d * d * d * d * d / 120) / F.cos(foot)
    return F.degrees(lat), F.degrees(lon) + (zone - 1) * 6 - 180 + 3


def to_geocentric(latitude: Column, longitude: Column, height: Column, a: float = A, inv_f: float = INV_F) -> tuple[Column, Column, Column]:
    e2 = _e2(inv_f)
    lat, lon = F.radians(latitude), F.radians(longitude)
    n = F.lit(a) / F.sqrt(1 - F.sin(lat) * F.sin(lat) * e2)
    return (n + height) * F.cos(lat) * F.cos(lon), (n + height) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + height) * F.sin(lat)


def from_geocentric(x: Column, y: Column, z: Column, a: float = A, inv_f: float = INV_F, rounds: int = 5) -> tuple[Column, Column, Column]:
    e2 = _e2(inv_f)
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - e2))
    for _ in range(rounds):
        n = F.lit(a) / F.sqrt(1 - F.sin(lat) * F.sin(lat) * e2)
        lat = F.atan2(z + n * F.sin(lat) * e2, p)
    n = F.lit(a) / F.sqrt(1 - F.sin(lat) * F.sin(lat) * e2)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


def shift_datum(x: Column, y: Column, z: Column, move: tuple[float, float, float], ppm: float, seconds: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """A small similarity transform of geocentric coordinates."""
    s = 1 + ppm / 1e6
    rx, ry, rz = (math.radians(v / 3600) for v in seconds)
    return x * s - y * rz + z * ry + move[0], x * rz + y * s - z * rx + move[1], x * -ry + y * rx + z * s + move[2]


def _q(lat: float | Column, e2: float) -> float | Column:
    """The authalic function of a latitude in radians (Snyder 1987, 3-12)."""
    f = math if isinstance(lat, float) else F
    s = f.sin(lat)
    if not e2:
        return s * 2
    e = math.sqrt(e2)
    return (s / (1 - s * s * e2) - f.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e2)


def _t(lat: float | Column, e2: float) -> float | Column:
    """The conformal function of a latitude in radians (Snyder 1987, 15-9)."""
    f = math if isinstance(lat, float) else F
    e, s = math.sqrt(e2), f.sin(lat)
    return f.tan(math.pi / 4 - lat / 2 if f is math else lat / -2 + math.pi / 4) / f.pow((1 - s * e) / (1 + s * e), e / 2 if f is math else F.lit(e / 2))


def _m(lat: float, e2: float) -> float:
    return math.cos(lat) / math.sqrt(1 - e2 * math.sin(lat) ** 2)


def _albers_terms(lat1: float, lat2: float, lat0: float, a: float, e2: float) -> tuple[float, float, float]:
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    m1, m2 = _m(p1, e2), _m(p2, e2)
    n = (m1 * m1 - m2 * m2) / (_q(p2, e2) - _q(p1, e2)) if lat1 != lat2 else math.sin(p1)
    c = m1 * m1 + n * _q(p1, e2)
    return n, c, a * math.sqrt(c - n * _q(p0, e2)) / n


def albers(latitude: Column, longitude: Column, lat1: float, lat2: float, lat0: float, lon0: float, a: float = A, inv_f: float | None = INV_F) -> tuple[Column, Column]:
    """Equal-area conic with two standard parallels on an ellipsoid (``inv_f`` None: on the sphere of the semi-axis)."""
    e2 = _e2(inv_f) if inv_f else 0.0
    n, c, rho0 = _albers_terms(lat1, lat2, lat0, a, e2)
    rho = F.sqrt(F.lit(c) - _q(F.radians(latitude), e2) * n) * (a / n)
    theta = F.radians(longitude - lon0) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def albers_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, a: float = A, inv_f: float | None = INV_F) -> tuple[Column, Column]:
    """Latitudes come from the series of the authalic latitude and a step of Newton's method (Snyder 1987, 3-18 and 3-16)."""
    e2 = _e2(inv_f) if inv_f else 0.0
    n, c, rho0 = _albers_terms(lat1, lat2, lat0, a, e2)
    down = F.lit(rho0) - y
    rho = F.sqrt(x * x + down * down)
    q = (F.lit(c) - rho * rho * (n * n / a**2)) / n
    beta = F.asin(q / _q(math.pi / 2, e2))
    lat = beta + F.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) + F.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780) + F.sin(beta * 6) * (761 * e2**3 / 45360)
    s2 = 1 - F.sin(lat) * F.sin(lat) * e2
    lat = lat + (q - _q(lat, e2)) * s2 * s2 / (F.cos(lat) * (2 * (1 - e2)))
    return F.degrees(lat), F.degrees(F.atan2(x, down)) / n + lon0


def _lambert_terms(lat1: float, lat2: float, lat0: float, a: float, e2: float) -> tuple[float, float, float]:
    p1, p2, p0 = (math.radians(v) for v in (lat1, lat2, lat0))
    n = (math.log(_m(p1, e2)) - math.log(_m(p2, e2))) / (math.log(_t(p1, e2)) - math.log(_t(p2, e2))) if lat1 != lat2 else math.sin(p1)
    f = _m(p1, e2) / (n * _t(p1, e2) ** n)
    return n, a * f, a * f * _t(p0, e2) ** n


def lambert(latitude: Column, longitude: Column, lat1: float, lat2: float, lat0: float, lon0: float, a: float = A, inv_f: float | None = INV_F) -> tuple[Column, Column]:
    """Conformal conic with two standard parallels on an ellipsoid (``inv_f`` None: on the sphere of the semi-axis)."""
    e2 = _e2(inv_f) if inv_f else 0.0
    n, af, rho0 = _lambert_terms(lat1, lat2, lat0, a, e2)
    rho = F.pow(_t(F.radians(latitude), e2), F.lit(n)) * af
    theta = F.radians(longitude - lon0) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def lambert_inverse(x: Column, y: Column, lat1: float, lat2: float, lat0: float, lon0: float, a: float = A, inv_f: float | None = INV_F) -> tuple[Column, Column]:
    """Latitudes come from the series of the conformal latitude and a step of the exact equation (Snyder 1987, 3-5 and 7-9)."""
    e2 = _e2(inv_f) if inv_f else 0.0
    n, af, rho0 = _lambert_terms(lat1, lat2, lat0, a, e2)
    down = F.lit(rho0) - y
    rho = F.sqrt(x * x + down * down) * (1 if n > 0 else -1)
    t, e = F.pow(rho / af, F.lit(1 / n)), math.sqrt(e2)
    chi = F.atan(t) * -2 + math.pi / 2
    lat = chi + F.sin(chi * 2) * (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) + F.sin(chi * 4) * (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) + F.sin(chi * 6) * (7 * e2**3 / 120 + 81 * e2**4 / 1120) + F.sin(chi * 8) * (4279 * e2**4 / 161280)
    lat = F.atan(t * F.pow((1 - F.sin(lat) * e) / (1 + F.sin(lat) * e), F.lit(e / 2))) * -2 + math.pi / 2
    return F.degrees(lat), F.degrees(F.atan2(x, down)) / n + lon0


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def angle_between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Radians between two vectors."""
    cos = (x1 * x2 + y1 * y2) / F.sqrt((x1 * x1 + y1 * y1) * (x2 * x2 + y2 * y2))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))


# The Airy 1830 ellipsoid, the British grid's projection, and the shift from its datum to WGS84.
AIRY = (6377563.396, 299.3249646)
BRITISH = {"k0": 0.9996012717, "lat0": 49.0, "lon0": -2.0, "east0": 400000.0, "north0": -100000.0}
BRITISH_SHIFT = ((446.448, -125.157, 542.060), -20.4894, (0.1502, 0.2470, 0.8421))


def from_british_grid(east: Column, north: Column) -> Column:
    """A struct of ``lat`` and ``lon`` (WGS84, to a few metres) of British National Grid coordinates.

    The inverse iterates, which as one nested expression would grow with every round; batches of rows run through arrays.
    """
    return F.pandas_udf(_from_british_grid, "lat double, lon double")(east, north)


def _from_british_grid(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    (a, inv_f), k0 = AIRY, BRITISH["k0"]
    e2 = _e2(inv_f)
    ep = e2 / (1 - e2)
    goal = (north.to_numpy(dtype=float) - BRITISH["north0"]) / k0 + _meridian_number(math.radians(BRITISH["lat0"]), a, e2)
    foot = goal / a
    for _ in range(8):
        foot = foot + (goal - _meridian_number(foot, a, e2)) / a
    s2 = np.sin(foot) ** 2 * e2
    n, r = a / np.sqrt(1 - s2), a * (1 - e2) / (1 - s2) ** 1.5
    t, c, d = np.tan(foot) ** 2, np.cos(foot) ** 2 * ep, (east.to_numpy(dtype=float) - BRITISH["east0"]) / (n * k0)
    lat = foot - n * np.tan(foot) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24)
    lon = (d - (1 + 2 * t + c) * d**3 / 6) / np.cos(foot) + math.radians(BRITISH["lon0"])
    n = a / np.sqrt(1 - np.sin(lat) ** 2 * e2)
    x, y, z = n * np.cos(lat) * np.cos(lon), n * np.cos(lat) * np.sin(lon), n * (1 - e2) * np.sin(lat)
    move, ppm, seconds = BRITISH_SHIFT
    (rx, ry, rz), s = (math.radians(v / 3600) for v in seconds), 1 + ppm / 1e6
    x, y, z = x * s - y * rz + z * ry + move[0], x * rz + y * s - z * rx + move[1], -x * ry + y * rx + z * s + move[2]
    e2, p = _e2(), np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e2))
    for _ in range(6):
        lat = np.arctan2(z + A / np.sqrt(1 - np.sin(lat) ** 2 * e2) * np.sin(lat) * e2, p)
    return pd.DataFrame({"lat": np.degrees(lat), "lon": np.degrees(np.arctan2(y, x))})


def _meridian_number(lat, a: float, e2: float):  # noqa: ANN001, ANN202
    c0, c2 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    c4, c6 = 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072
    return a * (c0 * lat - c2 * np.sin(2 * lat) + c4 * np.sin(4 * lat) - c6 * np.sin(6 * lat))
