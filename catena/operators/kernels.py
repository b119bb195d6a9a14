"""Numerical kernels by channel or basin: segmentation, denoising, sampling of concavity.

Each runs on the ordered nodes of one channel as numpy arrays.  Channels are dealt to tasks by their key and stream through
them one after another (``by_channel``), so a task holds the longest channel and a batch, however many channels there are; one channel is
always the work of one task, as its nodes depend on each other.
"""

from __future__ import annotations

import math

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def by_channel(profile: DataFrame, columns: list[str], kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Apply a kernel to the columns of each channel in the order of ``pos``; it returns the columns of ``schema`` but ``source_key``.

    All columns are numbers.  Batches are cut where the channel changes; what a batch begins is kept until the channel ends.
    """
    names = list(dict.fromkeys(["source_key", "pos", *columns]))
    result = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def flush(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows["source_key"].to_numpy()
            arrays = {n: rows[n].to_numpy() for n in names}
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            out = [kernel({n: a[lo:hi] for n, a in arrays.items()}) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            size = [len(next(iter(o.values()))) for o in out]
            return pd.DataFrame({"source_key": np.repeat(keys[cuts[:-1]], size)} | {n: np.concatenate([o[n] for o in out]) for n in result if n != "source_key"})[result]

        for batch in batches:
            if not len(batch):
                continue
            kept.append(batch)
            keys = batch["source_key"].to_numpy()
            if keys[-1] == kept[0]["source_key"].iloc[0]:
                continue
            rows = pd.concat(kept)
            ends = int(np.flatnonzero(rows["source_key"].to_numpy() != keys[-1])[-1]) + 1
            yield flush(rows.iloc[:ends])
            kept = [rows.iloc[ends:]]
        if kept:
            yield flush(pd.concat(kept))

    rows = profile.select(*names).repartition("source_key").sortWithinPartitions("source_key", "pos")
    return rows.mapInPandas(run, schema)


def total_variation(y: np.ndarray, lam: float) -> np.ndarray:
    """The minimiser of half the squared distance to y plus ``lam`` times the total variation, exactly.

    The running sum of the solution is the shortest path (taut string) through a tube of radius ``lam`` around the
    running sum of y; the string is followed by its lower and upper hulls.
    """
    n = len(y)
    if n == 0 or lam <= 0:
        return y.astype(float).copy()
    total = np.concatenate([[0.0], np.cumsum(y, dtype=float)])
    low, high = total - lam, total + lam
    low[0] = high[0] = total[0]
    low[-1] = high[-1] = total[-1]
    out = np.empty(n)
    knot, level = 0, total[0]
    while knot < n:
        up, down = math.inf, -math.inf
        up_at = down_at = knot
        i = knot + 1
        while True:
            a, b = (high[i] - level) / (i - knot), (low[i] - level) / (i - knot)
            if a < down:
                end, slope = down_at, down
                level = low[end]
                break
            if b > up:
                end, slope = up_at, up
                level = high[end]
                break
            if a <= up:
                up, up_at = a, i
            if b >= down:
                down, down_at = b, i
            if i == n:
                end, slope = n, (total[n] - level) / (n - knot)
                level = total[n]
                break
            i += 1
        out[knot:end] = slope
        knot = end
    return out


def denoise(profile: DataFrame, value: str, lam: float) -> DataFrame:
    """``source_key, pos, node, denoised`` of each channel."""

    def kernel(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"pos": rows["pos"], "node": rows["node"], "denoised": total_variation(rows[value].astype(float), lam)}

    return by_channel(profile, ["node", value], kernel, "source_key long, pos long, node long, denoised double")


#: Nodes up to which the costs of all segments are held as one square array.
SQUARE = 600


def best_segments(x: np.ndarray, y: np.ndarray, sigma: float, least: int, most: int, square: int = SQUARE) -> list[tuple[int, int, float, float]]:
    """Straight segments (first, end, slope, intercept) of least corrected information criterion.

    All fits come from running sums; the best cut for each number of segments by dynamic programming.  Long channels are gone
    through end by end, in memory in proportion to their length; the result is the same.
    """
    n = len(x)
    s = [np.concatenate([[0.0], np.cumsum(v)]) for v in (np.ones(n), x, y, x * x, x * y, y * y)]

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost, slope and intercept of the line through the nodes from i to j - 1."""
        m, sx, sy, sxx, sxy, syy = (v[j] - v[i] for v in s)
        with np.errstate(all="ignore"):
            d = m * sxx - sx * sx
            slope = np.where(d > 1e-12 * np.maximum(1, m * sxx), (m * sxy - sx * sy) / d, 0.0)
            start = (sy - slope * sx) / m
            cost = np.maximum(0, syy - 2 * slope * sxy - 2 * start * sy + slope * slope * sxx + 2 * slope * start * sx + m * start * start)
        return np.where(j - i >= least, cost, np.inf), slope, start

    best, back = np.full((most, n + 1), np.inf), np.zeros((most, n + 1), dtype=int)
    ends = np.arange(n + 1)
    best[0] = fit(np.zeros(n + 1, dtype=int), ends)[0]
    if n <= square:
        cost = fit(ends[:, None], ends[None, :])[0]
        for k in range(1, most):
            ways = best[k - 1][:, None] + cost
            back[k], best[k] = ways.argmin(axis=0), ways.min(axis=0)
    else:
        for j in range(least, n + 1):
            i = ends[: j - least + 1]
            ways = best[: most - 1, : j - least + 1] + fit(i, np.full(len(i), j))[0]
            at = ways.argmin(axis=1)
            back[1:, j], best[1:, j] = at, ways[np.arange(most - 1), at]
    scores = []
    for k in range(1, most + 1):
        p = 2 * k
        loss = best[k - 1][n]
        extra = 2 * p * (p + 1) / (n - p - 1) if n - p - 1 > 0 else math.inf
        scores.append(2 * p + loss / sigma**2 + extra if math.isfinite(loss) else math.inf)
    line = lambda i, j: tuple(float(v[0]) for v in fit(np.array([i]), np.array([j]))[1:])
    if not np.isfinite(scores).any():
        return [(0, n, *line(0, n))]
    out, end = [], n
    for k in range(int(np.argmin(scores)), -1, -1):
        first = int(back[k][end]) if k else 0
        out.append((first, end, *line(first, end)))
        end = first
    return out[::-1]


def rescaled_likelihood(likelihood: float, sigma: float, new: float) -> float:
    """What a likelihood that was taken with one deviation of the residuals is with another."""
    return likelihood ** (sigma * sigma / (new * new))


def segment_channels(profile: DataFrame, sigma: float, least: int = 10, most: int = 8) -> DataFrame:
    """``source_key, pos, node, m_chi, b_chi, segment`` of every channel by the best straight segments in chi."""

    def kernel(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y = rows["chi"].astype(float), rows["elevation"].astype(float)
        m, b, seg = np.empty(len(x)), np.empty(len(x)), np.empty(len(x), dtype=np.int64)
        for k, (first, end, slope, start) in enumerate(best_segments(x - x[0], y, sigma, least, most)):
            m[first:end], b[first:end], seg[first:end] = slope, start - slope * x[0], k
        return {"pos": rows["pos"], "node": rows["node"], "m_chi": m, "b_chi": b, "segment": seg}

    return by_channel(profile, ["node", "chi", "elevation"], kernel, "source_key long, pos long, node long, m_chi double, b_chi double, segment long")


def sampled_segments(profile: DataFrame, sigma: float, least: int = 5, most: int = 5, rounds: int = 20, skip: float = 2.0, seed: int = 1, target: int = 100) -> DataFrame:
    """Mean and deviation of m_chi and b_chi over fits to random thinnings of each channel, by node."""

    def kernel(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, y = rows["chi"].astype(float), rows["elevation"].astype(float)
        rng = np.random.default_rng([seed, int(rows["source_key"][0]) & 0xFFFFFFFF])
        got = [[], []]
        for _ in range(rounds):
            mean = max(skip, len(x) / target)
            at = np.unique(np.cumsum(rng.integers(1, max(2, int(2 * mean)), size=len(x))) - 1)
            at = at[at < len(x)]
            if len(at) < 2:
                at = np.arange(len(x))
            m, b = np.empty(len(x)), np.empty(len(x))
            for first, end, slope, start in best_segments(x[at], y[at], sigma, least, most):
                lo, hi = (0 if first == 0 else at[first]), (len(x) if end == len(at) else at[end])
                m[lo:hi], b[lo:hi] = slope, start
            got[0].append(m)
            got[1].append(b)
        m, b = np.array(got[0]), np.array(got[1])
        return {"node": rows["node"], "m_mean": m.mean(0), "m_sd": m.std(0), "b_mean": b.mean(0), "b_sd": b.std(0)}

    return by_channel(profile, ["source_key", "node", "chi", "elevation"], kernel, "source_key long, node long, m_mean double, m_sd double, b_mean double, b_sd double")


def concavity_chain(profile: DataFrame, key: str, area: str, dx: str, steps: int = 500, width: float = 0.05, sigma: float = 20.0, seed: int = 1) -> DataFrame:
    """``key, theta, sd, accepted``: concavity of each group by a Metropolis chain over the scatter of elevation about a line in chi."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source_key", "pos"])
        a, d, z = (rows[c].to_numpy(dtype=float) for c in (area, dx, "elevation"))
        heads = rows["source_key"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        rng = np.random.default_rng([seed, int(rows[key].iloc[0]) & 0xFFFFFFFF])

        def score(theta: float) -> float:
            c = np.cumsum(d * a**-theta)
            x = c - np.repeat(np.concatenate([[0.0], c[first[1:] - 1]]), np.diff(np.concatenate([first, [len(c)]])))
            m, b = np.polyfit(x, z, 1) if x.std() > 0 else (0.0, z.mean())
            return -((z - m * x - b) ** 2).mean() * len(first) / (2 * sigma**2)

        now, chain, taken = 0.5, [], 0
        value = score(now)
        for _ in range(steps):
            to = now + rng.normal(0, width)
            if 0.05 <= to <= 0.95 and math.log(rng.random()) < (new := score(to)) - value:
                now, value, taken = to, new, taken + 1
            chain.append(now)
        kept = np.array(chain[steps // 5 :])
        return pd.DataFrame({key: [int(rows[key].iloc[0])], "theta": [kept.mean()], "sd": [kept.std()], "accepted": [taken / steps]})

    return profile.groupBy(key).applyInPandas(kernel, f"{key} long, theta double, sd double, accepted double")
