"""Statistics by group: summaries, outliers, bins, regressions, rank tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(column: str, p: float) -> Column:
    """Linear interpolation between ranks, p from 0 to 1."""
    return F.percentile(F.col(column), F.lit(p))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, extremes, quartiles, mean, deviation, standard error and median absolute deviation of each group."""
    first = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("minimum"), percentile(value, 0.25).alias("q1"), percentile(value, 0.5).alias("median"), percentile(value, 0.75).alias("q3"), F.max(value).alias("maximum"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("se"),
    )
    return first.join(mad(df, keys, value), keys)


def mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median absolute deviation from the group's median."""
    middle = df.groupBy(*keys).agg(percentile(value, 0.5).alias("__m"))
    away = df.join(middle, keys).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return away.groupBy(*keys).agg(percentile("__d", 0.5).alias("mad"))


def modified_z(df: DataFrame, keys: list[str], value: str, bound: float = 3.5) -> DataFrame:
    """0.6745 deviations in units of the median absolute deviation; an outlier is beyond ``bound``."""
    middle = df.groupBy(*keys).agg(percentile(value, 0.5).alias("__m"))
    z = F.when(F.col("mad") > 0, (F.col(value) - F.col("__m")) * 0.6745 / F.col("mad"))
    out = df.join(middle, keys).join(mad(df, keys, value), keys).withColumn("mzs", z)
    return out.withColumn("outlier", F.coalesce(F.abs("mzs") > bound, F.lit(False))).drop("__m", "mad")


def histogram(df: DataFrame, value: str, width: float, lower: float = 0.0) -> DataFrame:
    """Count and share of each bin ``lower + i * width <= v < lower + (i + 1) * width``."""
    b = F.floor((F.col(value) - lower) / width).cast("long")
    out = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return out.select("bin", (F.col("bin") * width + lower).alias("lower"), ((F.col("bin") + 1) * width + lower).alias("upper"), "n", (F.col("n") / total).alias("density"))


def linear_bins(df: DataFrame, x: str, y: str, width: float, lower: float = 0.0) -> DataFrame:
    """Mean and deviation of x and y by bins of x; x = 0 is left out."""
    b = F.floor((F.col(x) - lower) / width).cast("long")
    return df.where(F.col(x) != 0).groupBy(b.alias("bin")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_pop(y).alias("sd_y"), F.count("*").alias("n"))


def log_bins(df: DataFrame, x: str, y: str, width: float, lower: float = 0.0) -> DataFrame:
    """As ``linear_bins`` by log10 x, for x above 0."""
    b = F.floor((F.log10(x) - lower) / width).cast("long")
    return df.where(F.col(x) > 0).groupBy(b.alias("bin")).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_pop(y).alias("sd_y"), F.count("*").alias("n"))


def drop_small_bins(bins: DataFrame, share: float) -> DataFrame:
    """Bins with at least ``share`` of all observations."""
    return bins.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).where(F.col("share") >= share)


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares by group."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def durbin_watson(df: DataFrame, keys: list[str], x: str, y: str, order: list[str]) -> DataFrame:
    """Autocorrelation of the residuals (predicted minus observed) in order, by group."""
    r = df.join(regression(df, keys, x, y).select(*keys, "slope", "intercept"), keys).withColumn("r", F.col("slope") * F.col(x) + F.col("intercept") - F.col(y))
    step = F.col("r") - F.lag("r").over(Window.partitionBy(*keys).orderBy(*order))
    r = r.withColumn("d", step)
    return r.groupBy(*keys).agg((F.sum(F.col("d") * F.col("d")) / F.sum(F.col("r") * F.col("r"))).alias("durbin_watson"))


def orthogonal_regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The line of least perpendicular distance."""
    a = df.groupBy(*keys).agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    d = F.col("yy") - F.col("xx")
    slope = F.when(F.col("xy") != 0, (d + F.sqrt(d * d + 4 * F.col("xy") * F.col("xy"))) / (2 * F.col("xy")))
    return a.select(*keys, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def mid_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks where ties share the middle of their places.

    Ranks over the whole table come from counts by distinct value, so that rows don't meet in one task.
    """
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*keys, value, (F.coalesce(before, F.lit(0)) + (F.col("__n") + 1) / 2).alias("rank"), F.col("__n").alias("ties"))
    return df.join(ranks, [*keys, value])


def mann_whitney(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """U of both groups and z with the correction for ties."""
    both = mid_ranks(df.where(F.col(group).isin(a, b)), value)
    ties = both.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    n = lambda g: F.sum(F.when(F.col(group) == g, 1).otherwise(0))
    s = both.agg(n(a).cast("double").alias("na"), n(b).cast("double").alias("nb"), F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("ra"))
    s = s.join(F.broadcast(ties)).withColumn("u_a", F.col("ra") - F.col("na") * (F.col("na") + 1) / 2).withColumn("u_b", F.col("na") * F.col("nb") - F.col("u_a"))
    total = F.col("na") + F.col("nb")
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    return s.select("na", "nb", "u_a", "u_b", ((F.least("u_a", "u_b") - F.col("na") * F.col("nb") / 2) / sd).alias("z"))


def ks_distance(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """The largest distance between the distribution functions of two groups."""
    counts = df.where(F.col(group).isin(a, b)).groupBy(value).agg(F.sum(F.when(F.col(group) == a, 1).otherwise(0)).alias("ca"), F.sum(F.when(F.col(group) == b, 1).otherwise(0)).alias("cb"))
    upto, every = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    gap = F.abs(F.sum("ca").over(upto) / F.sum("ca").over(every) - F.sum("cb").over(upto) / F.sum("cb").over(every))
    return counts.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))


def kolmogorov_probability(lam: float, terms: int = 100) -> float:
    """Chance of a larger scaled distance."""
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, terms + 1))
    return min(1.0, max(0.0, total))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution, by bisection of the error function."""
    lo, hi = -12.0, 12.0
    for _ in range(120):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def normal_p_value(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def quantile_points(df: DataFrame, value: str, n: int) -> DataFrame:
    """Quantiles at i / (n + 1), with those of a normal distribution of the same mean and deviation."""
    ps = [i / (n + 1) for i in range(1, n + 1)]
    s = df.agg(F.percentile(F.col(value), F.array(*[F.lit(p) for p in ps])).alias("q"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = F.array(*[F.lit(normal_quantile(p)) for p in ps])
    return s.select("m", "s", F.posexplode("q").alias("i", "quantile"), z.alias("z")).select((F.col("i") + 1).alias("i"), "quantile", (F.col("m") + F.col("s") * F.element_at("z", F.col("i") + 1)).alias("normal_quantile"))


def gaussian_density(df: DataFrame, keys: list[str], value: str, bandwidth: float | None = None) -> DataFrame:
    """Kernel density at each value of a group; Silverman's bandwidth unless given."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(rows[value].to_numpy(dtype=np.float64))
        h = bandwidth or max(1e-9, 1.06 * x.std() * len(x) ** -0.2)
        out = np.empty(len(x))
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            # Beyond 8 bandwidths a value adds nothing that a double can hold beside the rest.
            a, b = np.searchsorted(x, part[0] - 8 * h), np.searchsorted(x, part[-1] + 8 * h)
            out[lo : lo + 1024] = np.exp(-0.5 * ((part[:, None] - x[None, a:b]) / h) ** 2).sum(axis=1)
        frame = pd.DataFrame({k: [rows[k].iloc[0]] * len(x) for k in keys})
        return frame.assign(**{value: x, "density": out / (len(x) * h * math.sqrt(2 * math.pi))})

    fields = [f for f in df.schema.fields if f.name in keys]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), f"{value} double", "density double"])
    return df.select(*keys, F.col(value).cast("double")).where(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(kernel, schema)


def likelihood(residual: Column, sigma: float) -> Column:
    """Aggregate: the product of exp(-r^2 / 2 sigma^2) over rows."""
    return F.exp(-F.sum(residual * residual) / (2 * sigma * sigma))


def decimal_difference(a: str, b: str) -> Column:
    """``a - b`` without the noise of short decimals as doubles, to twelve places; as doubles where one is not finite or beyond decimals."""
    decimal = lambda c: F.col(c).cast("decimal(28,12)")
    return F.when((F.abs(a) < 1e12) & (F.abs(b) < 1e12), (decimal(a) - decimal(b)).cast("double")).otherwise(F.col(a) - F.col(b))


def decimal_sum(value: Column) -> Column:
    """Aggregate: the sum to eighteen places, the same in any order of rows; what is not finite or beyond decimals is added as doubles."""
    fits = F.abs(value) < 1e12
    rest = F.sum(F.when(~fits, value))
    return F.coalesce(F.sum(F.when(fits, value).cast("decimal(38,18)")).cast("double") + F.coalesce(rest, F.lit(0.0)), rest)


def interpolate(points: DataFrame, table: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``y`` of a table of nodes at the points' ``x`` by group: linear between nodes, constant beyond them.

    The distinct places of the points and the nodes are ordered together, once up and once down, so that both looks are running ones:
    a frame from each row to the end of its group would be read again for every row.  A point at a node finds that node both ways,
    whatever its neighbours hold.  Points meet their value by a join.
    """
    places = points.select(*keys, x).distinct().withColumns({"__node": F.lit(False), y: F.lit(None).cast("double")})
    both = places.unionByName(table.select(*keys, x, y).withColumn("__node", F.lit(True)))
    node = F.when(F.col("__node"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    running = lambda *order: F.last(node, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"__a": running(F.col(x), F.col("__node").desc()), "__b": running(F.col(x).desc(), F.col("__node").desc())}).where("NOT __node")
    share = (F.col(x) - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))
    value = F.when(F.col("__a").isNull(), F.col("__b.y")).when(F.col("__b").isNull() | (F.col("__a.x") == F.col("__b.x")), F.col("__a.y")).otherwise(F.col("__a.y") + share * (F.col("__b.y") - F.col("__a.y")))
    found = both.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, x])], value.alias("__y"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, x])]
    return points.drop(y).join(found, same, "left").select(*[c for c in points.columns if c != y], F.col("__y").alias(y))


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quadratic mean, skewness and kurtosis (3 for a normal distribution) of each group."""
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("quadratic_mean"), F.skewness(value).alias("skewness"), (F.kurtosis(value) + 3).alias("kurtosis"))


def box_plot(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, and the farthest values within one and a half quartile ranges of them."""
    q = df.groupBy(*keys).agg(percentile(value, 0.25).alias("q1"), percentile(value, 0.5).alias("median"), percentile(value, 0.75).alias("q3"))
    j = df.join(q, keys)
    span = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.min(F.when(F.col(value) >= F.col("q1") - span, F.col(value))), F.max(F.when(F.col(value) <= F.col("q3") + span, F.col(value)))
    return j.groupBy(*keys, "q1", "median", "q3").agg(low.alias("whisker_low"), high.alias("whisker_high"))


def bootstrap_regression(df: DataFrame, keys: list[str], x: str, y: str, row: str, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Mean and deviation of slope and intercept over resamples, from counts drawn for each row (named by ``row``) and round.

    Rows draw Poisson weights (mean 1) by a hash, the usual stand-in for drawing rows when they are spread over a cluster.
    """
    draws = df.select(*keys, F.col(row).alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("__r"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "__r", "__i").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    w = sum((F.when(u > s, 1.0).otherwise(0.0) for s in poisson_steps()), F.lit(0.0))
    m = draws.withColumn("__w", w).groupBy(*keys, "__r").agg(*[F.sum(F.col("__w") * e).alias(n) for n, e in (("n", F.lit(1.0)), ("sx", F.col("__x")), ("sy", F.col("__y")), ("xx", F.col("__x") * F.col("__x")), ("xy", F.col("__x") * F.col("__y")))])
    d = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx")
    fit = m.withColumn("slope", F.when(d > 0, (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / d)).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    return fit.groupBy(*keys).agg(F.avg("slope").alias("slope"), F.stddev_pop("slope").alias("slope_sd"), F.avg("intercept").alias("intercept"), F.stddev_pop("intercept").alias("intercept_sd"))


def poisson_steps(most: int = 7) -> list[float]:
    """The distribution function of a Poisson count of mean 1 at 0, 1, .."""
    steps, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return steps


def peaks(df: DataFrame, keys: list[str], order: str, value: str, above: float, apart: int) -> DataFrame:
    """Rows higher than both neighbours and than ``above``; of peaks up to ``apart`` rows from a higher one only the higher stays.

    From the highest down, each peak drops those near it; of equal ones the later is taken first.  ``order`` counts rows of a group.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rising, falling = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    found = df.withColumns({"__up": rising, "__down": falling}).where((F.col("__up") > 0) & (F.col("__down") < 0) & (F.col(value) > above)).select(*keys, order, value)

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        at, height = rows[order].to_numpy(), rows[value].to_numpy()
        kept = np.ones(len(at), dtype=bool)
        for i in np.lexsort((at, height))[::-1]:
            if kept[i]:
                lo, hi = np.searchsorted(at, at[i] - apart), np.searchsorted(at, at[i] + apart, side="right")
                kept[lo:hi] = False
                kept[i] = True
        return rows[kept]

    return found.groupBy(*keys).applyInPandas(keep, found.schema)


def erfi(x: Column, terms: int = 60) -> Column:
    """The imaginary error function, by its power series; for arguments up to about 4."""
    total = F.lit(0.0)
    for n in reversed(range(terms)):
        total = x * x * total + 1.0 / (math.factorial(n) * (2 * n + 1))
    return x * total * (2 / math.sqrt(math.pi))


def sample_rows(df: DataFrame, n: int, *order: str, seed: int = 1) -> DataFrame:
    """``n`` rows without replacement, the same each run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *order).cast("binary")), *order).limit(n)
