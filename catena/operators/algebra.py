"""Map algebra, masks, clips and reclassification of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: F.when(b != 0, a / b)}
FEET = 0.3048006096012192


def combine(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """``a`` and ``b`` cell by cell; nodata in either, or a division by 0, gives nodata."""
    joined = a.select("row", "col", F.col("value").alias("a")).join(b.select("row", "col", F.col("value").alias("b")), ["row", "col"])
    return joined.select("row", "col", OPERATIONS[operation](F.col("a"), F.col("b")).alias("value"))


def scale_by(cells: DataFrame, factor: float = 1.0, add: float = 0.0) -> DataFrame:
    return cells.withColumn("value", F.col("value") * factor + add)


def feet_to_metres(cells: DataFrame) -> DataFrame:
    return scale_by(cells, FEET)


def centimetres_to_metres(cells: DataFrame) -> DataFrame:
    return scale_by(cells, 0.01)


def difference_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean absolute difference and the number of differing cells, over cells with data in both."""
    d = combine(a, b, "subtract")
    return d.agg(F.avg(F.abs("value")).alias("mean_abs_diff"), F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).alias("n_different"))


def mask_below(cells: DataFrame, threshold: float) -> DataFrame:
    """Values below the threshold become nodata."""
    return cells.withColumn("value", F.when(F.col("value") >= threshold, F.col("value")))


def mask_above(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.withColumn("value", F.when(F.col("value") <= threshold, F.col("value")))


def mask_by(cells: DataFrame, other: DataFrame, threshold: float, above: bool = True, keep_unmasked: bool = False) -> DataFrame:
    """Keep values where the other grid exceeds (or is below) a threshold; nodata there masks unless ``keep_unmasked``."""
    o = other.select("row", "col", F.col("value").alias("o"))
    good = F.col("o") > threshold if above else F.col("o") < threshold
    good = F.coalesce(good, F.lit(keep_unmasked))
    return cells.join(o, ["row", "col"], "left").withColumn("value", F.when(good, F.col("value"))).drop("o")


def to_mask(cells: DataFrame, condition: Column) -> DataFrame:
    """1 where the condition holds, nodata elsewhere."""
    return cells.select("row", "col", F.when(condition, F.lit(1)).alias("value"))


def extract(cells: DataFrame, mask: DataFrame, inside: bool = True) -> DataFrame:
    """Cells inside (or outside) the data area of a mask."""
    return cells.join(mask.where("value IS NOT NULL").select("row", "col"), ["row", "col"], "left_semi" if inside else "left_anti")


def clip(cells: DataFrame, row: int, col: int, nrows: int, ncols: int) -> DataFrame:
    """A rectangle of the grid, counted anew from its own corner."""
    inside = F.col("row").between(row, row + nrows - 1) & F.col("col").between(col, col + ncols - 1)
    return cells.where(inside).withColumns({"row": F.col("row") - row, "col": F.col("col") - col})


def trim(cells: DataFrame, pad: int = 0) -> DataFrame:
    """The smallest rectangle with all data, ``pad`` cells wider, counted from its corner: first row and column stand beside."""
    data = cells.where("value IS NOT NULL")
    edge = data.agg((F.min("row") - pad).alias("row0"), (F.min("col") - pad).alias("col0"))
    # One row of two numbers.
    return data.join(F.broadcast(edge)).withColumns({"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")})


def bounds(cells: DataFrame) -> DataFrame:
    return cells.where("value IS NOT NULL").agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"), F.count("*").alias("n"))


def resample(cells: DataFrame, factor: int) -> DataFrame:
    """Coarser cells with the value at the centre of each block."""
    half = factor // 2
    centre = (F.col("row") % factor == half) & (F.col("col") % factor == half)
    return cells.where(centre).select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), "value")


def categorise(value: Column, boundaries: list[float]) -> Column:
    """The number of boundaries below the value: 0 before the first one, n beyond the last."""
    return sum((F.when(value > b, 1).otherwise(0) for b in boundaries), F.lit(0))


def rescale(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Values stretched linearly to a new minimum and maximum."""
    span = cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row of two numbers.
    scaled = F.lit(low) + (F.col("value") - F.col("lo")) * (high - low) / (F.col("hi") - F.col("lo"))
    return cells.join(F.broadcast(span)).select("row", "col", scaled.alias("value"))


def replace_cells(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Values of ``points`` (row, col, value) in place of the cells' own."""
    p = points.select("row", "col", F.col("value").alias("new"))
    return cells.join(p, ["row", "col"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first grid, with the second where it has no data."""
    both = first.select("row", "col", F.col("value").alias("a")).join(second.select("row", "col", F.col("value").alias("b")), ["row", "col"], "full")
    return both.select("row", "col", F.coalesce("a", "b").alias("value"))


def union_of(*grids: DataFrame) -> DataFrame:
    """Binary grids: 1 wherever any of them is 1."""
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out.groupBy("row", "col").agg(F.max("value").alias("value"))


def quality_of(found: DataFrame, truth: DataFrame) -> DataFrame:
    """True and false positives and false negatives of a binary grid against another, with the rates made of them."""
    both = found.select("row", "col", F.col("value").alias("f")).join(truth.select("row", "col", F.col("value").alias("t")), ["row", "col"], "full").fillna(0, ["f", "t"])
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    s = both.agg(n((F.col("f") == 1) & (F.col("t") == 1)).alias("tp"), n((F.col("f") == 1) & (F.col("t") == 0)).alias("fp"), n((F.col("f") == 0) & (F.col("t") == 1)).alias("fn"))
    rate = lambda a, b: F.when(b != 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.withColumns({"reliability": rate(tp, tp + fp), "sensitivity": rate(tp, tp + fn), "quality": rate(tp, tp + fp + fn), "area_difference": rate(fp - fn, tp + fn)})


def pad(cells: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Every cell of the grid, with nulls where there was no row."""
    spark = cells.sparkSession
    full = spark.range(nrows * ncols).select(F.floor(F.col("id") / ncols).cast("int").alias("row"), (F.col("id") % ncols).cast("int").alias("col"))
    return full.join(cells, ["row", "col"], "left")


def border_nodata(cells: DataFrame, nrows: int, ncols: int, width: int = 1) -> DataFrame:
    """The outermost rows and columns become nodata."""
    inner = F.col("row").between(width, nrows - 1 - width) & F.col("col").between(width, ncols - 1 - width)
    return cells.withColumn("value", F.when(inner, F.col("value")))
