"""Grids as tables of cells: ``row, col, value``, rows counted from the north.

A cell without a row, or with a null value, is nodata.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbours clockwise from north: (row step, column step).  Even ones share an edge, odd ones a corner.
STEPS = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
DIAGONAL = 2.0**0.5


@dataclass(frozen=True)
class GridSpec:
    """Size and place of a grid; ``xmin`` and ``ymin`` are its lower left corner."""

    nrows: int
    ncols: int
    xmin: float = 0.0
    ymin: float = 0.0
    res: float = 1.0
    nodata: float = -9999.0
    crs: str = ""

    def x(self, col: Column) -> Column:
        return F.lit(self.xmin) + (col + 0.5) * self.res

    def y(self, row: Column) -> Column:
        return F.lit(self.ymin) + (F.lit(self.nrows) - row - 0.5) * self.res

    def col(self, x: Column) -> Column:
        return F.floor((x - self.xmin) / self.res).cast("int")

    def row(self, y: Column) -> Column:
        return (F.lit(self.nrows - 1) - F.floor((y - self.ymin) / self.res)).cast("int")

    def contains(self, x: Column, y: Column) -> Column:
        return (x >= self.xmin) & (x < self.xmin + self.ncols * self.res) & (y >= self.ymin) & (y < self.ymin + self.nrows * self.res)

    def node(self) -> Column:
        """A cell's number, row by row."""
        return F.col("row").cast("long") * self.ncols + F.col("col")

    def same_size(self, other: GridSpec) -> bool:
        return (self.nrows, self.ncols) == (other.nrows, other.ncols)

    def same_place(self, other: GridSpec) -> bool:
        return self.same_size(other) and (self.xmin, self.ymin, self.res) == (other.xmin, other.ymin, other.res)

    def window(self, row: int, col: int, nrows: int, ncols: int) -> GridSpec:
        """The part that begins at a cell."""
        south = self.nrows - row - nrows
        return replace(self, nrows=nrows, ncols=ncols, xmin=self.xmin + col * self.res, ymin=self.ymin + south * self.res)


def spread(cells: DataFrame, offsets: list[tuple[int, int]], value: str = "value") -> DataFrame:
    """Each cell's value sent to the cells from which it is ``offsets`` away: row, col, k, sent."""
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(offsets)])
    out = cells.select("row", "col", F.col(value).alias("sent"), F.explode(moves).alias("m"))
    return out.select((F.col("row") - F.col("m.dr")).alias("row"), (F.col("col") - F.col("m.dc")).alias("col"), F.col("m.k").alias("k"), "sent")


def window3(cells: DataFrame, value: str = "value") -> DataFrame:
    """``row, col, z, n0 .. n7``: every data cell with its neighbours' values (null: none there).

    Values are sent to neighbours and gathered by one grouped aggregation; cells of one area meet
    already on the map side, so the shuffle carries little more than a row a cell.
    """
    sent = spread(cells.where(F.col(value).isNotNull()), [*STEPS, (0, 0)], value)
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("sent")))
    found = sent.groupBy("row", "col").agg(at(8).alias("z"), *[at(k).alias(f"n{k}") for k in range(8)])
    return found.where("z IS NOT NULL")


def disc(radius: float, circular: bool = True) -> list[tuple[int, int]]:
    """Offsets of a square or circular window around a cell, the cell among them."""
    r = int(radius)
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if not circular or i * i + j * j <= radius * radius]
