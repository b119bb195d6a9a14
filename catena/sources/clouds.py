"""Point clouds in LAS files as a Spark data source, and rasters made of them: ``x, y, z, class``."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from catena.grid import GridSpec


@dataclass(frozen=True)
class CloudHeader:
    first: int
    size: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def read_header(path: str) -> CloudHeader:
    """Where the point records are and how their numbers are scaled (formats 0 to 5)."""
    with open(path, "rb") as f:
        head = f.read(375)
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    first, kind, size, count = struct.unpack_from("<I", head, 96)[0], head[104], *struct.unpack_from("<HI", head, 105)
    if kind & 0x3F > 5:
        raise ValueError("only point formats 0 to 5 are read")
    numbers = struct.unpack_from("<6d", head, 131)
    return CloudHeader(first, size, count, numbers[:3], numbers[3:])


@dataclass
class Run(InputPartition):
    start: int
    stop: int


class CloudReader(DataSourceReader):
    def __init__(self, path: str, parts: int) -> None:
        self.path, self.parts, self.head = path, parts, read_header(path)

    def partitions(self) -> list[InputPartition]:
        cuts = np.linspace(0, self.head.count, max(1, min(self.parts, self.head.count)) + 1).astype(int).tolist()
        return [Run(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        h = self.head
        for lo in range(partition.start, partition.stop, 500_000):
            hi = min(partition.stop, lo + 500_000)
            with open(self.path, "rb") as f:
                f.seek(h.first + lo * h.size)
                raw = np.frombuffer(f.read((hi - lo) * h.size), dtype=np.uint8).reshape(-1, h.size)
            xyz = np.ascontiguousarray(raw[:, :12]).view("<i4")
            columns = [pa.array(xyz[:, i] * h.scale[i] + h.offset[i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((raw[:, 15] & 0x1F).astype(np.int32))], names=["x", "y", "z", "class"])


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "x double, y double, z double, class int"

    def reader(self, schema: object) -> DataSourceReader:
        return CloudReader(self.options["path"].removeprefix("file://"), int(self.options.get("parts", "32")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CloudSource)


def ground(points: DataFrame) -> DataFrame:
    return points.where(F.col("class") == 2)


def vegetation(points: DataFrame) -> DataFrame:
    return points.where(F.col("class").between(3, 5))


def to_cells(points: DataFrame, spec: GridSpec) -> DataFrame:
    """``row, col, value, low, high, n``: mean, lowest and highest point of each cell."""
    inside = points.where(spec.contains(F.col("x"), F.col("y")))
    return inside.groupBy(spec.row(F.col("y")).alias("row"), spec.col(F.col("x")).alias("col")).agg(F.avg("z").alias("value"), F.min("z").alias("low"), F.max("z").alias("high"), F.count("*").alias("n"))
