"""Shapefile geometry (points and poly-lines) as a Spark data source: ``shape, part, place, x, y``."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parse_shapes(data: bytes) -> Iterator[tuple[int, int, int, float, float]]:
    """Vertices of every record; other kinds of shapes are left out."""
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        number, words = struct.unpack(">2i", data[at : at + 8])
        kind = struct.unpack("<i", data[at + 8 : at + 12])[0]
        body = data[at + 12 : at + 8 + 2 * words]
        if kind in (1, 11, 21):
            yield (number, 0, 0, *struct.unpack("<2d", body[:16]))
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<2i", body[32:40])
            firsts = [*struct.unpack(f"<{parts}i", body[40 : 40 + 4 * parts]), points]
            base = 40 + 4 * parts
            for p in range(parts):
                for i in range(firsts[p], firsts[p + 1]):
                    yield (number, p, i - firsts[p], *struct.unpack("<2d", body[base + 16 * i : base + 16 * i + 16]))
        at += 8 + 2 * words


class ShapeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            yield from parse_shapes(f.read())


class ShapeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        return "shape int, part int, place int, x double, y double"

    def reader(self, schema: object) -> DataSourceReader:
        return ShapeReader(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ShapeSource)
