"""Raster files (.asc, .flt, .bil) as a Spark data source, and its writer.

``register(spark)`` once, then ``spark.read.format("grid").load("dem.bil")`` gives ``row, col, value``
(null: nodata); ``value`` is a double, or a long where the file holds integers.  Files are read in row bands, one
partition each: binary ones at the offsets the header gives, text at the places of lines, which are looked up once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from catena.grid import GridSpec

#: Types of ENVI headers that are read (fixed values of the format).
ENVI_TYPES = {"1": "u1", "2": "i2", "3": "i4", "4": "f4", "5": "f8", "12": "u2", "13": "u4"}


@dataclass(frozen=True)
class Layout:
    spec: GridSpec
    dtype: str
    first: int = 0


def _pairs(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] for m in re.finditer(r"^\s*([A-Za-z_]+)\s+(\S+)", text, re.M)}


def read_layout(path: str) -> Layout:
    """Size, place and type of a raster from its header."""
    stem, kind = os.path.splitext(path)
    if kind == ".asc":
        with open(path) as f:
            lines = [next(f) for _ in range(6)]
        head = _pairs("".join(lines))
        first = sum(1 for x in lines if re.match(r"\s*[A-Za-z]", x))
        return Layout(_esri(head), "text", first)
    with open(stem + ".hdr") as f:
        text = f.read()
    if kind == ".flt":
        head = _pairs(text)
        return Layout(_esri(head), ">f4" if head.get("byteorder", "").lower().startswith("msb") else "<f4")
    if not text.startswith("ENVI"):
        raise ValueError(f"{stem}.hdr is not an ENVI header")
    head = {m[1].strip().lower(): m[2].strip() for m in re.finditer(r"^([^=\n]+)=\s*(\{[^}]*\}|[^\n]*)", text, re.M)}
    rows, cols = int(head["lines"]), int(head["samples"])
    info = [x.strip() for x in head.get("map info", "").strip("{}").split(",")]
    res, west, north = (float(info[5]), float(info[3]), float(info[4])) if len(info) > 6 else (1.0, 0.0, float(rows))
    spec = GridSpec(rows, cols, west, north - rows * res, res, float(head.get("data ignore value", -9999)), head.get("map info", ""))
    return Layout(spec, (">" if head.get("byte order") == "1" else "<") + ENVI_TYPES[head.get("data type", "4")], int(head.get("header offset", 0)))


def _esri(head: dict[str, str]) -> GridSpec:
    res = float(head["cellsize"])
    at = lambda axis: float(head[f"{axis}llcorner"]) if f"{axis}llcorner" in head else float(head[f"{axis}llcenter"]) - res / 2
    return GridSpec(int(head["nrows"]), int(head["ncols"]), at("x"), at("y"), res, float(head.get("nodata_value", -9999)))


@dataclass
class Band(InputPartition):
    start: int
    stop: int
    at: int = 0


class GridReader(DataSourceReader):
    def __init__(self, path: str, bands: int) -> None:
        self.path, self.bands, self.layout = path, bands, read_layout(path)

    def partitions(self) -> list[InputPartition]:
        n = self.layout.spec.nrows
        cuts = np.linspace(0, n, max(1, min(self.bands, n)) + 1).astype(int).tolist()
        places = [0] * len(cuts)
        if self.layout.dtype == "text":
            begins, at = [], 0
            with open(self.path, "rb") as f:
                for k, line in enumerate(f):
                    if k >= self.layout.first and line.strip():
                        begins.append(at)
                    at += len(line)
            if len(begins) != n:
                # Rows that do not stand on lines of their own can't be cut.
                return [Band(0, n, begins[0] if begins else 0)]
            places = [begins[c] for c in cuts[:-1]]
        return [Band(a, b, p) for a, b, p in zip(cuts[:-1], cuts[1:], places, strict=False)]

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        spec, layout = self.layout.spec, self.layout
        if layout.dtype == "text":
            rows = partition.stop - partition.start
            with open(self.path) as f:
                f.seek(partition.at)
                whole = f.read() if rows == spec.nrows else "".join(next(f) for _ in range(rows))
            values = np.array(whole.split(), dtype=float).reshape(rows, spec.ncols)
        else:
            width = np.dtype(layout.dtype).itemsize
            with open(self.path, "rb") as f:
                f.seek(layout.first + partition.start * spec.ncols * width)
                raw = f.read((partition.stop - partition.start) * spec.ncols * width)
            values = np.frombuffer(raw, dtype=layout.dtype).reshape(-1, spec.ncols)
            values = values.astype(np.int64 if values.dtype.kind in "iu" else float)
        step = max(1, 500_000 // spec.ncols)
        for lo in range(0, len(values), step):
            part = values[lo : lo + step]
            rows = np.repeat(np.arange(partition.start + lo, partition.start + lo + len(part), dtype=np.int32), spec.ncols)
            cols = np.tile(np.arange(spec.ncols, dtype=np.int32), len(part))
            flat = part.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(flat, mask=np.isclose(flat, spec.nodata) | np.isnan(flat))], names=["row", "col", "value"])


class GridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grid"

    def path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> str:
        whole = np.dtype(layout).kind in "iu" if (layout := read_layout(self.path()).dtype) != "text" else False
        return f"row int, col int, value {'long' if whole else 'double'}"

    def reader(self, schema: object) -> DataSourceReader:
        return GridReader(self.path(), int(self.options.get("bands", "32")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GridSource)


def write_grid(cells: DataFrame, spec: GridSpec, path: str, dtype: str = "f4") -> None:
    """One raster file (.asc, .flt or .bil by its ending), row by row in order; the rows stream through the driver.

    A .bil file holds numbers of ``dtype``: f4, f8 or i4.
    """
    code = {"f4": 4, "f8": 5, "i4": 3}[dtype]
    stem, kind = os.path.splitext(path)
    lines = cells.groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("v")).orderBy("row")
    west, north = spec.xmin, spec.ymin + spec.nrows * spec.res
    esri = f"ncols {spec.ncols}\nnrows {spec.nrows}\nxllcorner {spec.xmin}\nyllcorner {spec.ymin}\ncellsize {spec.res}\nNODATA_value {spec.nodata}\n"
    if kind == ".flt":
        with open(stem + ".hdr", "w") as f:
            f.write(esri + "byteorder LSBFIRST\n")
    elif kind == ".bil":
        with open(stem + ".hdr", "w") as f:
            f.write(f"ENVI\nsamples = {spec.ncols}\nlines = {spec.nrows}\nbands = 1\nheader offset = 0\ndata type = {code}\ninterleave = bil\nbyte order = 0\nmap info = {{UTM, 1, 1, {west}, {north}, {spec.res}, {spec.res}, 30, North, WGS-84}}\ndata ignore value = {spec.nodata}\n")
    with open(path, "w" if kind == ".asc" else "wb") as f:
        if kind == ".asc":
            f.write(esri)
        at = 0

        def put(line: np.ndarray) -> None:
            f.write(" ".join(repr(float(v)) for v in line) + "\n" if kind == ".asc" else line.astype(f"<{dtype if kind == '.bil' else 'f4'}").tobytes())

        blank = np.full(spec.ncols, spec.nodata)
        for r in lines.toLocalIterator():
            while at < r["row"]:
                put(blank)
                at += 1
            line = blank.copy()
            for c in r["v"]:
                if c["value"] is not None:
                    line[c["col"]] = c["value"]
            put(line)
            at += 1
        for _ in range(at, spec.nrows):
            put(blank)
