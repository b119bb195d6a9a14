"""Point tables: CSV with latitude and longitude columns, GeoJSON, well-known text, sample lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.functions.geo import from_utm
from catena.grid import GridSpec

LATITUDE, LONGITUDE = ("latitude", "Latitude", "lat", "Lat"), ("longitude", "Longitude", "long", "Lon")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns strings without white space or control characters; ``latitude`` and ``longitude`` as doubles where present."""
    df = spark.read.option("header", True).csv(path)
    df = df.select(*[F.regexp_replace(F.col(f"`{c}`"), r"[\s\p{Cntrl}]", "").alias(c.strip()) for c in df.columns])
    for name, names in (("latitude", LATITUDE), ("longitude", LONGITUDE)):
        found = next((c for c in df.columns if c in names), None)
        if found:
            df = df.withColumn(found, F.col(found).cast("double")).withColumnRenamed(found, name)
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _wrapped(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def point_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature a row in column ``value``; longitudes are brought to -180 .. 180."""
    rest = [c for c in df.columns if c not in ("latitude", "longitude")]
    shape = F.struct(F.lit("Point").alias("type"), F.array(_wrapped(F.col("longitude")), F.col("latitude")).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), shape.alias("geometry"))).alias("value"))


def line_features(df: DataFrame, key: str, order: str) -> DataFrame:
    """One GeoJSON line a key, its points in order."""
    points = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), _wrapped(F.col("longitude")).alias("x"), F.col("latitude").alias("y"))))
    lines = df.groupBy(key).agg(F.transform(points, lambda p: F.array(p["x"], p["y"])).alias("c"))
    shape = F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates"))
    return lines.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(key).alias("properties"), shape.alias("geometry"))).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file a partition."""
    features.write.mode("overwrite").text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Cosmogenic samples: seven columns; shorter rows are left out, underscores in names become dashes."""
    schema = "sample_name string, latitude double, longitude double, nuclide string, concentration double, uncertainty double, standardisation string"
    df = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return df.where("standardisation IS NOT NULL").withColumn("sample_name", F.translate("sample_name", "_", "-"))


def read_channel_heads(spark: SparkSession, path: str, by: str = "node") -> DataFrame:
    """Channel heads by ``node``, by ``row`` and ``col``, or by ``x`` and ``y``."""
    df = spark.read.option("header", True).csv(path)
    want = {"node": [("node", "long")], "cell": [("row", "int"), ("col", "int")], "place": [("x", "double"), ("y", "double")]}[by]
    return df.select(*[F.col(c).cast(t) for c, t in want])


def read_wkt(spark: SparkSession, path: str) -> DataFrame:
    """Names in brackets of a well-known text file: key, name."""
    text = spark.read.option("wholetext", True).text(path)
    found = F.regexp_extract_all("value", F.lit(r'([A-Z_]+)\s*\[\s*"([^"]*)"'), 1)
    names = F.regexp_extract_all("value", F.lit(r'([A-Z_]+)\s*\[\s*"([^"]*)"'), 2)
    return text.select(F.explode(F.arrays_zip(found.alias("key"), names.alias("name"))).alias("p")).select("p.key", "p.name")


def flatten(cells: DataFrame, spec: GridSpec, zone: int | None = None, south: bool = False) -> DataFrame:
    """``x, y, value`` of data cells; with a UTM zone also ``latitude, longitude``."""
    df = cells.where("value IS NOT NULL").select(spec.x(F.col("col")).alias("x"), spec.y(F.col("row")).alias("y"), "value")
    if zone is None:
        return df
    lat, lon = from_utm(F.col("x"), F.col("y"), F.lit(zone), F.lit(south))
    return df.withColumns({"latitude": lat, "longitude": lon})


def network_table(channel: DataFrame, orders: DataFrame, spec: GridSpec, metrics: DataFrame | None = None) -> DataFrame:
    """Channel nodes with place, order, receiver and any metrics by node, ready for CSV or GeoJSON."""
    df = channel.select("node", "row", "col", "receiver", "z").join(orders, "node").withColumns({"x": spec.x(F.col("col")), "y": spec.y(F.col("row"))})
    return df if metrics is None else df.join(metrics, "node")


def read_series(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A plain table without a header, such as a rainfall series, with the given schema; comments begin with #."""
    return spark.read.schema(columns).option("comment", "#").option("mode", "DROPMALFORMED").csv(path)


def read_raster_list(spark: SparkSession, path: str) -> DataFrame:
    """``dem, snow, self, topographic``: file names or single values of each row; empty fields are null."""
    return spark.read.schema("dem string, snow string, self string, topographic string").csv(path).select(*[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in ("dem", "snow", "self", "topographic")])
