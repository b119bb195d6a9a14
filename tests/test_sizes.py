"""What only shows on larger tables: ties by the last digit of a sum, and frames that grow with the square of a group."""

from pyspark.sql import functions as F

from catena import queries
from catena.functions import stats
from catena.operators import network, profile


def test_equally_far_sources(spark):
    """Two sources are as far from the root; the order in which their steps are added does not choose the larger one."""
    rows = [(0, 0, 0.0), (1, 0, 0.1), (2, 1, 0.2), (10, 2, 0.3), (3, 0, 0.3), (4, 3, 0.2), (11, 4, 0.1)]
    channel = spark.createDataFrame(rows, "node long, receiver long, dx double")
    got = {r["node"]: r["source_key"] for r in network.source_keys(channel, channel.where("node >= 10")).collect()}
    assert got == {0: 10, 1: 10, 2: 10, 10: 10, 3: 11, 4: 11, 11: 11}


def test_interpolation_reads_each_row_once(spark, capsys):
    """No frame reaches from a row to the end of its group; repeated points, points at nodes, beyond them and without a place keep their value."""
    nodes = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("b", 5.0, 1.0)], "k string, x double, y double")
    points = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", 3.0), (4, "a", 0.0), (5, "a", 9.0), (6, "b", 7.0), (7, "c", 1.0), (8, "a", None)], "i long, k string, x double")
    found = stats.interpolate(points, nodes, ["k"], "x", "y")
    assert found.columns == ["i", "k", "x", "y"]
    assert {r["i"]: r["y"] for r in found.collect()} == {1: 20.0, 2: 20.0, 3: 30.0, 4: 10.0, 5: 30.0, 6: 1.0, 7: None, 8: 10.0}
    found.explain("formatted")
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_residuals_in_order(spark):
    """Residuals are added from the highest chi down, however rows lie, and a mean right between two roundings goes up."""
    r = [((i * 7919) % 9973) / 100 for i in range(64)]
    rows = [(0, 0, float(i), 0.0) for i in range(64)] + [(0, 1, float(i), -v) for i, v in enumerate(r)]
    want = 0.0
    for v in reversed(r):
        want += v
    for parts in (1, 7):
        table = spark.createDataFrame(rows, "basin_key long, source_key long, chi double, elevation double").repartition(parts)
        got = profile.collinearity(table, F.col("source_key") == 0).head()
        assert got["mae"] == want / 64 and got["n"] == 64
    row = queries.halves_up(spark.createDataFrame([(56.845625, 0.5)], "a double, b double"), 5, "a", "b").head()
    assert (row["a"], row["b"]) == (56.84563, 0.5)


def test_residuals_as_decimals(spark, tmp_path):
    """The mean of these prices is 3,638.12 / 64 = 56.845625, right between two roundings: it goes up, however rows lie."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id IN (7, 1287)")
    for parts in (1, 5):
        folder = str(tmp_path / str(parts))
        events.repartition(parts).write.parquet(f"{folder}/events.parquet")
        got = queries.QUERIES["collinearity_discharge"](spark, folder).collect()
        assert sorted((r["theta"], r["source_key"], r["mae"], r["n"]) for r in got) == [(0.3, 1287, 56.84563, 64), (0.5, 1287, 56.84563, 64)]


def test_residuals_of_odd_nodes(spark):
    """Nodes without an elevation only count, do not reach their neighbours, and what is not finite stays."""
    nodes = [(0, 0, 1.0, 1.0), (0, 0, 2.0, 5.0), (0, 0, 3.0, None), (0, 1, 1.0, 4.0), (0, 1, 2.0, 1.0), (0, 1, 3.0, 1.0), (0, 2, 2.0, float("inf")), (0, 3, 2.0, None)]
    table = spark.createDataFrame(nodes, "basin_key long, source_key long, chi double, elevation double")
    found = queries.halves_up(profile.decimal_collinearity(table, F.col("source_key") == 0), 5, "mae", "rmse")
    assert {r["source_key"]: (r["mae"], r["rmse"], r["n"]) for r in found.collect()} == {1: (3.5, 3.53553, 3), 2: (float("inf"), float("inf"), 1), 3: (None, None, 1)}
