"""Streams drained to the end against batch results."""

from pyspark.sql import functions as F

from catena.streaming import events


def stream(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows(spark, sf_dir, tmp_path):
    batch, s = stream(spark, sf_dir, tmp_path)
    got = {(r["source_key"], r["start"]): r["n"] for r in drain(events.windowed(s), "w").collect()}
    want = {(r["user_id"], r["w"]["start"]): r["n"] for r in batch.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_steps(spark, sf_dir, tmp_path):
    from pyspark.sql import Window

    batch, s = stream(spark, sf_dir, tmp_path)
    got = {r["event_id"] for r in drain(events.steps(s, 50.0), "s").collect()}
    d = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    assert got == {r["event_id"] for r in batch.withColumn("d", d).where("abs(d) >= 50").collect()}
