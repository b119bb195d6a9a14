"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, which ``spark.checkpoint.dir`` names.

    Only where the executors are threads of the driver a temporary folder of this machine stands in for it; on a cluster
    without that setting this raises, as executors would write where the others can't read.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"catena-{os.getuid()}")
    return f"{root.rstrip('/')}/{context.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete this application's tables; results that were not computed yet need them, so call it last."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    Iterative operators call this each round: the lineage ends here, and the copy outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
