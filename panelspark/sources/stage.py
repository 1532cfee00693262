"""Stage tables: cut lineage where a result feeds several branches."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder on the storage that the cluster shares, deleted when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/panelspark-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write once to shared storage and read back.

    The readers see a parquet scan with column pruning and true sizes, and a lost executor
    costs a re-read instead of the whole upstream job.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
