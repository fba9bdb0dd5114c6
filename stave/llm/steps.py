"""Written steps: a result goes to the shared folder, and what made it may leave the disks."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame

from stave.session import new_dir


def step(df: DataFrame, label: str) -> DataFrame:
    """Write a result, read it back, and let Spark's cleaner drop the shuffle files behind it.

    The cleaner works when driver and JVM collect their garbage, which may not happen for
    long; asking for it bounds the disk to the largest step.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*steps: DataFrame) -> None:
    """Delete written steps that nothing reads any more."""
    for df in steps:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
