"""Published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def track_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("track_id"), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, path: str, version: int, buckets: int = 64, order: tuple[str, ...] = ("track_id",)) -> None:
    """Publish one version of a table, partitioned by track bucket.

    Rows are spread by bucket and sort key range, so a bucket with one hot track
    is written by several tasks. The commit protocol makes the write atomic: a
    reader sees the version with its ``_SUCCESS`` marker or not at all.
    """
    target = f"{path}/version={version}"
    tagged = df.withColumn("track_bucket", track_bucket(buckets))
    spread = tagged.repartitionByRange("track_bucket", *order).sortWithinPartitions("track_bucket", *order)
    spread.write.mode("overwrite").partitionBy("track_bucket").parquet(target)


def read_table(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def read_tracks(spark: SparkSession, path: str, version: int, track_ids: list[str], buckets: int = 64) -> DataFrame:
    """Rows of some tracks; only their buckets' folders are listed and read."""
    table = read_table(spark, path, version)
    wanted = spark.createDataFrame([(t,) for t in track_ids], "track_id string").select(track_bucket(buckets).alias("b"))
    found = sorted({r.b for r in wanted.collect()})
    return table.where(F.col("track_bucket").isin(found) & F.col("track_id").isin(track_ids))
