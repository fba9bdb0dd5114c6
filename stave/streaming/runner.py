"""Running streams to the end of their input, into written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stave.operators.timeline import keep_last
from stave.session import new_dir


def read_files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB on the executors' disks; a session's own provider wins."""
    if spark.conf.get(PROVIDER, "").rpartition(".")[2] not in ("", "HDFSBackedStateStoreProvider"):
        yield
        return
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER)


def run_append(stream: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """Process all available input and return what was appended; with the folder of an earlier run, go on from there."""
    spark = stream.sparkSession
    out = out or new_dir(spark, label)
    with disk_state(spark):
        query = (
            stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def run_updates(stream: DataFrame, keys: list[str], label: str, out: str | None = None) -> DataFrame:
    """Process all available input in update mode and return the last row per key.

    Every micro-batch writes its changed rows under its own number, so a batch
    replayed after a failure overwrites itself. With the folder of an earlier run the
    stream goes on from there.
    """
    spark = stream.sparkSession
    out = out or new_dir(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch_no={number}")

    run_batches(stream, write, f"{out}/checkpoint")
    changed = spark.read.schema(f"{_ddl(stream)}, batch_no bigint").option("basePath", f"{out}/data").parquet(f"{out}/data")
    return keep_last(changed, keys, ["batch_no"]).drop("batch_no")


def _ddl(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch of all available input to ``write``."""
    with disk_state(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
        )
        query.awaitTermination()
