"""Ingestion of worker results: check, route, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stave.operators.quality import check_worker_result
from stave.operators.timeline import keep_last
from stave.session import new_dir
from stave.sources.worker import parse_worker_results
from stave.streaming.runner import run_batches


def ingest_results(stream: DataFrame, label: str = "results") -> tuple[DataFrame, DataFrame]:
    """Route results (track_id, requested_mode, json) to (good modes, rejects with rules).

    Each micro-batch is checked and both sides are written under its number. Good
    rows are one per (track, mode); a later result replaces an earlier one when
    the table is read.
    """
    spark: SparkSession = stream.sparkSession
    out = new_dir(spark, label)
    key = ["track_id", "requested_mode"]

    def route(batch: DataFrame, number: int) -> None:
        parsed = parse_worker_results(batch)
        broken = check_worker_result(parsed)
        reasons = broken.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("reasons"))
        # anti and semi join on the same small table of reasons
        modes = parsed.join(reasons, key, "left_anti").select("track_id", F.explode("r.modes").alias("mode", "segments"))
        modes.select("track_id", "mode", F.size("segments").alias("n_segments")).write.mode("overwrite").parquet(f"{out}/good/batch_no={number}")
        reasons.write.mode("overwrite").parquet(f"{out}/bad/batch_no={number}")

    run_batches(stream, route, f"{out}/checkpoint")
    good = spark.read.schema("track_id string, mode string, n_segments int, batch_no bigint").option("basePath", f"{out}/good").parquet(f"{out}/good")
    bad = spark.read.schema("track_id string, requested_mode string, reasons string, batch_no bigint").option("basePath", f"{out}/bad").parquet(f"{out}/bad")
    return keep_last(good, ["track_id", "mode"], ["batch_no"]).drop("batch_no"), keep_last(bad, key, ["batch_no"]).drop("batch_no")
