"""Registered queries that run as streams over the catalogue's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from stave.plans.bindings import Tables
from stave.plans.catalog_queries import ordered_candidates
from stave.plans.chord_queries import r6
from stave.plans.quality_queries import eta_ms, worker_rows
from stave.plans.registry import ORACLES, query
from stave.streaming import rules as R
from stave.streaming import stateful as ST
from stave.streaming.results import ingest_results
from stave.streaming.runner import read_files, run_append, run_updates

def stream(t: Tables, name: str, df, batches: int = 8):
    """The files of a stored catalogue table as a stream, in any order, in so many micro-batches at most."""
    return read_files(t.spark, t.path(name), df.schema, max(1, -(-len(df.inputFiles()) // batches)))


def live(t: Tables, name: str, df, axis: str):
    """A catalogue table as a stream whose files arrive in the order of ``axis``, one in each micro-batch."""
    return read_files(t.spark, t.landed(name, df, axis), df.schema, 1)


@query("stream_logs", """
SELECT epoch_us(time_bucket(INTERVAL 1 DAY, make_timestamp(abs_us))) // 1000000 AS window_s, origin, level, count(*) AS n FROM v_logs WHERE level IN ('info', 'warn', 'error') GROUP BY ALL""")
def stream_logs(t):
    counts = R.log_counts(live(t, "logs", t.logs, "ts_ms"), "info", "1 day", "1 hour")
    done = run_updates(counts, ["window_start", "origin", "level"], "stream_logs")
    return done.select(F.unix_seconds("window_start").alias("window_s"), "origin", "level", "n")


@query("stream_latest_generation", "SELECT batch_id AS track_id, max(event_id) AS generation, arg_max(state, event_id) AS state FROM v_jobs GROUP BY ALL")
def stream_latest_generation(t):
    rows = stream(t, "jobs", t.jobs).select(F.col("batch_id").alias("track_id"), F.col("event_id").alias("generation"), "state")
    return run_updates(R.latest_generation(rows, "track_id", "generation"), ["track_id"], "stream_generation")


@query("stream_energy", """
SELECT track_id, w AS window_end_s, max("left") AS max_left, max("right") AS max_right, round(avg("left"), 9) AS avg_left, round(avg("right"), 9) AS avg_right
FROM (SELECT *, unnest(range((ts_ms // 5000) * 5 + 5, (ts_ms // 5000) * 5 + 20, 5)) AS w FROM v_levels) GROUP BY ALL""")
def stream_energy(t):
    levels = live(t, "levels", t.levels, "ts_ms").withColumn("ts", F.timestamp_millis("ts_ms"))
    done = run_updates(R.energy_windows(levels, 15, 5, "1 minute"), ["track_id", "window_end"], "stream_energy")
    return done.select(
        "track_id", F.unix_seconds("window_end").alias("window_end_s"), "max_left", "max_right", F.round("avg_left", 9).alias("avg_left"), F.round("avg_right", 9).alias("avg_right"))


@query("stream_job_summary", same_as="import_batch_summary")
def stream_job_summary(t):
    """The last summary of each batch, where it is settled.

    Files arrive in the order of time, which that of the ids need not be; a batch may rest as long as the table spans.
    """
    us = F.unix_micros("ts")
    rows = live(t, "jobs", t.jobs, "ts").select("*", us.alias("ts_us"), F.floor(us / 1000).alias("ts_ms"))
    span = t.jobs.agg(F.max(us) - F.min(us)).first()[0] or 0
    done = run_updates(R.job_summary(rows, ttl_ms=span // 1000 + ST.DAY_MS, order=("ts_us", "event_id")), ["batch_id"], "stream_jobs")
    return done.where("settled").drop("settled")


@query("stream_eta", same_as="stem_eta")
def stream_eta(t):
    return run_append(R.stem_eta(live(t, "progress", t.progress, "ts_ms")), "stream_eta").select("job_id", "seq", eta_ms(), "shown_s")


@query("stream_meter", same_as="meter_history")
def stream_meter(t):
    return run_append(R.meter(live(t, "levels", t.levels, "ts_ms")), "stream_meter").select("track_id", "event_id", r6("level"), r6("held_peak"))


@query("stream_worker_results", """
SELECT track_id, made AS mode, n::INT AS n_segments FROM v_result JOIN (SELECT result_id AS track_id, count(*) AS n FROM v_part GROUP BY ALL) USING (track_id)
WHERE user_id % 11 <> 5 AND made = requested_mode AND NOT failed AND (user_id % 5 <> 0) = (user_id % 10 > 5) AND user_id % 17 <> 3""")
def stream_worker_results(t):
    return ingest_results(stream(t, "worker_rows", worker_rows(t)))[0]


@query("stream_worker_rejects", f"""
WITH c AS ({ORACLES["check_worker_result"]}) SELECT track_id, requested_mode, string_agg(rule, ', ' ORDER BY rule) AS reasons FROM c GROUP BY ALL""")
def stream_worker_rejects(t):
    return ingest_results(stream(t, "worker_rows", worker_rows(t)))[1]


def _candidates(rows):
    return rows.drop("candidate_key").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("line_no"))).withColumn("batch_id", F.left("batch_id", F.lit(1)))


@query("stream_dedupe_candidates", "SELECT left(batch_id, 1) AS source, candidate_key, kind FROM v_ordered GROUP BY ALL")
def stream_dedupe_candidates(t):
    """The lines of an import arrive in order; a repeat more than an hour of lines behind is as good as new, so the delay spans the import."""
    rows = _candidates(live(t, "candidates", ordered_candidates(t), "line_no"))
    lines = ordered_candidates(t).agg(F.max("line_no")).first()[0] or 0
    done = run_append(R.dedupe_candidates(rows, f"{lines + 60} seconds"), "stream_candidates")
    return done.select(F.col("batch_id").alias("source"), "candidate_key", "kind")


@query("stream_first_candidates", "SELECT left(batch_id, 1) AS source, candidate_key, min(seq) AS seq, arg_min(input, struct_pack(seq, input)) AS input FROM v_ordered GROUP BY ALL")
def stream_first_candidates(t):
    """Files in any order; the candidate of the least place is kept."""
    rows = _candidates(stream(t, "candidates", ordered_candidates(t)))
    done = run_updates(R.first_candidates(rows), ["batch_id", "candidate_key"], "stream_first")
    return done.select(F.col("batch_id").alias("source"), "candidate_key", "seq", "input")


@query("stream_progress_sanity", same_as="progress_sanity")
def stream_progress_sanity(t):
    done = run_append(R.progress_reports(stream(t, "progress", t.progress)), "stream_progress")
    return done.select("job_id", "seq", F.coalesce("completed", F.lit(-1)).alias("completed"), F.coalesce("total", F.lit(-1)).alias("total"))
