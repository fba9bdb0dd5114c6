"""The catalogue's live rules as streaming transformations.

Watermarks bound the state; the rules themselves only know that an older
generation never replaces a newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from stave.functions import text as X
from stave.operators import telemetry as T
from stave.sources.worker import scan_logs
from stave.streaming import stateful as ST


def log_counts(lines: DataFrame, minimum: str, window: str = "1 hour", delay: str = "10 minutes", origin: str | None = None) -> DataFrame:
    """Entries per origin, level and tumbling window (update mode)."""
    kept = T.filter_logs(scan_logs(lines), minimum, origin)
    return kept.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "origin", "level").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "origin", "level", "n")


def latest_generation(rows: DataFrame, key: str, generation: str) -> DataFrame:
    """Highest generation per key so far (update mode); a late lower one changes nothing."""
    rest = [n for n in rows.columns if n != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(generation)).alias("_r"))
    return best.select(key, *[F.col("_r")[n].alias(n) for n in rest])


def energy_windows(levels: DataFrame, seconds: int, slide: int, delay: str = "1 minute") -> DataFrame:
    """Strongest and mean level per track over sliding windows (update mode). ``levels``: ts, track_id, left, right."""
    return levels.withWatermark("ts", delay).groupBy("track_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(
        F.max("left").alias("max_left"), F.max("right").alias("max_right"), F.avg("left").alias("avg_left"), F.avg("right").alias("avg_right"),
    ).select("track_id", F.col("w.end").alias("window_end"), "max_left", "max_right", "avg_left", "avg_right")


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with their moment ``ts_ms`` as event time, one later, as a watermark starts at 0 and rows at it are late."""
    return rows.withColumn("ts", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("ts", delay)


def _dealt(rows: DataFrame, key: str, delay: str, slots: int):
    """Timed rows by the slot of their key, the group of a stateful function."""
    return _timed(rows, delay).withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(slots))).groupBy("_slot")


def job_summary(events: DataFrame, delay: str = "1 hour", ttl_ms: int = 7 * ST.DAY_MS, order: tuple[str, ...] = ("order_no",), slots: int = ST.SLOTS) -> DataFrame:
    """Completed and failed jobs of each import batch that changed, and whether all expected ones are settled (update mode).

    ``events``: batch_id, expected, job_id, state, order_no (grows with time; or the numbers named by ``order``), ts_ms.
    """
    return _dealt(events, "batch_id", delay, slots).applyInPandasWithState(ST.summarize([*order], ttl_ms), ST.SUMMARY, ST.SLOT_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def stem_eta(progress: DataFrame, delay: str = "1 minute", ttl_ms: int = ST.DAY_MS, slots: int = ST.SLOTS) -> DataFrame:
    """Remaining time after each progress report (append mode); a report older than the job's last is late and gives none."""
    return _dealt(progress, "job_id", delay, slots).applyInPandasWithState(ST.eta(ttl_ms), T.ETA, ST.SLOT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def meter(levels: DataFrame, response: str = "medium", hold: str = "oneSecond", delay: str = "1 minute", ttl_ms: int = ST.DAY_MS, slots: int = ST.SLOTS) -> DataFrame:
    """Meter level and held peak after each reading (append mode); a reading older than the track's last is late and gives none."""
    return _dealt(levels, "track_id", delay, slots).applyInPandasWithState(ST.meter(response, hold, ttl_ms), T.METER, ST.SLOT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_candidates(candidates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First candidate to arrive per batch and key (append mode). ``candidates`` carry ``ts``.

    Of equal ones within a micro-batch any may be first; see ``first_candidates`` for the one of the least ``seq``.
    """
    keyed = candidates.withColumn("candidate_key", X.candidate_key(F.col("kind"), F.col("input")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["batch_id", "candidate_key"])


def first_candidates(candidates: DataFrame) -> DataFrame:
    """The candidate of the least ``seq``, then input, per batch and key so far (update mode), in whatever order they arrive."""
    keyed = candidates.withColumn("candidate_key", X.candidate_key(F.col("kind"), F.col("input")))
    rest = [n for n in keyed.columns if n not in ("batch_id", "candidate_key")]
    best = keyed.groupBy("batch_id", "candidate_key").agg(F.min_by(F.struct(*rest), F.struct("seq", "input")).alias("_r"))
    return best.select("batch_id", "candidate_key", *[F.col("_r")[n].alias(n) for n in rest])


def progress_reports(rows: DataFrame) -> DataFrame:
    """Progress rows with implausible unit counts removed (append mode)."""
    return T.progress_sanity(rows)
