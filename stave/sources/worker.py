"""Analysis worker results and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave import schemas as S
from stave.functions import text as X
from stave.functions.music import harte_to_compact


def parse_worker_results(rows: DataFrame) -> DataFrame:
    """Add the typed result ``r`` to (track_id, requested_mode, json) rows."""
    return rows.withColumn("r", F.from_json("json", S.WORKER_RESULT))


def analyses(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("r.modelVersion").isNotNull()).select(
        "track_id", F.col("r.modelVersion").alias("model_version"), F.col("r.downbeatModelVersion").alias("downbeat_model_version"),
        F.col("r.bpm").alias("bpm"), F.col("r.dbnBpm").alias("dbn_bpm"), F.map_keys("r.modes").alias("modes"),
        F.coalesce("r.warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def beats(parsed: DataFrame) -> DataFrame:
    """Both beat timelines as rows, downbeats flagged by exact time."""
    parts = []
    for source, times, downs in (("raw", "beats", "downbeats"), ("dbn", "dbnBeats", "dbnDownbeats")):
        rows = parsed.select("track_id", F.col(f"r.{downs}").alias("_d"), F.posexplode(f"r.{times}").alias("beat_idx", "beat_s"))
        parts.append(rows.select(
            "track_id", F.lit(source).alias("source"), "beat_idx", "beat_s",
            F.coalesce(F.array_contains("_d", F.col("beat_s")), F.lit(False)).alias("is_downbeat"),
        ))
    return parts[0].unionByName(parts[1])


def chords(parsed: DataFrame) -> DataFrame:
    """Segments of every mode, labels converted to the compact spelling."""
    modes = parsed.select("track_id", F.explode("r.modes").alias("mode", "segments"))
    return modes.select("track_id", "mode", F.posexplode("segments").alias("idx", "c")).select(
        "track_id", "mode", "idx", F.coalesce(harte_to_compact(F.col("c.sourceLabel")), "c.label").alias("label"),
        F.col("c.sourceLabel").alias("source_label"), F.col("c.startSeconds").alias("start_s"), F.col("c.endSeconds").alias("end_s"),
        F.col("c.bass").alias("bass"), F.col("c.strength").alias("strength"),
    )


def scan_logs(lines: DataFrame) -> DataFrame:
    """Level and trimmed message of raw log lines (``line`` and any other columns); works on streams."""
    keep = [n for n in lines.columns if n != "line"]
    return lines.select(*keep, X.log_level(F.col("line")).alias("level"), F.trim("line").alias("message"))
