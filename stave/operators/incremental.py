"""What still needs analysis, and how results are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.functions.vocabulary import MODES

CACHE_VERSION = 16


def valid_cache(tracks: DataFrame, cached: DataFrame, version: int = CACHE_VERSION) -> DataFrame:
    """Cached analyses whose version and source identity (size, mtime) still hold."""
    identity = ["track_id", "source_size", "source_modified_ns"]
    return cached.where(F.col("cache_version") == version).join(tracks.select(*identity), identity, "left_semi")


def analysis_worklist(tracks: DataFrame, cached: DataFrame, version: int = CACHE_VERSION, modes: list[str] = MODES) -> DataFrame:
    """(track, mode) pairs without a valid cached result; rhythm is due where no valid row exists at all.

    ``cached``: track_id, cache_version, source_size, source_modified_ns, modes.
    """
    valid = valid_cache(tracks, cached, version).groupBy("track_id").agg(F.array_distinct(F.flatten(F.collect_list("modes"))).alias("_have"))
    wanted = tracks.select("track_id").join(valid, "track_id", "left").withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    return wanted.where(F.col("_have").isNull() | ~F.array_contains("_have", F.col("mode"))).select(
        "track_id", "mode", F.col("_have").isNull().alias("include_rhythm"))


def stem_worklist(tracks: DataFrame, manifests: DataFrame, version: int, revision: str) -> DataFrame:
    """Tracks without a valid separated-stem manifest of this version and model."""
    identity = ["track_id", "source_size", "source_modified_ns"]
    fresh = manifests.where((F.col("cache_version") == version) & (F.col("model_revision") == revision)).select(*identity)
    return tracks.join(fresh, identity, "left_anti")


def merge_results(cached: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge new results into cached analyses; returns (merged, rejected).

    Both: track_id, model_version, downbeat_model_version, has_rhythm, modes
    (map), warnings; at most one row per track each. A new mode joins the cached
    ones and the cached rhythm stays. Results with warnings are shown, not
    stored: they come back with ``persist`` false.
    """
    c = cached.select(
        "track_id", F.col("model_version").alias("_cv"), F.col("downbeat_model_version").alias("_cd"), F.col("modes").alias("_cm"),
        F.col("has_rhythm").alias("_cr"), F.lit(True).alias("_have"))
    both = c.join(incoming.withColumn("_new", F.lit(True)), "track_id", "full_outer")
    have, new = F.coalesce("_have", F.lit(False)), F.coalesce("_new", F.lit(False))
    same = (F.col("_cv") == F.col("model_version")) & (F.col("_cd") == F.col("downbeat_model_version"))
    reason = (
        F.when(have & new & F.col("has_rhythm"), "repeated rhythm").when(have & new & ~same, "model version mismatch")
        .when(~have & new & ~F.col("has_rhythm"), "rhythm missing")
    )
    judged = both.withColumn("reason", reason)
    rejected = judged.where(F.col("reason").isNotNull()).select("track_id", "reason")
    kept = F.map_filter("_cm", lambda k, _: ~F.array_contains(F.map_keys("modes"), k))
    usable = new & F.col("reason").isNull()
    merged = judged.where(have | usable).select(
        "track_id", F.coalesce("_cv", "model_version").alias("model_version"), F.coalesce("_cd", "downbeat_model_version").alias("downbeat_model_version"),
        F.coalesce("_cr", "has_rhythm").alias("has_rhythm"),
        F.when(have & usable, F.map_concat(kept, "modes")).when(have, F.col("_cm")).otherwise(F.col("modes")).alias("modes"),
        F.when(usable, F.size("warnings") == 0).otherwise(F.lit(True)).alias("persist"),
    )
    return merged, rejected
