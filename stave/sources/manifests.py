"""Project manifests and their nested arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stave import schemas as S


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file with ``reason`` set where it must be set aside.

    Only the listing's sizes are looked at for oversized files; the rest are
    parsed with the explicit schema.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sized = files.select("path", "length").where(F.col("length") > S.MAX_MANIFEST_BYTES).select(
        "path", F.lit("too large").alias("reason"))
    texts = files.where(F.col("length") <= S.MAX_MANIFEST_BYTES).select("path", F.decode("content", "UTF-8").alias("json"))
    return parse_manifests(texts).unionByName(sized, allowMissingColumns=True)


def parse_manifests(texts: DataFrame) -> DataFrame:
    """Manifests from (path, json) rows."""
    parsed = texts.withColumn(
        "m", F.from_json("json", S.MANIFEST, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    )
    reason = (
        F.when(F.col("m").isNull() | F.col("m._corrupt").isNotNull() | F.col("m.formatVersion").isNull(), "invalid metadata")
        .when(F.col("m.formatVersion") != S.FORMAT_VERSION, "unsupported version")
    )
    return parsed.select("path", "m", reason.alias("reason"))


def projects(manifests: DataFrame) -> DataFrame:
    good = manifests.where("reason IS NULL")
    return good.select(
        F.col("m.id").alias("project_id"), F.col("m.formatVersion").alias("format_version"), F.col("m.name").alias("name"),
        F.col("m.createdAt").alias("created_at"), F.col("m.updatedAt").alias("updated_at"),
    )


def track_rows(manifests: DataFrame) -> DataFrame:
    """One row per track with its position and raw practice struct."""
    good = manifests.where("reason IS NULL")
    return good.select(F.col("m.id").alias("project_id"), F.posexplode("m.tracks").alias("position", "t")).select(
        "project_id", F.col("t.id").alias("track_id"), "position", F.col("t.title").alias("title"), F.col("t.sourcePath").alias("source_path"),
        F.col("t.originalSourcePath").alias("original_source_path"), F.col("t.format").alias("format"),
        F.col("t.fileSizeBytes").alias("file_size_bytes"), F.col("t.durationSeconds").alias("duration_s"),
        F.col("t.sampleRate").alias("sample_rate"), F.col("t.channels").alias("channels"), F.col("t.practice").alias("practice"),
    )


def _snake(name: str) -> str:
    text = "".join("_" + c.lower() if c.isupper() else c for c in name)
    return text.replace("_seconds", "_s")


def practice(tracks: DataFrame) -> DataFrame:
    """Scalar settings per track with defaults for missing fields."""
    scalars = [
        F.coalesce(F.col(f"practice.{name}"), F.lit(value)).alias(_snake(name)) for name, value in S.PRACTICE_DEFAULTS.items()
    ]
    return tracks.select(
        "track_id", *scalars, F.col("practice.loopASeconds").alias("loop_a_s"), F.col("practice.loopBSeconds").alias("loop_b_s"),
        F.col("practice.beatThisDbn").alias("beat_this_dbn"),
    )


def markers(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", F.explode("practice.markers").alias("m")).select(
        "track_id", F.col("m.id").alias("marker_id"), F.col("m.label").alias("label"), F.col("m.startSeconds").alias("start_s"),
        F.col("m.endSeconds").alias("end_s"), F.col("m.origin").alias("origin"),
    )


def chord_edits(tracks: DataFrame) -> DataFrame:
    return tracks.select("track_id", F.posexplode("practice.chordEdits").alias("edit_seq", "e")).select(
        "track_id", F.col("e.mode").alias("mode"), F.col("e.startSeconds").alias("start_s"), F.col("e.endSeconds").alias("end_s"),
        F.col("e.label").alias("label"), F.col("edit_seq").cast("bigint").alias("edit_seq"),
    )


def chord_regions(tracks: DataFrame) -> DataFrame:
    timelines = tracks.select("track_id", F.explode("practice.chordTimelines").alias("t"))
    return timelines.select("track_id", F.col("t.mode").alias("mode"), F.explode("t.regions").alias("r")).select(
        "track_id", "mode", F.col("r.id").alias("region_id"), F.col("r.label").alias("label"),
        F.col("r.startSeconds").alias("start_s"), F.col("r.endSeconds").alias("end_s"),
    )


def stems_valid(mix: Column) -> Column:
    """Four stems, or six from older documents; a missing array means defaults."""
    return mix.isNull() | F.size(mix).isin(4, 6)


def stem_mix(tracks: DataFrame) -> DataFrame:
    """First four stem settings of tracks whose array has a valid length."""
    fallback = F.array(*[
        F.struct(F.lit(1.0).alias("gain"), F.lit(0.0).alias("pan"), F.lit(False).alias("muted"), F.lit(False).alias("soloed"))
        for _ in range(4)
    ])
    mix = F.coalesce(F.slice("practice.stemMix", 1, 4), fallback)
    return tracks.where(stems_valid(F.col("practice.stemMix"))).select(
        "track_id", F.posexplode(mix).alias("stem", "s")).select("track_id", "stem", "s.gain", "s.pan", "s.muted", "s.soloed")


def rejected_stems(tracks: DataFrame) -> DataFrame:
    return tracks.where(~stems_valid(F.col("practice.stemMix"))).select("track_id", F.size("practice.stemMix").alias("n_stems"))
