"""Lyric lines and words over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.operators.timeline import annotate, asof


def sync_levels(lines: DataFrame, words: DataFrame) -> DataFrame:
    """Per document: number of lines and whether it is timed by word, by line or not at all."""
    worded = words.select("track_id").distinct().withColumn("_w", F.lit(True))
    return (
        lines.groupBy("track_id")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.col("start_ms").isNotNull()).alias("_l"))
        .join(worded, "track_id", "left")
        .select("track_id", "n_lines", F.when(F.col("_w"), "word").when(F.col("_l"), "line").otherwise("none").alias("sync_level"))
    )


def lyric_line_ends(lines: DataFrame, durations: DataFrame) -> DataFrame:
    """Missing ends become the next timed line's start, else the duration if later than the start."""
    nxt = annotate(lines, ["track_id"], ["line_no"], lead={"_n": F.col("start_ms")})
    later = annotate(nxt, ["track_id"], ["line_no"], upcoming={"_next": F.col("_n")}).join(durations, "track_id", "left")
    end = F.coalesce("_next", F.when(F.col("duration_ms") > F.col("start_ms"), F.col("duration_ms")))
    return later.withColumn(
        "end_ms", F.when(F.col("start_ms").isNotNull() & F.col("end_ms").isNull(), end).otherwise(F.col("end_ms"))
    ).drop("_n", "_next", "duration_ms")


def active_lyric_line(positions: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Line sounding at each position (track_id, query_id, now_ms), null between lines or when untimed."""
    shifted = positions.join(docs.select("track_id", "offset_ms", "sync_level"), "track_id").where("sync_level <> 'none'")
    timed = lines.where(F.col("start_ms").isNotNull()).select("track_id", "line_no", "start_ms", "end_ms")
    at = F.col("now_ms") - F.col("offset_ms")
    found = asof(shifted, timed, ["track_id"], at, F.col("start_ms"), ["line_no", "end_ms"], ties=["line_no"], before="_h")
    over = F.col("_h.end_ms").isNotNull() & (at >= F.col("_h.end_ms"))
    return found.select(
        *positions.columns, at.alias("at_ms"), F.when(~over, F.col("_h.line_no")).alias("line_no")
    )


def active_lyric_word(active: DataFrame, lines: DataFrame) -> DataFrame:
    """Word sounding within each active line; -1 before its first word.

    ``lines`` hold their words as an array, of which only the starts travel, once a line.
    """
    lit = active.where(F.col("line_no").isNotNull())
    timed = lines.where(F.size("words") > 0).select("track_id", "line_no", F.col("words.start_ms").alias("_starts"))
    begun = F.filter(F.transform("_starts", lambda start, i: F.struct(start.alias("at"), i.alias("no"))), lambda w: w["at"] <= F.col("at_ms"))
    # the latest start, and of equal ones the last word
    return lit.join(timed.hint("merge"), ["track_id", "line_no"], "left").select(
        *[F.col(n) for n in active.columns], F.coalesce(F.array_max(begun)["no"], F.lit(-1)).cast("int").alias("word_no"))


def estimated_line(positions: DataFrame, docs: DataFrame) -> DataFrame:
    """Line of an untimed document, as if lines were spread evenly over the track."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("now_ms") / F.col("duration_ms")))
    return (
        positions.join(docs.where("sync_level = 'none' AND n_lines > 0 AND duration_ms > 0"), "track_id")
        .select(*positions.columns, F.least(F.col("n_lines") - 1, F.floor(share * F.col("n_lines"))).alias("line_no"))
    )


def line_progress(active: DataFrame, docs: DataFrame, lines: DataFrame) -> DataFrame:
    """How far each active line has been played, 0 to 1."""
    nxt = annotate(
        lines.select("track_id", "line_no", "start_ms", "end_ms"), ["track_id"], ["line_no"], lead={"_next": F.col("start_ms")}
    )
    rows = active.where(F.col("line_no").isNotNull()).join(nxt, ["track_id", "line_no"]).join(
        docs.select("track_id", "offset_ms", "duration_ms"), "track_id"
    )
    start = F.col("start_ms") + F.col("offset_ms")
    end = F.coalesce("end_ms", "_next", "duration_ms") + F.col("offset_ms")
    share = (F.col("now_ms") - start) / F.when(end > start, end - start)
    progress = F.when(end > start, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(
        F.when(F.col("now_ms") >= start, 1.0).otherwise(0.0)
    )
    return rows.select("track_id", "query_id", "line_no", progress.alias("progress"))


def lyric_nav_points(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Line starts in seconds, offset applied, inside the track."""
    at = (F.col("start_ms") + F.col("offset_ms")) / 1000.0
    return (
        lines.where(F.col("start_ms").isNotNull())
        .join(docs.select("track_id", "offset_ms", "duration_ms"), "track_id")
        .where((at >= 0) & (at <= F.col("duration_ms") / 1000.0))
        .select("track_id", "line_no", at.alias("point_s"))
    )


def lyric_spans(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Lyric lines as seconds intervals for viewports."""
    nxt = annotate(
        lines.select("track_id", "line_no", "start_ms", "end_ms"), ["track_id"], ["line_no"], lead={"_next": F.col("start_ms")}
    )
    end = F.least("end_ms", "_next", F.col("duration_ms") - F.col("offset_ms"))
    return (
        nxt.where(F.col("start_ms").isNotNull())
        .join(docs.where("sync_level <> 'none'").select("track_id", "offset_ms", "duration_ms"), "track_id")
        .select(
            "track_id", F.lit("lyrics").alias("lane"), F.col("line_no").cast("string").alias("item_id"),
            ((F.col("start_ms") + F.col("offset_ms")) / 1000.0).alias("start_s"), ((end + F.col("offset_ms")) / 1000.0).alias("end_s"),
        )
    )
