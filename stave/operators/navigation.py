"""Position look-ups and viewports over any anchor table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.operators.timeline import annotate, asof, nearest, overlap_join

TOLERANCE = 0.01


def adjacent_anchor(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Previous and next anchor of each position, clamped at both ends.

    ``anchors``: track_id, a_s. An anchor up to 10 ms ahead counts as reached.
    Before the first anchor both answers are the first; without anchors the
    position stays.
    """
    lane = annotate(
        anchors.select("track_id", "a_s").distinct(), ["track_id"], ["a_s"], lag={"_p": F.col("a_s")}, lead={"_n": F.col("a_s")}
    )
    both = asof(positions, lane, ["track_id"], F.col("t_s") + TOLERANCE, F.col("a_s"), ["_p", "_n"], before="_b", after="_f")

    def pick(step: str):
        return F.coalesce(F.when(F.col("_b").isNotNull(), F.coalesce(F.col(f"_b.{step}"), F.col("_b.t"))), F.col("_f.t"), F.col("t_s"))

    return both.select(*positions.columns, pick("_p").alias("prev_s"), pick("_n").alias("next_s"))


def nearest_anchor(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Nearest anchor of each position; equal distances go to the earlier one."""
    found = nearest(positions, anchors, ["track_id"], F.col("t_s"), F.col("a_s"))
    return found.select(*positions.columns, F.coalesce("hit.t", "t_s").alias("snapped_s"))


def snap_position(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Snap to the nearest anchor of the preferred mode, falling back to beats.

    ``positions`` carry ``mode``; ``anchors``: track_id, mode, a_s.
    """
    own = nearest(positions, anchors, ["track_id", "mode"], F.col("t_s"), F.col("a_s"))
    kept = own.select(*positions.columns, F.col("hit.t").alias("_own"))
    beats = anchors.where("mode = 'beat'").select("track_id", "a_s")
    back = nearest(kept, beats, ["track_id"], F.col("t_s"), F.col("a_s"))
    return back.select(*positions.columns, F.coalesce("_own", "hit.t", "t_s").alias("snapped_s"))


def lane_boundaries(*lanes: DataFrame) -> DataFrame:
    """Distinct finite starts and ends of several lanes (track_id, start_s, end_s)."""
    merged = None
    for lane in lanes:
        points = lane.select("track_id", F.explode(F.array("start_s", "end_s")).alias("boundary_s"))
        merged = points if merged is None else merged.unionByName(points)
    return merged.where(F.col("boundary_s").isNotNull() & (F.abs("boundary_s") < float("inf"))).distinct()


def snap_to_lanes(positions: DataFrame, boundaries: DataFrame, tolerance: float) -> DataFrame:
    """Nearest boundary within the tolerance (inclusive; the later of two equally near), else the position itself."""
    found = nearest(positions, boundaries, ["track_id"], F.col("t_s"), F.col("boundary_s"), later_wins=True)
    close = F.abs(F.col("hit.t") - F.col("t_s")) <= tolerance
    return found.select(*positions.columns, F.when(close, F.col("hit.t")).otherwise(F.col("t_s")).alias("snapped_s"))


def track_coverage(tracks: DataFrame, **lanes: DataFrame) -> DataFrame:
    """Navigation modes each track offers; ``time`` always, others where a lane has rows."""
    found = tracks.select("track_id", F.lit("time").alias("mode"))
    for mode, lane in lanes.items():
        have = lane.select("track_id").distinct()
        found = found.unionByName(
            tracks.select("track_id").join(have, "track_id", "left_semi").select("track_id", F.lit(mode).alias("mode"))
        )
    order = ["time", "beat", "chord", "marker", "lyrics"]
    modes = F.collect_set("mode").alias("_m")
    return found.groupBy("track_id").agg(modes).select(
        "track_id", F.array_join(F.filter(F.array(*[F.lit(m) for m in order]), lambda m: F.array_contains("_m", m)), ",").alias("modes")
    )


def viewport_overlap(intervals: DataFrame, viewports: DataFrame, width: float = 16.0) -> DataFrame:
    """Clip intervals to viewports; emits left and width in percent of the view.

    ``intervals``: track_id, lane, item_id, start_s, end_s; ``viewports``:
    track_id, viewport_id, zoom, start, duration_s. Markers are clipped in
    ratios of the duration, lyric lines additionally to the track.
    """
    views = viewports.where((F.col("duration_s") > 0) & (F.col("zoom") >= 1)).select(
        "track_id", "viewport_id", "zoom", F.col("start").alias("view_start"), "duration_s",
        (F.col("start") * F.col("duration_s")).alias("_from"),
        ((F.col("start") + 1 / F.col("zoom")) * F.col("duration_s")).alias("_to"),
    )
    # a hair of slack in the binned join; the exact test follows
    pairs = overlap_join(
        intervals.where(F.col("end_s") > F.col("start_s")), views, ["track_id"], (F.col("start_s"), F.col("end_s")),
        (F.col("_from") - 1e-6, F.col("_to") + 1e-6), width,
    )
    lyric = F.col("lane") == "lyrics"
    low = F.when(lyric, F.greatest(F.lit(0.0), "_from", "start_s")).otherwise(F.greatest("_from", "start_s"))
    high = F.when(lyric, F.least("duration_s", "_to", "end_s")).otherwise(F.least("_to", "end_s"))
    return pairs.where(high > low).select(
        "track_id", "viewport_id", "lane", "item_id",
        ((low / F.col("duration_s") - F.col("view_start")) * F.col("zoom") * 100).alias("left_percent"),
        ((high - low) / F.col("duration_s") * F.col("zoom") * 100).alias("width_percent"),
    )
