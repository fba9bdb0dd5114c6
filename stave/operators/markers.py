"""Marker lanes: derived ends, look-ups and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.functions.vocabulary import MAX_MARKERS
from stave.operators.timeline import annotate, asof

ORDER = ["start_s", "marker_id"]


def sorted_markers(markers: DataFrame) -> DataFrame:
    """Markers in display order: by track, start, id."""
    return markers.orderBy("track_id", *ORDER)


def marker_ends(markers: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each marker's index and shown end: its own, the next start or the track's end, whichever comes first."""
    lane = annotate(markers, ["track_id"], ORDER, ordinal="idx", lead={"_next": F.col("start_s")})
    spans = tracks.select("track_id", "duration_s")
    following = F.coalesce("_next", "duration_s")
    shown = F.greatest(F.col("start_s"), F.least("duration_s", following, F.coalesce("end_s", following)))
    return lane.join(spans, "track_id").withColumn("shown_end_s", shown).drop("_next")


def active_marker(positions: DataFrame, ended: DataFrame) -> DataFrame:
    """Marker holding each position. Shown ends never pass the next start, so the last one started decides."""
    found = asof(
        positions, ended.select("track_id", "idx", "marker_id", "start_s", "shown_end_s"), ["track_id"], F.col("t_s"),
        F.col("start_s"), ["idx", "marker_id", "shown_end_s"], ties=["idx"], before="_h",
    )
    inside = F.col("t_s") < F.col("_h.shown_end_s")
    return found.select(
        *positions.columns, F.when(inside, F.col("_h.idx")).alias("idx"), F.when(inside, F.col("_h.marker_id")).alias("marker_id")
    )


def edge_snap(regions: DataFrame, tracks: DataFrame, minimum: float = 0.05) -> DataFrame:
    """Where each region edge goes when stretched to its neighbour; null when too little would remain.

    ``regions``: track_id, region_id, start_s, end_s.
    """
    lane = annotate(
        regions, ["track_id"], ["start_s", "region_id"], lag={"_pe": F.col("end_s")}, lead={"_ns": F.col("start_s")}
    ).join(tracks.select("track_id", "duration_s"), "track_id")
    left, right = F.coalesce("_pe", F.lit(0.0)), F.coalesce("_ns", "duration_s")
    return lane.select(
        "track_id", "region_id",
        F.when(left <= F.col("end_s") - minimum, left).alias("snapped_start_s"),
        F.when(right >= F.col("start_s") + minimum, right).alias("snapped_end_s"),
    )


def default_region_end(starts: DataFrame, ranges: DataFrame, tracks: DataFrame) -> DataFrame:
    """End of a region opened at ``t_s``: the next start over 1 ms later, else the track's end."""
    found = asof(
        starts, ranges.select("track_id", "start_s"), ["track_id"], F.col("t_s") + 0.001, F.col("start_s"), [],
        before=None, after="_n",
    )
    return found.join(tracks.select("track_id", "duration_s"), "track_id").select(
        *starts.columns, F.coalesce("_n.t", "duration_s").alias("end_s")
    )


def replace_markers(markers: DataFrame, changes: DataFrame) -> DataFrame:
    """Markers with rows of ``changes`` taking the place of the same id."""
    keys = ["track_id", "marker_id"]
    known = changes.join(markers.select(*keys), keys, "left_semi").select(*markers.columns)
    return markers.join(changes.select(*keys), keys, "left_anti").unionByName(known)


def insert_markers(markers: DataFrame, tracks: DataFrame, inserts: DataFrame) -> DataFrame:
    """Insert one marker per track; a marker it falls into is cut at the new start.

    An insert within 10 ms of an existing start, or into a full lane, is ignored.
    """
    spans = tracks.select("track_id", "duration_s").where(F.col("duration_s") > 0)
    placed = inserts.join(spans, "track_id").withColumn(
        "start_s", F.greatest(F.lit(0.0), F.least("start_s", F.greatest(F.lit(0.0), F.col("duration_s") - 0.05)))
    ).drop("duration_s")
    ended = marker_ends(markers, tracks)
    target = placed.select("track_id", F.col("start_s").alias("_new"))
    met = ended.join(target, "track_id").groupBy("track_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.abs(F.col("start_s") - F.col("_new")) < 0.01).alias("_near")
    )
    accepted = placed.join(met, "track_id", "left").where(
        (F.coalesce("_n", F.lit(0)) < MAX_MARKERS) & ~F.coalesce("_near", F.lit(False))
    ).select(*markers.columns)
    cut = (F.col("start_s") < F.col("_new")) & (F.col("shown_end_s") > F.col("_new"))
    shortened = ended.join(accepted.select("track_id", F.col("start_s").alias("_new")), "track_id", "left").withColumn(
        "end_s", F.when(F.coalesce(cut, F.lit(False)), F.col("_new")).otherwise(F.col("end_s"))
    ).select(*markers.columns)
    # markers of tracks outside the catalogue keep their rows
    rest = markers.join(spans.select("track_id"), "track_id", "left_anti")
    return shortened.unionByName(rest).unionByName(accepted)
