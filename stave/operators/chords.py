"""Chord timelines: boundaries, edits, views and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stave.functions import music
from stave.functions.scalars import score_band
from stave.operators.timeline import annotate, asof, keep_last, nearest

LANE = ["track_id", "mode"]


def segment_boundaries(chords: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Trim rounding overlaps: an end reaching past the next start by at most ``tolerance`` moves back to it."""
    following = annotate(chords, LANE, ["start_s", "idx"], lead={"_next": F.col("start_s")})
    over = F.col("end_s") - F.col("_next")
    trimmed = F.when((over > 0) & (over <= tolerance + 1e-9), F.col("_next")).otherwise(F.col("end_s"))
    return following.withColumn("end_s", trimmed).drop("_next")


def with_compact_labels(chords: DataFrame) -> DataFrame:
    return chords.withColumn("label", music.harte_to_compact(F.col("source_label")))


def apply_chord_edits(chords: DataFrame, edits: DataFrame) -> DataFrame:
    """Overlay edited labels on exactly matching segments; the last edit of a segment wins."""
    span = [*LANE, "start_s", "end_s"]
    latest = keep_last(edits.select(*span, F.col("label").alias("_label"), "edit_seq"), span, ["edit_seq"]).drop("edit_seq")
    changed = F.col("_label").isNotNull()
    return (
        chords.join(latest, span, "left")
        .withColumn("edited", changed)
        .withColumn("label", F.coalesce("_label", "label"))
        .withColumn("source_label", F.coalesce("_label", "source_label"))
        .drop("_label")
    )


def visible_chords(chords: DataFrame, minimum: float) -> DataFrame:
    return chords.where(F.col("edited") | (F.col("strength") >= minimum))


def _playable(label: Column) -> Column:
    return ~label.isin("N", "-")


def chord_statistics(chords: DataFrame) -> DataFrame:
    """Per track and label: time, share of the track's chord time, occurrences and top strength."""
    span = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    per_label = (
        chords.where(_playable(F.col("label")))
        .withColumn("span_s", span)
        .where((F.col("span_s") > 0) & (F.col("span_s") < float("inf")))
        .groupBy("track_id", "label")
        .agg(
            F.sum("span_s").alias("duration_s"), F.count(F.lit(1)).alias("occurrences"), F.max("strength").alias("strength")
        )
    )
    # one row per label of the chord vocabulary is left, so a track's window is small
    total = F.sum("duration_s").over(Window.partitionBy("track_id"))
    return per_label.withColumn("share", F.col("duration_s") / total)


def chord_repertoire(chords: DataFrame) -> DataFrame:
    return chords.where(_playable(F.col("label"))).select("track_id", "label").distinct()


def score_bands(chords: DataFrame) -> DataFrame:
    return chords.withColumn("band", score_band(F.col("label"), F.col("strength")))


def active_chord(positions: DataFrame, chords: DataFrame, lead: float = 0.01) -> DataFrame:
    """Chord sounding at each position, looked up slightly ahead; null between chords."""
    at = F.col("t_s") + F.lit(max(0.0, lead))
    found = asof(
        positions, chords, ["track_id"], at, F.col("start_s"), ["idx", "label", "end_s"], ties=["idx"], before="_hit"
    )
    inside = at < F.col("_hit.end_s")
    return found.withColumn("idx", F.when(inside, F.col("_hit.idx"))).withColumn(
        "label", F.when(inside, F.col("_hit.label"))
    ).drop("_hit")


def adjacent_chord(positions: DataFrame, chords: DataFrame) -> DataFrame:
    """Start of the previous and next chord for transport.

    Inside a chord (with 10 ms of grace before its start) the neighbours are by
    index. Elsewhere they are the nearest starts more than 10 ms away. Overlaps
    are resolved to the latest chord holding the position, so an earlier one
    still sounding counts when the last started one has ended.
    """
    lane = annotate(
        chords.select("track_id", "idx", "start_s", "end_s"), ["track_id"], ["start_s", "idx"],
        ordinal="_n", lag={"_prev": F.col("start_s")}, lead={"_next": F.col("start_s")},
    )
    t = F.col("t_s")
    tagged = positions.withColumn("_key", F.monotonically_increasing_id()) if "query_id" not in positions.columns else positions
    holder = _latest_holding(tagged, lane)
    inside = holder.where(F.col("_idx").isNotNull())
    outside = holder.where(F.col("_idx").isNull())
    near = inside.select(
        *positions.columns,
        F.coalesce("_prev", "_start").alias("prev_s"), F.coalesce("_next", "_start").alias("next_s"),
    )
    base = outside.select(*positions.columns)
    back = asof(base, lane, ["track_id"], t - 0.01, F.col("start_s"), [], ties=["idx"], before="_b", equal="after")
    both = asof(back, lane, ["track_id"], t + 0.01, F.col("start_s"), [], ties=["idx"], before=None, after="_f")
    far = both.select(
        *positions.columns, F.coalesce("_b.t", t).alias("prev_s"), F.coalesce("_f.t", t).alias("next_s")
    )
    return near.unionByName(far)


def _latest_holding(positions: DataFrame, lane: DataFrame) -> DataFrame:
    """Latest chord with start - 10 ms <= t < end.

    Almost always that is the last one started. Only where it has ended already
    can an earlier, longer chord hold the position; those few positions go
    through the binned overlap join.
    """
    from stave.operators.timeline import overlap_join

    names = positions.columns
    payload = ["idx", "start_s", "end_s", "_prev", "_next"]
    # the grace is applied to the start, as t >= start - 0.01 is not the same comparison as t + 0.01 >= start
    opened = lane.withColumn("_open", F.col("start_s") - 0.01)
    peaked = annotate(opened, ["track_id"], ["start_s", "idx"], peak={"_reach": F.col("end_s")})
    first = asof(
        positions, peaked, ["track_id"], F.col("t_s"), F.col("_open"), [*payload, "_reach"], ties=["idx"], before="_h"
    )
    holds = F.col("t_s") < F.col("_h.end_s")
    direct = first.select(
        *names,
        F.when(holds, F.col("_h.idx")).alias("_idx"), F.when(holds, F.col("_h.start_s")).alias("_start"),
        F.when(holds, F.col("_h._prev")).alias("_prev"), F.when(holds, F.col("_h._next")).alias("_next"),
        (~holds & (F.col("t_s") < F.col("_h._reach"))).alias("_deeper"),
    )
    settled = direct.where(~F.coalesce("_deeper", F.lit(False))).drop("_deeper")
    deeper = direct.where("_deeper").select(*names)
    point = deeper.withColumn("_t0", F.col("t_s"))
    pairs = overlap_join(
        opened.select("track_id", *payload, "_open"), point, ["track_id"], (F.col("_open"), F.col("end_s")),
        (F.col("_t0"), F.col("_t0") + 1e-9), 16.0,
    ).where((F.col("_open") <= F.col("t_s")) & (F.col("t_s") < F.col("end_s")))
    best = pairs.groupBy(*names).agg(F.max_by(F.struct(*payload), F.col("idx")).alias("_h"))
    found = best.select(
        *names, F.col("_h.idx").alias("_idx"), F.col("_h.start_s").alias("_start"),
        F.col("_h._prev").alias("_prev"), F.col("_h._next").alias("_next"),
    )
    # every deeper position is held by some earlier chord, since its reach lies beyond it
    return settled.unionByName(found)


def chord_beat_counts(chords: DataFrame, beats: DataFrame) -> DataFrame:
    """How many beats each chord owns; a beat claimed twice goes to the later chord.

    A chord covers beat indexes from the one nearest its start to the one
    nearest its end. Chords in start order claim index ranges, and the last claim
    on a beat wins, so ownership is a latest-start-wins lookup per beat index.
    """
    valid = chords.where(
        F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & (F.col("end_s") > F.col("start_s"))
    ).select("track_id", "idx", "start_s", "end_s")
    lane = annotate(
        beats.select("track_id", "beat_s").distinct(), ["track_id"], ["beat_s"], ordinal="n", lag={"_gap0": F.col("beat_s")}
    ).withColumn("_step", F.col("beat_s") - F.col("_gap0"))

    def boundary(df: DataFrame, t: str, out: str) -> DataFrame:
        names = df.columns
        # strictly before on one side, at or after on the other
        both = asof(df, lane, ["track_id"], F.col(t), F.col("beat_s"), ["n", "_step"], before="_b", after="_f", equal="after")
        gap = F.col(t) - F.col("_b.t")
        inner = F.when(gap < F.col("_f.t") - F.col(t), F.col("_b.n")).otherwise(F.col("_f.n"))
        beyond = (
            F.when(F.col("_b._step").isNull(), F.when(F.col(t) > F.col("_b.t"), F.col("_b.n") + 1).otherwise(F.lit(0)))
            .when(gap < F.col("_b.t") + F.col("_b._step") - F.col(t), F.col("_b.n"))
            .otherwise(F.col("_b.n") + 1)
        )
        index = (
            F.when(F.col("_b").isNull() & F.col("_f").isNull(), F.lit(None))
            .when(F.col("_b").isNull(), F.lit(0)).when(F.col("_f").isNull(), beyond).otherwise(inner)
        )
        return both.select(*names, index.cast("bigint").alias(out))

    ranged = boundary(boundary(valid, "start_s", "_first"), "end_s", "_after").where(F.col("_after") > F.col("_first"))
    owned = (
        ranged.select("track_id", "idx", "start_s", F.explode(F.sequence(F.col("_first"), F.col("_after") - 1)).alias("_beat"))
        .groupBy("track_id", "_beat")
        .agg(F.max_by("idx", F.struct("start_s", "idx")).alias("idx"))
    )
    counts = owned.groupBy("track_id", "idx").agg(F.count(F.lit(1)).alias("beat_count"))
    return chords.select("track_id", "idx").join(counts, ["track_id", "idx"], "left").withColumn(
        "beat_count", F.coalesce("beat_count", F.lit(0))
    )


def materialize_regions(chords: DataFrame, tracks: DataFrame, minimum: float = 0.05) -> DataFrame:
    """Editable regions: each starts where the last kept one ended at the earliest; slivers are dropped.

    A chord starting at or after every earlier end does not depend on what was
    kept before it. Those chords cut a track into runs of overlapping chords, and
    only inside a run is the rule applied step by step.
    """
    bounded = chords.join(tracks.select("track_id", "duration_s"), "track_id").withColumn(
        "end_c", F.least("duration_s", "end_s")
    )
    reach = annotate(bounded, ["track_id"], ["start_s", "idx"], peak={"_reach": F.col("end_c")})
    opens = F.when(F.col("_reach").isNull() | (F.col("start_s") >= F.col("_reach")), 1).otherwise(0)
    runs = annotate(reach.withColumn("_open", opens), ["track_id"], ["start_s", "idx"], running={"_run": F.col("_open")})
    item = F.struct("start_s", "idx", "end_c", "label")
    folded = runs.groupBy("track_id", "_run").agg(F.array_sort(F.collect_list(item)).alias("_items")).withColumn(
        "_kept",
        F.aggregate(
            "_items",
            F.struct(F.lit(0.0).alias("at"), F.array().cast(
                "array<struct<idx:bigint,label:string,start_s:double,end_s:double>>").alias("out")),
            lambda acc, c: F.when(
                c["end_c"] - F.greatest(acc["at"], c["start_s"]) >= minimum,
                F.struct(
                    c["end_c"].alias("at"),
                    F.concat(acc["out"], F.array(F.struct(
                        c["idx"].cast("bigint").alias("idx"), c["label"].alias("label"),
                        F.greatest(acc["at"], c["start_s"]).alias("start_s"), c["end_c"].alias("end_s"),
                    ))).alias("out"),
                ),
            ).otherwise(acc),
        ),
    )
    return folded.select("track_id", F.inline("_kept.out"))


def edits_upsert(chords: DataFrame, edits: DataFrame, requests: DataFrame) -> DataFrame:
    """The edit table after requests to relabel one chord, or every chord of the same label.

    ``requests``: track_id, mode, start_s, end_s, replacement, replace_all; one
    per (track, mode).
    """
    span = [*LANE, "start_s", "end_s"]
    effective = apply_chord_edits(chords, edits).withColumn("_canon", music.canonical(F.col("label")))
    wanted = requests.select(*span, "replacement", "replace_all")
    chosen = effective.join(wanted, span).select(
        *LANE, F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("_canon").alias("_want"), "replacement", "replace_all"
    )
    same_label = F.when(F.col("replace_all"), F.col("_canon") == F.col("_want")).otherwise(
        (F.col("start_s") == F.col("_s")) & (F.col("end_s") == F.col("_e"))
    )
    targets = effective.select(*span, "_canon").join(chosen, LANE).where(same_label).select(*span, "replacement")
    # the original label decides whether a replacement is an edit at all
    fresh = (
        chords.select(*span, F.col("label").alias("_own")).join(targets, span)
        .where(music.canonical(F.col("_own")) != music.canonical(F.col("replacement")))
        .select(*span, F.col("replacement").alias("label"))
    )
    kept = edits.join(targets.select(*span), span, "left_anti").select(*span, "label")
    return kept.unionByName(fresh)


def segment_frame_scores(chords: DataFrame, frames: DataFrame, hop_s: float, width: int = 64) -> DataFrame:
    """Mean probability of each segment's native class over its frames, null for a segment without frames.

    ``frames``: track_id, frame, probs. Segments are spread over frame bins, the
    sums are made per bin and added up, so a long segment spreads over tasks.
    """
    last = frames.groupBy("track_id").agg((F.max("frame") + 1).alias("_n"))
    first = F.greatest(F.lit(0), F.rint(F.col("start_s") / hop_s).cast("bigint"))
    spans = (
        chords.join(last, "track_id")
        .withColumn("_first", first)
        .withColumn("_last", F.least("_n", F.greatest(F.col("_first") + 1, F.rint(F.col("end_s") / hop_s).cast("bigint"))))
        .withColumn("_class", music.triad_class(F.col("source_label")))
        .where(F.col("_last") > F.col("_first"))
        .select("track_id", "idx", "_first", "_last", "_class")
        .withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_first") / width), F.floor((F.col("_last") - 1) / width))))
    )
    binned = frames.withColumn("_bin", F.floor(F.col("frame") / width))
    hit = (F.col("frame") >= F.col("_first")) & (F.col("frame") < F.col("_last"))
    scores = (
        spans.join(binned, ["track_id", "_bin"]).where(hit)
        .groupBy("track_id", "idx")
        .agg(F.avg(F.element_at("probs", (F.col("_class") + 1).cast("int"))).alias("score"))
    )
    return chords.select("track_id", "idx").join(scores, ["track_id", "idx"], "left")
