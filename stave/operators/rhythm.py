"""Beat timelines: tempo, anomalies, homogenisation, local tempo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.operators.timeline import PROBE, annotate, asof, hot_keys
from stave.session import staged

# Fixed values of the tempo rules.
LOW, HIGH = 1 - 0.12, 1 + 0.12
MIN_INTERVAL, MAX_INTERVAL = 0.12, 2.0
MIN_RUN, MIN_RUN_BEATS = 3, 4
SAME_TIME = 0.001


def select_beat_source(beats: DataFrame, overrides: DataFrame, default_dbn: bool) -> DataFrame:
    """Rows of the timeline each track uses: its own choice, else the user's default.

    ``overrides``: track_id, beat_this_dbn (nullable).
    """
    wanted = F.when(F.coalesce("beat_this_dbn", F.lit(default_dbn)), "dbn").otherwise("raw")
    return (
        beats.join(overrides.select("track_id", "beat_this_dbn"), "track_id", "left")
        .where(F.col("source") == wanted)
        .drop("beat_this_dbn")
    )


def distinct_beats(beats: DataFrame) -> DataFrame:
    """One row per track and beat time, with the downbeat flag of any row at that time."""
    usable = (F.col("beat_s") >= 0) & (F.col("beat_s") < float("inf"))
    return beats.where(usable).groupBy("track_id", "beat_s").agg(F.max("is_downbeat").alias("is_downbeat"))


def with_intervals(beats: DataFrame, hot=PROBE) -> DataFrame:
    """Each beat but the last, with its index, the next beat and the interval to it."""
    return (
        annotate(beats, ["track_id"], ["beat_s"], ordinal="beat_idx", lead={"next_s": F.col("beat_s")}, hot=hot)
        .where(F.col("next_s").isNotNull())
        .withColumn("interval_s", F.col("next_s") - F.col("beat_s"))
    )


def global_bpm(beats: DataFrame) -> DataFrame:
    """Tempo from the median interval within [0.2, 2] s; null when there is none."""
    gaps = annotate(beats, ["track_id"], ["beat_s", "beat_idx"], lead={"next_s": F.col("beat_s")})
    gap = F.col("next_s") - F.col("beat_s")
    usable = F.when((gap >= 0.2) & (gap <= 2.0), gap)
    # percentile merges value counts map-side, so a hot track is not gathered row by row
    return gaps.groupBy("track_id").agg(F.round(60.0 / F.percentile(usable, F.lit(0.5)), 1).alias("bpm"))


def near_ratio(value: Column, reference: Column, ratio: float) -> Column:
    expected = reference * F.lit(float(ratio))
    return (value > 0) & (reference > 0) & (value >= expected * F.lit(LOW)) & (value <= expected * F.lit(HIGH))


def dominant_interval(intervals: DataFrame) -> DataFrame:
    """Per track, the median of the largest cluster of intervals within 12 % of one of them.

    Cluster sizes come from one sorted pass: each interval is queried at both
    ends of its band against the running count of intervals, so no interval is
    ever paired with another.
    """
    usable = intervals.where(F.col("interval_s").between(MIN_INTERVAL, MAX_INTERVAL))
    counts = usable.groupBy("track_id", F.col("interval_s").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    marks = counts.select(
        "track_id", "v", "n",
        F.explode(F.array(
            F.struct((F.col("v") * LOW).alias("at"), F.lit(0).alias("side")),
            F.struct(F.col("v").alias("at"), F.lit(1).alias("side")),
            F.struct((F.col("v") * HIGH).alias("at"), F.lit(2).alias("side")),
        )).alias("m"),
    ).select("track_id", "v", F.col("m.at").alias("at"), F.col("m.side").alias("side"),
             F.when(F.col("m.side") == 1, F.col("n")).otherwise(F.lit(0)).alias("w"))
    summed = annotate(marks, ["track_id"], ["at", "side", "v"], running={"seen": F.col("w")})
    sizes = summed.groupBy("track_id", "v").agg(
        (F.max(F.when(F.col("side") == 2, F.col("seen"))) - F.max(F.when(F.col("side") == 0, F.col("seen")))).alias("size")
    )
    best = sizes.groupBy("track_id").agg(F.max_by("v", F.struct("size", -F.col("v"))).alias("centre"), F.max("size").alias("size"))
    inside = counts.join(best, "track_id").where(
        (F.col("v") >= F.col("centre") * LOW) & (F.col("v") <= F.col("centre") * HIGH)
    )
    return inside.groupBy("track_id", "size").agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("dominant_s"))


def target_interval(intervals: DataFrame, mode: str = "auto") -> DataFrame:
    """The interval a timeline is brought to: dominant, or an eighth/sixteenth grid."""
    dominant = dominant_interval(intervals).select("track_id", "dominant_s")
    if mode == "auto":
        return dominant.withColumnRenamed("dominant_s", "target_s")
    usable = intervals.where(F.col("interval_s").between(MIN_INTERVAL, MAX_INTERVAL))
    slower = (
        usable.join(dominant, "track_id").where(near_ratio(F.col("interval_s"), F.col("dominant_s"), 2))
        .groupBy("track_id").agg(F.percentile("interval_s", F.lit(0.5)).alias("slow_s"))
    )
    coarse = F.coalesce("slow_s", "dominant_s")
    return dominant.join(slower, "track_id", "left").select(
        "track_id", (coarse if mode == "eighth" else coarse / 2).alias("target_s")
    )


def _flag_runs(intervals: DataFrame, ratio: float, out: str, hot=PROBE) -> DataFrame:
    """Number runs of consecutive intervals near ``ratio`` x target; null outside."""
    near = near_ratio(F.col("interval_s"), F.col("target_s"), ratio)
    numbered = annotate(
        intervals.withColumn("_off", F.when(near, 0).otherwise(1)), ["track_id"], ["beat_s"], running={out: F.col("_off")},
        hot=hot,
    )
    return numbered.withColumn(out, F.when(F.col("_off") == 0, F.col(out))).drop("_off")


def _kept_runs(flagged: DataFrame, run: str) -> DataFrame:
    return (
        flagged.where(F.col(run).isNotNull())
        .groupBy("track_id", run)
        .agg(
            F.min("beat_idx").alias("first_interval"), F.count(F.lit(1)).alias("n_intervals"),
            F.sum("interval_s").alias("span_s"), F.first("target_s").alias("target_s"),
        )
        .where((F.col("n_intervals") >= MIN_RUN) & (F.col("span_s") >= F.col("target_s") * MIN_RUN_BEATS))
    )


def tempo_anomaly_runs(intervals: DataFrame, targets: DataFrame) -> DataFrame:
    """Sustained runs at half or double the target interval."""
    aimed = intervals.join(targets, "track_id")
    parts = []
    for ratio in (0.5, 2.0):
        runs = _kept_runs(_flag_runs(aimed, ratio, "run"), "run")
        parts.append(runs.select("track_id", F.lit(ratio).alias("ratio"), "first_interval", "n_intervals", "span_s"))
    return parts[0].unionByName(parts[1])


def homogenize_beats(beats: DataFrame, mode: str = "auto") -> DataFrame:
    """Beats with half-interval runs thinned and double-interval runs filled.

    Away from a dense run every interval only depends on its own two beats and
    stays native. A dense run is thinned step by step, but its state is known
    again two ordinary intervals later, so only such stretches are folded, each
    as its own group.
    """
    source = distinct_beats(beats)
    if mode == "off":
        return source.select("track_id", "beat_s", "is_downbeat")
    source = staged(source, "beats")
    hot = hot_keys(source, ["track_id"], "beat_s")
    # a beat counts as downbeat when one lies within a millisecond
    mark = {"_m": F.when(F.col("is_downbeat"), F.col("beat_s"))}
    marked = annotate(source, ["track_id"], ["beat_s"], last={"_l": mark["_m"]}, upcoming={"_u": mark["_m"]}, hot=hot)
    close = F.least(F.col("beat_s") - F.col("_l"), F.col("_u") - F.col("beat_s")) <= SAME_TIME
    flagged = marked.select("track_id", "beat_s", F.coalesce(close, F.lit(False)).alias("down"))
    lane = staged(annotate(
        flagged, ["track_id"], ["beat_s"], ordinal="beat_idx",
        lead={"next_s": F.col("beat_s"), "next_down": F.col("down")}, lag={"came_s": F.col("beat_s")}, hot=hot,
    ), "lane")
    intervals = lane.where(F.col("next_s").isNotNull()).withColumn("interval_s", F.col("next_s") - F.col("beat_s"))
    aimed = intervals.join(target_interval(intervals, mode), "track_id", "left")
    runs = staged(_flag_runs(_flag_runs(aimed, 0.5, "_d", hot), 2.0, "_s", hot), "runs")
    kept_d = _kept_runs(runs, "_d").select("track_id", "_d", F.lit(True).alias("dense"))
    kept_s = _kept_runs(runs, "_s").select("track_id", "_s", F.lit(True).alias("sparse"))
    judged = runs.join(kept_d, ["track_id", "_d"], "left").join(kept_s, ["track_id", "_s"], "left").select(
        "track_id", "beat_idx", "beat_s", "down", "next_s", "next_down", "came_s", "target_s",
        F.coalesce("dense", F.lit(False)).alias("dense"), F.coalesce("sparse", F.lit(False)).alias("sparse"),
    )
    # before interval i the state is known when intervals i-1 and i-2 are not dense, or i is the first
    before = {"was_dense": F.col("dense"), "was_sparse": F.col("sparse")}
    seen = annotate(judged, ["track_id"], ["beat_s"], lag=before, hot=hot)
    seen = annotate(seen, ["track_id"], ["beat_s"], lag={"_ppd": F.col("was_dense")}, hot=hot)
    no = F.lit(False)
    known = (F.col("beat_idx") == 0) | (~F.coalesce("was_dense", no) & ~F.coalesce("_ppd", no))
    cut = staged(annotate(
        seen.withColumn("_k", F.when(known, 1).otherwise(0)), ["track_id"], ["beat_s"], running={"seg": F.col("_k")}, hot=hot
    ), "stretches")
    touched = cut.where("dense").select("track_id", "seg").distinct()
    out = F.struct(F.col("next_s").alias("beat_s"), F.col("next_down").alias("is_downbeat"))
    middle = F.struct((F.col("beat_s") + (F.col("next_s") - F.col("beat_s")) / 2).alias("beat_s"), no.alias("is_downbeat"))
    plain = cut.join(touched, ["track_id", "seg"], "left_anti").select(
        "track_id", F.inline(F.when(F.col("sparse"), F.array(middle, out)).otherwise(F.array(out))))
    folded = staged(
        cut.join(touched, ["track_id", "seg"], "left_semi").groupBy("track_id", "seg").applyInPandas(
            _thin, "track_id string, beat_s double, is_downbeat boolean, replaces double"), "thinned")
    firsts = lane.where("beat_idx = 0").select("track_id", "beat_s", F.col("down").alias("is_downbeat"))
    made = firsts.unionByName(plain).unionByName(folded.where("beat_s IS NOT NULL").drop("replaces"))
    # a downbeat may take the place of a beat emitted before its stretch began
    replaced = folded.where("replaces IS NOT NULL").select("track_id", F.col("replaces").alias("beat_s"))
    return made.join(replaced, ["track_id", "beat_s"], "left_anti")


def _thin(pdf: pd.DataFrame) -> pd.DataFrame:
    """Thin one stretch: keep beats a target apart, preferring downbeats.

    The beats kept so far are a pile of (time, downbeat). A beat outside dense runs goes
    on top, above the middle that fills a sparse gap. One of a dense run takes the place of
    a plain top if it is a downbeat a target after the beat below, or goes on top if it
    is far enough from it, or is dropped.
    """
    rows = pdf.sort_values("beat_s")
    head, target = rows.iloc[0], float(rows["target_s"].iloc[0])
    base = (float(head["beat_s"]), bool(head["down"]))
    pile = [base]
    if head["beat_idx"] > 0:
        came = float(head["came_s"])
        pile.insert(0, ((came + base[0]) / 2 if head["was_sparse"] else came, False))
    settled = len(pile)
    for time, down, dense, sparse in zip(rows["next_s"], rows["next_down"], rows["dense"], rows["sparse"]):
        (top, top_down), below = pile[-1], pile[-2][0] if len(pile) > 1 else None
        takes = dense and down and not top_down and (below is None or target * LOW <= time - below <= target * HIGH)
        if takes:
            pile[-1] = (float(time), True)
        elif not dense or time - top >= target * LOW:
            pile.extend([(top + (time - top) / 2, False)] * bool(sparse and not dense) + [(float(time), bool(down))])
    # A downbeat may have taken the place of the beat the stretch began with.
    swapped = pile[settled - 1] != base
    made = pile[settled - swapped:] or [(None, None)]
    return pd.DataFrame({
        "track_id": head["track_id"], "beat_s": [m[0] for m in made], "is_downbeat": [m[1] for m in made],
        "replaces": [base[0] if swapped else None] + [None] * (len(made) - 1),
    })


def homogenized_bpm(homogenized: DataFrame) -> DataFrame:
    gaps = annotate(homogenized, ["track_id"], ["beat_s"], lead={"next_s": F.col("beat_s")})
    gap = F.col("next_s") - F.col("beat_s")
    return gaps.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_beats"), (60.0 / F.percentile(F.when(gap > 0, gap), F.lit(0.5))).alias("bpm")
    )


def local_bpm(positions: DataFrame, beats: DataFrame, rate: float = 1.0) -> DataFrame:
    """Tempo around each position from at most eight intervals.

    The estimate only depends on which beat comes next, so it is made once per
    beat (plus once for positions after the last beat) and looked up as-of.
    ``beats``: track_id, beat_idx, beat_s.
    """
    counts = beats.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"))
    spread = (
        beats.select("track_id", "beat_idx", "beat_s")
        .withColumn("centre", F.explode(F.sequence(F.col("beat_idx") - 4, F.col("beat_idx") + 4)))
        .join(counts, "track_id")
        .where((F.col("centre") >= 0) & (F.col("centre") <= F.col("_n")))
    )
    # at most nine beats per centre
    around = spread.groupBy("track_id", "centre").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("beat_idx", "beat_s"))), lambda s: s["beat_s"]).alias("b")
    )
    tempo = _local_tempo(around, rate)
    centres = beats.select("track_id", F.col("beat_idx").alias("centre"), "beat_s").join(tempo, ["track_id", "centre"])
    tails = tempo.join(counts, "track_id").where(F.col("centre") == F.col("_n")).select("track_id", F.col("bpm").alias("_tail"))
    found = asof(
        positions, centres, ["track_id"], F.col("t_s"), F.col("beat_s"), ["bpm"], before=None, after="_f", equal="after"
    )
    return found.join(tails, "track_id", "left").select(
        *positions.columns, F.when(F.col("_f").isNotNull(), F.col("_f.bpm")).otherwise(F.col("_tail")).alias("bpm")
    )


def _local_tempo(around: DataFrame, rate: float) -> DataFrame:
    """Slope of beat time over index along the first longest steady run of ``b``.

    Built in stages so that every array is made once per row.
    """
    gaps = F.transform(F.slice("b", 2, 16), lambda x, i: x - F.get("b", i.cast("int")))
    staged = around.withColumn("g", gaps)
    staged = staged.withColumn("u", F.array_sort(F.filter("g", lambda v: (v >= 0.2) & (v <= 2.0))))
    staged = staged.withColumn("m", F.get("u", F.floor(F.size("u") / 2).cast("int")))
    # positions that break a steady run, fenced by both ends
    breaks = F.filter(
        F.transform("g", lambda v, i: F.when((v >= F.col("m") * 0.9) & (v <= F.col("m") * 1.1), -1).otherwise(i.cast("int"))),
        lambda i: i >= 0,
    )
    staged = staged.withColumn("k", F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("g"))))
    runs = F.transform(
        F.slice("k", F.lit(2), F.size("k") - 1),
        lambda e, i: F.struct((e - F.get("k", i.cast("int")) - 1).alias("n"), (-F.get("k", i.cast("int"))).alias("s")),
    )
    staged = staged.withColumn("r", F.array_max(runs))
    # a run of n steady intervals starting after break s spans n + 1 beats
    staged = staged.withColumn("p", F.slice("b", 2 - F.col("r.s").cast("int"), F.col("r.n").cast("int") + 1))
    staged = staged.withColumn("c", F.size("p")).withColumn("mt", F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.col("c"))
    pairs = F.transform("p", lambda x, i: F.struct((i - (F.col("c") - 1) / 2).alias("d"), (x - F.col("mt")).alias("t")))
    staged = staged.withColumn("q", pairs)
    staged = staged.withColumn("cov", F.aggregate("q", F.lit(0.0), lambda a, x: a + x["d"] * x["t"])).withColumn(
        "var", F.aggregate("q", F.lit(0.0), lambda a, x: a + x["d"] * x["d"])
    )
    usable = F.col("m").isNotNull() & (F.col("r.n") >= 1) & (F.col("var") > 0) & (F.col("cov") > 0)
    bpm = F.when(usable, F.lit(60.0) / (F.col("cov") / F.col("var")) * F.lit(max(0.5, min(2.0, rate))))
    return staged.select("track_id", "centre", bpm.alias("bpm"))


def downbeat_membership(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """Beats with their downbeat flag, and downbeats that are no beat, by exact time."""
    marks = downbeats.select("track_id", F.col("downbeat_s").alias("beat_s")).distinct()
    times = beats.select("track_id", "beat_s").distinct()
    flagged = times.join(marks.withColumn("_d", F.lit(True)), ["track_id", "beat_s"], "left").select(
        "track_id", "beat_s", F.when(F.col("_d"), "downbeat").otherwise("beat").alias("kind")
    )
    stray = marks.join(times, ["track_id", "beat_s"], "left_anti").withColumn("kind", F.lit("stray downbeat"))
    return flagged.unionByName(stray)


def beat_lines(beats: DataFrame, viewports: DataFrame, limit: int = 500) -> DataFrame:
    """Beats to draw in each viewport: all when it spans at most 30 s, downbeats from zoom 1.5, thinned evenly.

    ``viewports``: track_id, viewport_id, zoom, start, duration_s. Beats are numbered once per
    track, all of them and the downbeats. A viewport looks up the numbers of its first and
    last beat and asks for at most ``limit`` numbers between, so no other beat ever meets it.
    """
    full = F.col("duration_s") / F.col("zoom") <= 30
    shown = viewports.where((F.col("duration_s") > 0) & (full | (F.col("zoom") >= 1.5)))
    shown = shown.withColumns({
        "_kind": F.when(full, 0).otherwise(1), "_from": F.col("start") * F.col("duration_s"), "_to": (F.col("start") + 1 / F.col("zoom")) * F.col("duration_s")})
    key = ["track_id", "_kind"]
    ranked = annotate(distinct_or_same(beats), ["track_id"], ["beat_s", "beat_idx"], ordinal="_all", running={"_down": F.col("is_downbeat").cast("int")})
    places = F.array(F.struct(F.lit(0).alias("kind"), F.col("_all").alias("no")), F.when(F.col("is_downbeat"), F.struct(F.lit(1).alias("kind"), (F.col("_down") - 1).cast("bigint").alias("no"))))
    numbered = ranked.select("track_id", "beat_s", "is_downbeat", F.explode(F.array_compact(places)).alias("p")).select("track_id", F.col("p.kind").alias("_kind"), F.col("p.no").alias("_no"), "beat_s", "is_downbeat")
    first = asof(shown, numbered, key, F.col("_from"), F.col("beat_s"), ["_no"], ties=["_no"], before=None, after="_first", equal="after")
    both = asof(first, numbered, key, F.col("_to"), F.col("beat_s"), ["_no"], ties=["_no"], before="_last")
    n = F.col("_last._no") - F.col("_first._no") + 1
    asked = both.where(F.coalesce(n > 0, F.lit(False))).select(
        *key, "viewport_id", "start", "zoom", "duration_s",
        F.explode(F.sequence(F.col("_first._no"), F.col("_last._no"), F.greatest(F.lit(1), F.ceil(n / limit)).cast("bigint"))).alias("_no"))
    percent = (F.col("beat_s") / F.col("duration_s") - F.col("start")) * F.col("zoom") * 100
    return asked.join(numbered, [*key, "_no"]).select("track_id", "viewport_id", "beat_s", percent.alias("percent"), F.col("is_downbeat").alias("accent"))


def distinct_or_same(beats: DataFrame) -> DataFrame:
    return beats.select("track_id", "beat_idx", "beat_s", "is_downbeat")


def practice_schedule(settings: DataFrame) -> DataFrame:
    """Playback rate after each completed loop until the target is reached.

    ``settings``: track_id, start_rate, target_rate, repetitions, increment,
    enabled. The rate rises every ``repetitions`` loops.
    """
    start = F.greatest(F.lit(0.5), F.least(F.lit(1.99), F.col("start_rate")))
    target = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("target_rate")))
    reps = F.greatest(F.lit(1), F.least(F.lit(99), F.col("repetitions")))
    step = F.greatest(F.lit(0.01), F.least(F.lit(0.25), F.col("increment")))
    ready = settings.select(
        "track_id", start.alias("_s"), target.alias("_t"), reps.cast("int").alias("_r"), step.alias("_i"), "enabled"
    ).where(F.col("enabled") & (F.col("_t") > F.col("_s")))
    raises = F.ceil((F.col("_t") - 1e-6 - F.col("_s")) / F.col("_i")).cast("int")
    # bounded: at most 150 raises of at least .01
    stages = ready.withColumn("stage", F.explode(F.sequence(F.lit(0), F.greatest(raises, F.lit(0)))))
    return stages.select(
        "track_id", "stage", (F.col("stage") * F.col("_r")).alias("after_loops"),
        F.least(F.col("_s") + F.col("stage") * F.col("_i"), F.col("_t")).alias("rate"),
    )
