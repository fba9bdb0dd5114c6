"""Data contracts as rules: how many rows of each document break each rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.functions import vocabulary as V
from stave.functions.scalars import clamp, finite
from stave.operators.timeline import annotate

CONTROL = r"[\x00-\x1f\x7f-\x9f]"
# Label grammars.
LABEL = r"^[A-Za-z0-9#b/()+\-°,*]{1,}$"
SOURCE_LABEL = r"^[A-Za-z0-9#:b/()+\-°,*]{1,}$"
EDIT_LABEL = r"^[A-G][A-Za-z0-9#b/(),*+\-:]*$"


def tally(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Count rows breaking each rule per key; only broken rules are reported."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()])
    return _long(counts, keys, list(rules))


def _long(counts: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("n_bad")) for n in names])
    return counts.select(*keys, F.inline(pairs)).where(F.col("n_bad") > 0)


def too_many(df: DataFrame, keys: Sequence[str], rule: str, limit: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > limit).select(*keys, F.lit(rule).alias("rule"), (F.col("_n") - limit).cast("bigint").alias("n_bad"))


def split_by_verdict(df: DataFrame, broken: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows to set aside with their rules."""
    reasons = broken.groupBy(*keys).agg(F.array_sort(F.collect_set("rule")).alias("reasons"))
    return df.join(reasons, list(keys), "left_anti"), df.join(reasons, list(keys))


def check_chords(chords: DataFrame) -> DataFrame:
    """Segments per (track, mode): order, bounds, labels, strength, count."""
    keys = ["track_id", "mode"]
    lane = annotate(chords, keys, ["idx"], lag={"_prev": F.col("end_s")})
    start, end = F.col("start_s"), F.col("end_s")
    rules = {
        "label": ~F.col("label").rlike(LABEL) | (F.octet_length("label") > 64),
        "source_label": ~F.col("source_label").rlike(SOURCE_LABEL) | (F.octet_length("source_label") > 96),
        "bounds": ~finite(start) | ~finite(end) | (start < 0) | (end <= start) | (end > V.MAX_DAY_SECONDS),
        "overlap": start < F.coalesce("_prev", F.lit(0.0)),
        "strength": ~finite(F.col("strength")) | ~F.col("strength").between(0.0, 1.001),
    }
    return tally(lane, keys, rules).unionByName(too_many(chords, keys, "count", V.MAX_SEGMENTS_PER_MODE))


def check_beats(beats: DataFrame, downbeats: DataFrame, tempos: DataFrame) -> DataFrame:
    """Timelines per (track, source): order, bounds, counts, tempo and downbeats among the beats.

    ``beats``: beat_idx, beat_s; ``downbeats``: down_idx, downbeat_s; ``tempos``: bpm (nullable).
    """
    keys = ["track_id", "source"]

    def positions(df: DataFrame, order: str, time: str, name: str, limit: int) -> DataFrame:
        lane = annotate(df, keys, [order], lag={"_prev": F.col(time)})
        t = F.col(time)
        rules = {
            f"{name} bounds": ~finite(t) | (t < 0) | (t > V.MAX_DAY_SECONDS),
            f"{name} order": t <= F.coalesce("_prev", F.lit(-1.0)),
        }
        return tally(lane, keys, rules).unionByName(too_many(df, keys, f"{name} count", limit))

    tempo = tally(tempos, keys, {"bpm": F.col("bpm").isNotNull() & (~finite(F.col("bpm")) | ~F.col("bpm").between(30.0, 300.0))})
    known = beats.select(*keys, F.col("beat_s").alias("downbeat_s")).distinct()
    stray = downbeats.join(known, [*keys, "downbeat_s"], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bad")).select(
        *keys, F.lit("stray downbeat").alias("rule"), "n_bad")
    return (
        positions(beats, "beat_idx", "beat_s", "beat", V.MAX_BEATS)
        .unionByName(positions(downbeats, "down_idx", "downbeat_s", "downbeat", V.MAX_DOWNBEATS)).unionByName(tempo).unionByName(stray)
    )


def check_settings(practice: DataFrame) -> DataFrame:
    """Scalar practice settings within their ranges."""
    c = F.col
    rules = {
        "position": ~finite(c("position_s")) | (c("position_s") < 0),
        "playback_rate": ~finite(c("playback_rate")) | ~c("playback_rate").between(0.5, 2.0),
        "pitch": ~finite(c("pitch_semitones")) | ~c("pitch_semitones").between(-12.0, 12.0),
        "volume": ~finite(c("volume")) | ~c("volume").between(0.0, 2.0),
        "metronome_volume": ~finite(c("metronome_volume")) | ~c("metronome_volume").between(0.0, 1.0),
        "repetitions": ~c("trainer_repetitions").between(1, 99),
        "start_rate": ~finite(c("trainer_start_rate")) | ~((c("trainer_start_rate") >= 0.5) & (c("trainer_start_rate") < 2.0)),
        "increment": ~finite(c("trainer_increment")) | ~c("trainer_increment").between(0.01, 0.25),
        "target_rate": ~finite(c("trainer_target_rate")) | ~c("trainer_target_rate").between(0.5, 2.0)
        | (c("trainer_start_rate") >= c("trainer_target_rate")),
        "notes": (F.char_length("track_notes") > 10_000) | F.regexp_replace("track_notes", r"[\n\r\t]", "").rlike(CONTROL),
        "loop": F.coalesce((c("loop_a_s") < 0) | (c("loop_b_s") <= c("loop_a_s")), F.lit(False))
        & c("loop_a_s").isNotNull() & c("loop_b_s").isNotNull(),
    }
    return tally(practice, ["track_id"], rules)


def _edit_label(label: Column) -> Column:
    text = F.trim(label)
    return (text == "N") | (text.rlike(EDIT_LABEL) & (F.octet_length(text) <= 96))


def check_edits(edits: DataFrame) -> DataFrame:
    """Chord edits: bounds, label grammar, one per (mode, start, end), at most 4,096 per track."""
    bad = tally(edits, ["track_id"], {
        "edit bounds": ~finite(F.col("start_s")) | ~finite(F.col("end_s")) | (F.col("start_s") < 0) | (F.col("end_s") <= F.col("start_s")),
        "edit label": ~_edit_label(F.col("label")),
    })
    doubled = edits.groupBy("track_id", "mode", "start_s", "end_s").agg((F.count(F.lit(1)) - 1).alias("_x")).groupBy("track_id").agg(
        F.sum("_x").alias("n_bad")).where("n_bad > 0").select("track_id", F.lit("edit repeated").alias("rule"), "n_bad")
    return bad.unionByName(doubled).unionByName(too_many(edits, ["track_id"], "edit count", 4096))


def check_markers(markers: DataFrame, tracks: DataFrame) -> DataFrame:
    """Marker lanes: labels, bounds within the track, order without overlap, unique ids, at most 512."""
    lane = annotate(markers, ["track_id"], ["start_s", "marker_id"], lag={"_ps": F.col("start_s"), "_pe": F.col("end_s")})
    lane = lane.join(tracks.select("track_id", "duration_s"), "track_id", "left")
    label = F.trim("label")
    later = F.coalesce((F.col("start_s") <= F.col("_ps")) | (F.col("_pe") > F.col("start_s")), F.lit(False))
    past = (F.col("start_s") >= F.col("duration_s")) | (F.col("end_s") > F.col("duration_s"))
    bad = tally(lane, ["track_id"], {
        "marker label": ~F.char_length(label).between(1, 120) | label.rlike(CONTROL),
        "marker bounds": ~finite(F.col("start_s")) | (F.col("start_s") < 0) | F.coalesce(~finite(F.col("end_s")) & F.col("end_s").isNotNull(), F.lit(False))
        | F.coalesce(F.col("end_s") <= F.col("start_s"), F.lit(False)),
        "marker order": later, "marker past end": F.coalesce(past, F.lit(False)),
    })
    doubled = markers.groupBy("track_id", "marker_id").agg((F.count(F.lit(1)) - 1).alias("_x")).groupBy("track_id").agg(
        F.sum("_x").alias("n_bad")).where("n_bad > 0").select("track_id", F.lit("marker repeated").alias("rule"), "n_bad")
    return bad.unionByName(doubled).unionByName(too_many(markers, ["track_id"], "marker count", V.MAX_MARKERS))


def check_regions(regions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Custom chord regions: known modes, order without overlap, label grammar, within the track, at most 4,096 per mode.

    ``regions`` carry ``seq``, their place in the timeline.
    """
    keys = ["track_id", "mode"]
    lane = annotate(regions, keys, ["seq"], lag={"_pe": F.col("end_s")}).join(tracks.select("track_id", "duration_s"), "track_id", "left")
    bad = tally(lane, ["track_id"], {
        "region mode": ~F.col("mode").isin(*V.MODES),
        "region bounds": ~finite(F.col("start_s")) | ~finite(F.col("end_s")) | (F.col("end_s") <= F.col("start_s")),
        "region order": F.col("start_s") < F.coalesce("_pe", F.lit(0.0)), "region label": ~_edit_label(F.col("label")),
        "region past end": F.coalesce((F.col("start_s") >= F.col("duration_s")) | (F.col("end_s") > F.col("duration_s")), F.lit(False)),
    })
    many = too_many(regions, keys, "region count", 4096).groupBy("track_id", "rule").agg(F.sum("n_bad").alias("n_bad"))
    return bad.unionByName(many)


def check_stems(stem_mix: DataFrame) -> DataFrame:
    return tally(stem_mix, ["track_id"], {
        "stem gain": ~finite(F.col("gain")) | ~F.col("gain").between(0.0, 2.0), "stem pan": ~finite(F.col("pan")) | ~F.col("pan").between(-1.0, 1.0),
    })


def check_practice_state(practice, edits, markers, regions, stem_mix, tracks) -> DataFrame:
    """All practice-state rules of a track in one report."""
    parts = [check_settings(practice), check_edits(edits), check_markers(markers, tracks), check_regions(regions, tracks), check_stems(stem_mix)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_lyrics(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lyric documents (language, offset_ms) and their lines, which hold their words as an array.

    A line's text and words are judged where they are; only its times and counts are shuffled.
    """
    head = tally(docs, ["track_id"], {
        "language": (F.trim("language") == "") | (F.char_length("language") > 35) | F.col("language").rlike(CONTROL),
        "offset": F.abs("offset_ms") > 30_000,
    })
    start, end = F.col("start_ms"), F.col("end_ms")
    earlier = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("words.start_ms", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))))
    pairs = F.zip_with("words", earlier, lambda word, before: F.struct(word.alias("word"), before.alias("before")))
    word_rules = {
        "word text": lambda w, before: (F.trim(w["text"]) == "") | (F.char_length(w["text"]) > 512),
        "word order": lambda w, before: F.coalesce(w["start_ms"] < before, F.lit(False)),
        "word range": lambda w, before: F.coalesce(w["end_ms"] <= w["start_ms"], F.lit(False)),
        "word outside line": lambda w, before: F.coalesce(w["start_ms"] < start, F.lit(False)) | F.coalesce(w["start_ms"] >= end, F.lit(False)),
    }

    def broken(rule) -> Column:
        return F.size(F.filter("_pairs", lambda p: F.coalesce(rule(p["word"], p["before"]), F.lit(True))))

    text = (F.trim("text") == "") | (F.char_length("text") > 4_096) | F.col("text").contains("\x00")
    words = F.when(F.size("words") > 0, F.size("words")).otherwise(0)
    judged = lines.withColumn("_pairs", F.when(F.size("words") > 0, pairs).otherwise(F.slice(pairs, 1, 0))).select(
        "track_id", "line_no", "start_ms", "end_ms", F.coalesce(text, F.lit(True)).alias("_text"), words.alias("_words"), *[broken(rule).alias(name) for name, rule in word_rules.items()])
    lane = annotate(judged, ["track_id"], ["line_no"], last={"_s": start})
    lane = annotate(lane, ["track_id"], ["line_no"], lag={"_ps": F.col("_s")})
    counts = lane.groupBy("track_id").agg(
        F.count_if("_text").alias("line text"), F.count_if(F.coalesce(start < F.col("_ps"), F.lit(False))).alias("line order"),
        F.count_if(F.coalesce(end <= start, F.lit(False)) | (start.isNull() & end.isNotNull())).alias("line range"),
        *[F.sum(f"`{name}`").alias(name) for name in word_rules],
        (F.count(F.lit(1)) - V.MAX_LYRIC_LINES).alias("line count"), (F.sum("_words") - V.MAX_LYRIC_WORDS).alias("word count"))
    return head.unionByName(_long(counts, ["track_id"], ["line text", "line order", "line range", *word_rules, "line count", "word count"]))


def check_export(segments: DataFrame) -> DataFrame:
    """Annotation segments (time, duration, value, confidence) per (track, mode)."""
    keys = ["track_id", "mode"]
    return tally(segments, keys, {
        "time": ~finite(F.col("time")) | (F.col("time") < 0), "duration": ~finite(F.col("duration")) | (F.col("duration") < 0),
        "confidence": ~finite(F.col("confidence")) | ~F.col("confidence").between(0.0, 1.0),
        "value": (F.col("value") == "") | (F.octet_length("value") > 96) | F.col("value").rlike(CONTROL),
    }).unionByName(too_many(segments, keys, "count", V.MAX_EXPORT_SEGMENTS))


def check_lyric_records(records: DataFrame) -> DataFrame:
    """Lyric search records that may be shown: usable id, names and duration."""
    return records.where(
        (F.col("id") > 0) & (F.trim("track_name") != "") & (F.char_length("track_name") <= 512)
        & finite(F.col("duration_s")) & F.col("duration_s").between(0.0, V.MAX_DAY_SECONDS)
    )


def normalize_legacy(practice: DataFrame) -> DataFrame:
    """Settings of older documents brought into range; half-set or reversed loops are switched off."""
    start = clamp(F.col("trainer_start_rate"), 0.5, 1.99)
    target = clamp(F.col("trainer_target_rate"), 0.5, 2.0)
    a, b = F.col("loop_a_s"), F.col("loop_b_s")
    sound = (a.isNull() & b.isNull()) | F.coalesce((a >= 0) & (b > a), F.lit(False))
    return practice.withColumns({
        "position_s": F.greatest(F.lit(0.0), "position_s"), "playback_rate": clamp(F.col("playback_rate"), 0.5, 2.0),
        "pitch_semitones": clamp(F.col("pitch_semitones"), -12.0, 12.0), "volume": clamp(F.col("volume"), 0.0, 2.0),
        "metronome_volume": clamp(F.col("metronome_volume"), 0.0, 1.0),
        "trainer_repetitions": F.greatest(F.lit(1), F.least(F.lit(99), "trainer_repetitions")), "trainer_start_rate": start,
        "trainer_increment": clamp(F.col("trainer_increment"), 0.01, 0.25),
        "trainer_target_rate": F.when(target <= start, F.least(F.lit(2.0), start + 0.01)).otherwise(target),
        "loop_enabled": F.col("loop_enabled") & sound, "loop_a_s": F.when(sound, a), "loop_b_s": F.when(sound, b),
    })


def normalize_preferences(prefs: DataFrame) -> DataFrame:
    """User preferences brought into range."""
    start = clamp(F.col("default_trainer_start_rate"), 0.5, 1.99)
    window = F.col("energy_window_s")
    return prefs.withColumns({
        "toast_duration_s": F.greatest(F.lit(1), F.least(F.lit(10), "toast_duration_s")),
        "concurrent_downloads": F.greatest(F.lit(1), F.least(F.lit(8), "concurrent_downloads")),
        "master_volume": clamp(F.col("master_volume"), 0.0, 2.0),
        "navigation_time_s": F.greatest(F.lit(1), F.least(F.lit(60), "navigation_time_s")),
        "energy_window_s": F.when(window <= 9, 5).when(window <= 22, 15).otherwise(30), "default_trainer_start_rate": start,
        "default_trainer_target_rate": F.greatest(start + 0.01, F.least(F.lit(2.0), "default_trainer_target_rate")),
        "language": F.when(F.col("language").isin("en", "fr", "es", "de", "pt", "it", "zh", "ja", "ko", "ar", "hi", "id"), F.col("language")).otherwise("en"),
    })


# Version prefixes and warning openings of worker results.
MODEL_PREFIX, DOWNBEAT_PREFIX = "lv-chordia@", "beat-this@"
CHORD_WARNING, BEAT_WARNING = "LV-Chordia failed: ", "Beat This! failed: "


def check_worker_result(parsed: DataFrame) -> DataFrame:
    """Structural rules of worker results (track_id, requested_mode, r)."""
    r = lambda name: F.col(f"r.{name}")
    warnings = F.coalesce(r("warnings"), F.array().cast("array<string>"))
    failed = F.exists(warnings, lambda w: w.startswith(CHORD_WARNING))
    modes = F.map_keys(r("modes"))
    lists = [r(n).isNotNull().cast("int") for n in ("beats", "downbeats", "dbnBeats", "dbnDownbeats")]
    present = lists[0] + lists[1] + lists[2] + lists[3]
    rules = {
        "model version": (F.octet_length(r("modelVersion")) > 96) | ~r("modelVersion").startswith(MODEL_PREFIX),
        "downbeat model version": (F.octet_length(r("downbeatModelVersion")) > 96) | ~r("downbeatModelVersion").startswith(DOWNBEAT_PREFIX),
        "mode missing": ~failed & ~F.array_contains(modes, F.col("requested_mode")),
        "mode unexpected": (F.size(modes) > 1) | F.exists(modes, lambda m: m != F.col("requested_mode")),
        "rhythm incomplete": (present > 0) & (present < 4),
        "warning": (F.size(warnings) > 1) | F.exists(
            warnings,
            lambda w: (w == "") | (F.octet_length(w) > 1024) | w.rlike(CONTROL) | ~(w.startswith(CHORD_WARNING) | w.startswith(BEAT_WARNING))),
    }
    return tally(parsed, ["track_id", "requested_mode"], rules)


def tolerant_scan_report(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """How many inputs were set aside, by reason."""
    return rows.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
