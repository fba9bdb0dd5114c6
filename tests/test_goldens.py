"""Known cases of the rules."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stave.functions import music, scalars, text
from stave.operators import catalog, chords, lyrics, markers, navigation, quality, rhythm, selection, telemetry
from stave.sources import imports, lyrics as lyric_files, search, worker


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_labels(spark):
    harte = ["C:maj", "E:min7", "B:hdim7", "D:7/3", "Bb:min/b3", "N", "X"]
    assert column(spark, harte, "string", music.harte_to_compact) == ["C", "Em7", "Bm7b5", "D7/F#", "Bbm/Db", "N", "N"]
    assert column(spark, ["D:min9", "B:dim7", "X"], "string", music.triad_label) == ["Dm", "Bdim", "N"]
    assert column(spark, ["Cm7", "Dbmaj7/Ab", "F#:sus4", "N"], "string", music.compact_to_harte) == ["C:min7", "Db:maj7/5", "F#:sus4", "N"]
    assert column(spark, ["Am/G", "N", "??"], "string", lambda c: music.transpose(c, F.lit(2), False)) == ["Bm/A", "N", "??"]
    assert column(spark, ["A#", "F#m7/C#"], "string", lambda c: music.transpose(c, F.lit(0), True)) == ["Bb", "Gbm7/Db"]


def pitch_sets(spark, labels):
    df = music.with_pitch_sets(spark.createDataFrame([(v,) for v in labels], "label string"))
    return {r.label: r for r in df.select("label", "chord", music.degree_names(F.col("chord")).alias("names")).collect()}


def test_pitch_sets(spark):
    found = pitch_sets(spark, ["Cm9", "Gsus4(b7)", "D7/F#", "C7/Gb", "Cadd13", "C:maj(*3,9)", "N", "C:min7/b3"])
    assert found["Cm9"].chord.pitches == [0, 2, 3, 7, 10]
    assert found["Gsus4(b7)"].chord.pitches == [7, 0, 2, 5]
    assert (found["D7/F#"].chord.bass, sorted(found["D7/F#"].chord.pitches)) == (6, [0, 2, 6, 9])
    assert found["C7/Gb"].names == ["b5", "1", "3", "5", "b7"]
    assert found["Cadd13"].chord is None and found["N"].chord is None
    assert found["C:maj(*3,9)"].chord.pitches == [0, 2, 7]
    assert found["C:min7/b3"].chord.bass == 3


def test_entries(spark):
    df = spark.createDataFrame([(v,) for v in ["cm7", "e♭", "BB7", "d/f#", "n", "-", "Cxyz"]], "typed string")
    found = {r.typed: r.entry for r in music.with_valid_entries(df, "typed").collect()}
    assert found == {"cm7": "Cm7", "e♭": "D#", "BB7": "A#7", "d/f#": "D/F#", "n": "N", "-": "N", "Cxyz": None}


CHORDS = "track_id string, mode string, idx bigint, label string, source_label string, start_s double, end_s double, strength double"


def timeline(spark, *items):
    return spark.createDataFrame(
        [("t", "standard", i, c[0], c[0], float(c[1]), float(c[2]), float(c[3]) if len(c) > 3 else 0.5) for i, c in enumerate(items)], CHORDS)


def positions(spark, *ts):
    return spark.createDataFrame([("t", i, float(t)) for i, t in enumerate(ts)], "track_id string, query_id bigint, t_s double")


def by_query(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("query_id").collect()]


def test_chord_timelines(spark):
    raw = timeline(spark, ("C", 0, 4.0008), ("D", 4, 8.0006), ("E", 8, 9), ("F", 9.01, 10.02), ("G", 10.0, 11))
    ends = [r.end_s for r in chords.segment_boundaries(raw).orderBy("idx").collect()]
    assert ends == [4.0, 8.0, 9.0, 10.02, 11.0]
    stats = chords.chord_statistics(timeline(spark, ("G", 0, 2, .6), ("C", 2, 6, .7), ("G", 6, 8, .9), ("N", 8, 10), ("Am", 10, 10)))
    assert sorted((r.label, r.duration_s, r.share, r.occurrences, r.strength) for r in stats.collect()) == [("C", 4, .5, 1, .7), ("G", 4, .5, 2, .9)]
    pair = timeline(spark, ("C", 10, 12.345), ("Dm", 12.345, 14))
    assert by_query(chords.active_chord(positions(spark, 12.334, 12.335, 9, 14), pair), "idx") == [0, 1, None, None]
    lane = timeline(spark, ("C", 0, 4), ("Dm", 4, 8), ("G", 8, 12))
    assert by_query(chords.adjacent_chord(positions(spark, 4.25), lane), "prev_s", "next_s") == [(0.0, 8.0)]
    lapped = timeline(spark, ("C", 0, 4.0008), ("Dm", 4, 8.0006), ("G", 8, 12))
    assert by_query(chords.adjacent_chord(positions(spark, 4, 8), lapped), "prev_s", "next_s") == [(0.0, 8.0), (4.0, 8.0)]
    regions = chords.materialize_regions(timeline(spark, ("C", 0, 2), ("D", 1, 3), ("E", 1.5, 3.02), ("F", 5, 9)), spark.createDataFrame([("t", 7.0)], "track_id string, duration_s double"))
    assert sorted((r.label, r.start_s, r.end_s) for r in regions.collect()) == [("C", 0, 2), ("D", 2, 3), ("F", 5, 7)]


def beats(spark, times, downs=()):
    return spark.createDataFrame([("t", i, float(b), b in downs) for i, b in enumerate(times)], "track_id string, beat_idx bigint, beat_s double, is_downbeat boolean")


def test_beat_counts(spark):
    counts = lambda c, b: [r.beat_count for r in chords.chord_beat_counts(c, b).orderBy("idx").collect()]
    half = [i * .5 for i in range(8)]
    assert counts(timeline(spark, ("C", .04, 1.06), ("G", 1.06, 2.96), ("Am", 2.96, 4)), beats(spark, half)) == [2, 4, 2]
    assert counts(timeline(spark, ("C", 0, 1.2), ("G", 1.2, 2)), beats(spark, half[:4])) == [2, 2]


def test_edits(spark):
    base = timeline(spark, ("C", 0, 1), ("G", 1, 2), ("C", 2, 3))
    none = spark.createDataFrame([], "track_id string, mode string, start_s double, end_s double, label string, edit_seq bigint")
    for every, expected in ((False, ["D", "G", "C"]), (True, ["D", "G", "D"])):
        request = spark.createDataFrame([("t", "standard", 0.0, 1.0, "D", every)], "track_id string, mode string, start_s double, end_s double, replacement string, replace_all boolean")
        made = chords.edits_upsert(base, none, request).withColumn("edit_seq", F.lit(1).cast("bigint"))
        assert [r.label for r in chords.apply_chord_edits(base, made).orderBy("idx").collect()] == expected
    assert [r.label for r in chords.visible_chords(base.withColumn("edited", F.col("idx") == 0).withColumn("strength", F.lit(.1)), .85).collect()] == ["C"]


def grid(*parts):
    out = [0.0]
    for step, until in parts:
        while out[-1] + step <= until + 1e-9:
            out.append(round(out[-1] + step, 6))
    return out


def test_tempo(spark):
    assert rhythm.global_bpm(beats(spark, [.1, .6, 1.1, 1.6])).first().bpm == 120.0
    assert rhythm.global_bpm(beats(spark, [.1])).first().bpm is None
    assert by_query(rhythm.local_bpm(positions(spark, 1), beats(spark, [0, .5, 1, 2, 2.5, 3]), .8), "bpm") == [pytest.approx(96)]
    assert by_query(rhythm.local_bpm(positions(spark, 1), beats(spark, [0]), 1.0), "bpm") == [None]


@pytest.mark.parametrize("parts, n, bpm", [(((.5, 5), (.25, 7)), 15, 120), (((.25, 5), (.5, 8)), 33, 240), (((.5, 5),), 11, 120)])
def test_homogenize(spark, tiny_blocks, parts, n, bpm):
    made = rhythm.homogenized_bpm(rhythm.homogenize_beats(beats(spark, grid(*parts), {0.0, 2.0, 4.0, 6.0, 7.0}))).first()
    assert (made.n_beats, round(made.bpm, 6)) == (n, bpm)


def test_navigation(spark):
    anchors = spark.createDataFrame([("t", v) for v in (.5, 1.0, 1.5)], "track_id string, a_s double")
    assert by_query(navigation.adjacent_anchor(positions(spark, 1.01, 1.25, .1, 9), anchors), "prev_s", "next_s") == [(.5, 1.5), (.5, 1.5), (.5, .5), (1.0, 1.5)]
    near = spark.createDataFrame([("t", v) for v in (.4, .91, 1.43, 1.96)], "track_id string, a_s double")
    assert by_query(navigation.nearest_anchor(positions(spark, .65, .66, 2.2), near), "snapped_s") == [.4, .91, 1.96]
    other = spark.createDataFrame([("x", 1.0)], "track_id string, a_s double")
    assert by_query(navigation.nearest_anchor(positions(spark, .65), other), "snapped_s") == [.65]
    edges = spark.createDataFrame([("t", v) for v in (2.0, 8.0, 12.0)], "track_id string, boundary_s double")
    assert by_query(navigation.snap_to_lanes(positions(spark, 7.92, 7.7), edges, .1), "snapped_s") == [8.0, 7.7]
    views = spark.createDataFrame([("t", 0, 2.0, .25, 12.0)], "track_id string, viewport_id int, zoom double, start double, duration_s double")
    lane = timeline(spark, ("C", 0, 4), ("Dm", 4, 8), ("G", 8, 12)).select("track_id", F.lit("chords").alias("lane"), F.col("label").alias("item_id"), "start_s", "end_s")
    shown = {r.item_id: (round(r.left_percent), round(r.width_percent)) for r in navigation.viewport_overlap(lane, views).collect()}
    assert shown == {"C": (0, 17), "Dm": (17, 67), "G": (83, 17)}


def test_markers(spark):
    rows = [("t", "a", 0.0, 12.0), ("t", "b", 12.0, None), ("t", "c", 32.0, 48.0)]
    lane = spark.createDataFrame([(k, i, i, s, e, "user") for k, i, s, e in rows], "track_id string, marker_id string, label string, start_s double, end_s double, origin string")
    tracks = spark.createDataFrame([("t", 60.0)], "track_id string, duration_s double")
    ended = markers.marker_ends(lane, tracks)
    assert [r.shown_end_s for r in ended.orderBy("idx").collect()] == [12, 32, 48]
    assert by_query(markers.active_marker(positions(spark, 11.99, 12, 33, 55), ended), "idx") == [0, 1, 2, None]
    new = spark.createDataFrame([("t", "n", "new", 20.0, None, "user")], lane.schema)
    assert {r.marker_id: r.end_s for r in markers.insert_markers(lane, tracks, new).collect()}["b"] == 20.0
    close = spark.createDataFrame([("t", "n", "new", 12.005, None, "user")], lane.schema)
    assert markers.insert_markers(lane, tracks, close).count() == 3


def test_lyrics(spark):
    doc = "[ar:X]\n[00:03.50]Two\n[00:01.00]One\n[00:05.00]<00:05.00>Hel<00:05.50>lo"
    lines, words = lyric_files.parse_lrc(spark.createDataFrame([("t", doc, 9000)], "track_id string, text string, duration_ms bigint"))
    assert [(r.text, r.start_ms, r.end_ms) for r in lines.orderBy("line_no").collect()] == [("One", 1000, 3500), ("Two", 3500, 5000), ("Hello", 5000, 9000)]
    assert [(r.text, r.start_ms, r.end_ms) for r in words.orderBy("word_no").collect()] == [("Hel", 5000, 5500), ("lo", 5500, None)]
    docs = spark.createDataFrame([("t", 0, "word", 3, 9000)], "track_id string, offset_ms int, sync_level string, n_lines bigint, duration_ms bigint")
    now = spark.createDataFrame([("t", 0, 3600), ("t", 1, 500)], "track_id string, query_id bigint, now_ms bigint")
    assert by_query(lyrics.active_lyric_line(now, docs, lines), "line_no") == [1, None]
    bad = spark.createDataFrame([("a", "[01:60.00]x"), ("b", "[01:59.99]x"), ("c", " ")], "track_id string, text string")
    assert {r.track_id: r.verdict for r in lyric_files.lrc_validate(bad).collect()} == {"a": "invalid timestamp", "b": "ok", "c": "empty"}
    ttml = '<tt><body><p begin="2s" end="0:04.5"><span begin="2s">Hello</span> <span begin="3s">w&amp;d</span></p></body></tt>'
    made, spans = lyric_files.parse_ttml(spark.createDataFrame([("t", ttml)], "track_id string, text string"))
    assert [(r.text, r.start_ms, r.end_ms) for r in made.collect()] == [("Hello w&d", 2000, 4500)] and spans.count() == 2
    plain = spark.createDataFrame([("t", 0, "none", 4, 40000)], "track_id string, offset_ms int, sync_level string, n_lines bigint, duration_ms bigint")
    at = spark.createDataFrame([("t", 0, 0), ("t", 1, 21000), ("t", 2, 40000)], "track_id string, query_id bigint, now_ms bigint")
    assert by_query(lyrics.estimated_line(at, plain), "line_no") == [0, 2, 3]


def test_lyrics_queries(spark):
    title = "Lou Reed - Perfect_Day Live 2026 (Official Audio) [HD]"
    assert [len(q.split()) for q in column(spark, [title], "string", text.lyrics_queries)[0]] == [6, 5, 4]


def test_ranking(spark):
    same = column(spark, ["tHE, pOT!"], "string", lambda c: text.recall(text.tokens(F.lit("The Pot")), text.tokens(c)))
    assert same[0] > .9
    rows = [
        (0, "Tool - The Pot", 0, "TOOL: The Pot", "TOOL"), (0, "Tool - The Pot", 1, "TOOL: The Pot (cover)", "TOOL"),
        (0, "Tool - The Pot", 2, "tool the pot!", "TOOL"), (0, "Tool - The Pot", 3, "The Pot / Tool", "x"),
        (1, "x", 0, "", "c"),
    ]
    df = spark.createDataFrame(rows, "query_id int, query string, search_index int, title string, channel string").withColumn("views", F.lit(0).cast("bigint")).withColumn("verified", F.lit(False))
    scored = {(r.query_id, r.search_index): r.score for r in catalog.relevance_score(df).collect()}
    assert scored[0, 0] > .95 and scored[0, 3] > .95 and scored[0, 1] < scored[0, 0]
    top = catalog.top_results(catalog.relevance_score(df.where("query_id = 0")))
    assert sorted(r.search_index for r in top.collect()) == [0, 1, 3]


def test_candidates(spark):
    cases = {
        ("local", "file:///music/Track%20One.mp3"): "file:track one.mp3", ("local", "/x/track one.MP3"): "file:track one.mp3",
        ("video", "https://youtu.be/X"): "youtube-video:X", ("video", "https://www.youtube.com/watch?v=X&t=1"): "youtube-video:X",
        ("video", "https://m.youtube.com/watch?v=X&list=L"): "youtube-playlist:L", ("search", "  A   b "): "search:a b",
        ("video", "https://Example.COM/A/#x"): "url:https://example.com/A",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases], "kind string, input string")
    assert {(r.kind, r.input): r.k for r in df.select("*", text.candidate_key(F.col("kind"), F.col("input")).alias("k")).collect()} == cases
    hosts = {"https://music.youtube.com/x": "YouTube", "https://a.bandcamp.com/t": "Bandcamp", "https://u:p@soundcloud.com:80/x": "SoundCloud", "https://notsoundcloud.com": "Web"}
    assert column(spark, list(hosts), "string", text.provider_of) == list(hosts.values())


def test_import_text(spark):
    urls = " ".join(f"(https://x.org/{i})," for i in range(25))
    doc = f"{urls}\nhttps://youtu.be/A https://www.youtube.com/watch?v=A\nfile:///m/a%20b.mp3\nsome song\n"
    listing = spark.createDataFrame([("/m/a b.mp3",)], "path string")
    made = imports.parse_import_text(spark.createDataFrame([("b", doc)], "batch_id string, text string"), listing).collect()
    kinds = [r.kind for r in made]
    assert (kinds.count("video"), kinds.count("local"), kinds.count("search")) == (26, 1, 1)
    assert [r.title for r in made if r.kind == "local"] == ["a b.mp3"]
    info = '{"chapters":[{"title":" Verse ","start_time":4,"end_time":20},{"title":"Chorus","start_time":20},{"title":"x","start_time":-1}]}'
    found = imports.chapters_to_markers(spark.createDataFrame([("t", info)], "track_id string, json string")).orderBy("start_s").collect()
    assert [(r.label, r.start_s, r.end_s) for r in found] == [("Verse", 4, 20), ("Chorus", 20, None)]


def test_scalars(spark):
    scores = [0.0, .244, .25, .494, .5, .744, .75, .994, 1.0, float("nan")]
    assert column(spark, scores, "double", lambda c: scalars.level_of_percent(scalars.relevance_percent(c))) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 0]
    assert column(spark, [181.0, 187.0, 194.0, 210.0, 240.0], "double", lambda c: scalars.duration_level(c, F.lit(180.0))) == [4, 3, 2, 1, 0]
    assert column(spark, [75.4, -1.0], "double", scalars.clock) == ["01:15", "00:00"]
    assert column(spark, [61.5], "double", scalars.clock_ms) == ["01:01.500"]
    assert column(spark, [.25, -1.5], "double", scalars.pitch_text) == ["+25 ct", "-1.50 st"]
    gain = column(spark, [-22.0, float("-inf"), -30.0], "double", lambda c: scalars.normalization_gain(c, F.lit(.25)))
    assert [round(g, 6) for g in gain] == [1.995262, 1.0, round(10 ** (-1 / 20) / .25, 6)]
    assert column(spark, [[0] * 64], "array<int>", lambda c: F.size(scalars.band_range(c, "mid"))) == [29]


def test_errors(spark):
    logs = ["does not pass filter is_live", "This video is DRM protected", "Video unavailable", "what"]
    assert column(spark, logs, "string", lambda c: text.error_class(c)[0]) == ["live", "drm", "unavailable", "other"]


def test_selection(spark):
    shape = "batch_id string, group_seq int, group_id string, group_kind string, query string, member_seq int, input string, blocked boolean"
    members = spark.createDataFrame([
        ("b", 0, "direct:x", "direct", None, 0, "x", False), ("b", 1, "search:q", "search", "q", 0, "q0", False), ("b", 1, "search:q", "search", "q", 1, "q1", False),
        ("b", 2, "search:r", "search", "r", 0, "r0", False), ("b", 3, "playlist:p", "playlist", "p", 0, "p0", False), ("b", 3, "playlist:p", "playlist", "p", 1, "p1", True)], shape)
    assert {r.input for r in selection.default_selection(members).collect()} == {"x", "r0", "p0"}
    assert {r.input for r in selection.default_selection(members, auto=True).collect()} == {"x", "q0", "r0", "p0"}
    chosen = spark.createDataFrame([("b", "q1"), ("b", "gone"), ("b", "p1")], "batch_id string, input string")
    assert {r.input for r in selection.reconcile_selection(chosen, members.where("group_seq < 2"), members).collect()} == {"q1", "r0", "p0"}


def test_jobs_and_logs(spark):
    rows = [("a", 2, "1", "completed", 1), ("a", 2, "2", "importing", 2), ("b", 2, "1", "completed", 1), ("c", 2, "1", "completed", 1), ("c", 2, "2", "failed", 2)]
    df = spark.createDataFrame(rows, "batch_id string, expected int, job_id string, state string, event_id bigint").withColumn("ts", F.col("event_id"))
    assert [(r.batch_id, r.completed, r.failed) for r in telemetry.import_batch_summary(df).collect()] == [("c", 1, 1)]
    lines = spark.createDataFrame([(" x ERROR y",), ("a WARN b",), ("a trace b",), ("hm",)], "line string")
    assert sorted(r.level for r in worker.scan_logs(lines).collect()) == ["debug", "error", "info", "warn"]
    units = spark.createDataFrame([(4, 12), (13, 12), (1, 5 * 1024**3), (None, 12)], "completed bigint, total bigint")
    assert [tuple(r) for r in telemetry.progress_sanity(units).collect()] == [(4, 12), (None, None), (None, None), (None, None)]


def _reports(*rows):
    return pd.DataFrame([("j", i, "fast", 240.0, *r) for i, r in enumerate(rows)], columns=["job_id", "seq", "profile", "duration_s", "stage", "completed", "total", "ts_ms"])


def test_remaining_time():
    rows = [("checkingCache", None, None, 0), ("separating", 0, 20, 1000), ("separating", 4, 20, 21000)]
    state, _ = telemetry.eta_rows(None, _reports(*rows[:2]))
    assert state[3] is None
    state, made = telemetry.eta_rows(None, _reports(*rows))
    assert state[3] == 5.0 and state[4] > 80
    split, first = telemetry.eta_rows(None, _reports(*rows[:2]))
    split, second = telemetry.eta_rows(split, _reports(*rows)[2:])
    assert split == state and [*first["remaining_s"], *second["remaining_s"]] == pytest.approx(list(made["remaining_s"]))
    assert telemetry.eta_rows(state, _reports(("writingStems", None, None, 30000)))[0][3] is None


def test_remaining_time_shown(spark):
    made = spark.createDataFrame([("j", 1, 1000, 90.0), ("j", 2, 5000, 60.0)], "job_id string, seq bigint, ts_ms bigint, remaining_s double")
    looks = spark.createDataFrame([("j", 1, 500, .1), ("j", 2, 3000, .2), ("j", 3, 9000, .5), ("j", 4, 9000, .999), ("j", 5, 99000, .9)], "job_id string, look_id int, ts_ms bigint, progress double")
    assert {r.look_id: r.shown_s for r in telemetry.remaining_shown(made, looks).collect()} == {1: None, 2: 88, 3: 56, 4: None, 5: 1}


def _meter(rows, hold_ms, state=None):
    part = pd.DataFrame([("t", i, at, left) for i, (at, left) in enumerate(rows)], columns=["track_id", "event_id", "ts_ms", "left"])
    return telemetry.meter_step("medium", hold_ms)(state, part)


def test_meter():
    assert _meter([(1000, .9), (1033, .1), (1066, .1), (1099, .1)], 0)[0][0] == pytest.approx(_meter([(1000, .9), (1099, .1)], 0)[0][0])
    peaks = list(_meter([(1000, .9), (1500, .1), (2200, .1), (2300, .1), (2400, .95)], 1000)[1]["held_peak"])
    assert peaks[:2] == [.9, .9] and peaks[2] == pytest.approx(.9 - 250 * .0008) and peaks[3] == pytest.approx(.9 - 350 * .0008) and peaks[4] == .95
    rows = [(1000 + 37 * i, abs(((i * 7919) % 101) / 101 - (i % 13) / 26)) for i in range(400)]
    whole = _meter(rows, 1000)[1]
    state, parts = None, []
    for low in range(0, 400, 61):
        state, made = _meter(rows[low: low + 61], 1000, state)
        parts.append(made)
    cut = pd.concat(parts)
    for name in ("level", "held_peak"):
        assert list(cut[name]) == pytest.approx(list(whole[name]))
    # each step by its rule
    level, peak, held, seen = 0.0, 0.0, 0, 0
    for (now, x), shown, top in zip(rows, whole["level"], whole["held_peak"]):
        gap = min(250, now - seen) if seen else 0
        level = x if x >= level else level + (x - level) * (1 - math.exp(-gap / 105))
        fallen = peak if now - held <= 1000 else peak - .0008 * gap
        peak, held, seen = (level, now, now) if level >= fallen else (fallen, held, now)
        assert (shown, top) == (pytest.approx(level), pytest.approx(peak))


def test_contracts(spark):
    good = timeline(spark, ("C", 0, 1), ("G", 1, 2))
    assert quality.check_chords(good).count() == 0
    bad = timeline(spark, ("C", 0, 1.5), ("G?", 1, 2, 1.5), ("D", 3, 3))
    assert {r.rule for r in quality.check_chords(bad).collect()} == {"overlap", "label", "source_label", "strength", "bounds"}


def test_search_rows(spark):
    rows = [
        (0, "q", 0, "youtube", '{"id":"a","title":"T [a]","channel":"C"}'), (0, "q", 1, "youtube", '{"title":"T","channel":"C"}'),
        (0, "q", 2, "youtube", '{"id":"b","channel":"C"}'), (0, "q", 3, "youtube", '{"id":"c","title":"T"}'), (0, "q", 4, "youtube", "not json")]
    df = spark.createDataFrame(rows, "query_id int, query string, search_index int, provider string, json string")
    assert [(r.id, r.title) for r in search.scan_search_results(df).collect()] == [("a", "T")]
