"""Registered queries over beats, markers and viewports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stave.operators import markers as M
from stave.operators import navigation as N
from stave.operators import rhythm as R
from stave.plans.chord_queries import r6
from stave.plans.registry import query, view

LOW, HIGH = repr(R.LOW) + "::DOUBLE", repr(R.HIGH) + "::DOUBLE"

view("v_beat_times", "SELECT track_id, beat_s, bool_or(is_downbeat) AS is_downbeat FROM v_grid WHERE beat_s >= 0 GROUP BY ALL")
view("v_intervals", """
SELECT track_id, beat_idx, beat_s, next_s - beat_s AS interval_s FROM (SELECT track_id, beat_s, row_number() OVER w - 1 AS beat_idx, lead(beat_s) OVER w AS next_s
  FROM v_beat_times WINDOW w AS (PARTITION BY track_id ORDER BY beat_s)) WHERE next_s IS NOT NULL""")
view("v_dominant", f"""
SELECT track_id, size, median(v) AS dominant_s FROM (
  SELECT i.track_id, c.size, i.interval_s AS v FROM v_intervals i JOIN (
    SELECT track_id, arg_max(v, struct_pack(size, neg := -v)) AS centre, max(size) AS size FROM (
      SELECT a.track_id, a.v, count(*) AS size FROM (SELECT DISTINCT track_id, interval_s AS v FROM v_intervals WHERE interval_s BETWEEN 12e-2 AND 2) a
      JOIN v_intervals b ON b.track_id = a.track_id AND b.interval_s BETWEEN 12e-2 AND 2 AND b.interval_s >= a.v * {LOW} AND b.interval_s <= a.v * {HIGH} GROUP BY ALL)
    GROUP BY track_id) c ON c.track_id = i.track_id
  WHERE i.interval_s BETWEEN 12e-2 AND 2 AND i.interval_s >= centre * {LOW} AND i.interval_s <= centre * {HIGH}) GROUP BY ALL""")


@query("global_bpm", """
SELECT track_id, round(60 / median(g) FILTER (g BETWEEN 2e-1 AND 2), 1) AS bpm
FROM (SELECT track_id, lead(beat_s) OVER (PARTITION BY track_id ORDER BY beat_s, beat_idx) - beat_s AS g FROM v_raw) GROUP BY ALL""")
def global_bpm(t):
    return R.global_bpm(t.raw)


@query("select_beat_source", """
SELECT track_id, beat_idx, beat_s, source FROM v_beats JOIN (SELECT track_id, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS o FROM v_tracks) USING (track_id)
WHERE source = CASE WHEN coalesce(o, true) THEN 'dbn' ELSE 'raw' END""")
def select_beat_source(t):
    own = F.when(F.col("user_id") % 3 == 0, True).when(F.col("user_id") % 3 == 1, False)
    return R.select_beat_source(t.beats, t.tracks.select("track_id", own.alias("beat_this_dbn")), True).select(
        "track_id", "beat_idx", "beat_s", "source")


@query("dominant_interval", "SELECT track_id, size::BIGINT AS size, round(dominant_s, 6) AS dominant_s FROM v_dominant")
def dominant_interval(t):
    return R.dominant_interval(t.intervals).select("track_id", "size", r6("dominant_s"))


@query("tempo_anomaly_runs", f"""
WITH f AS (SELECT i.*, r AS ratio, dominant_s, interval_s >= dominant_s * r * {LOW} AND interval_s <= dominant_s * r * {HIGH} AS near
  FROM v_intervals i JOIN v_dominant USING (track_id), (VALUES (5e-1), (2e0)) v(r)),
g AS (SELECT *, beat_idx - row_number() OVER (PARTITION BY track_id, ratio ORDER BY beat_idx) AS island FROM f WHERE near)
SELECT track_id, ratio, min(beat_idx) AS first_interval, count(*) AS n_intervals, round(sum(interval_s), 6) AS span_s
FROM g GROUP BY track_id, ratio, island, dominant_s HAVING count(*) >= 3 AND sum(interval_s) >= dominant_s * 4""")
def tempo_anomaly_runs(t):
    return R.tempo_anomaly_runs(t.intervals, R.target_interval(t.intervals)).select(
        "track_id", "ratio", "first_interval", "n_intervals", r6("span_s"))


view("v_flags", f"""
WITH f AS (SELECT i.*, r AS ratio, dominant_s, interval_s >= dominant_s * r * {LOW} AND interval_s <= dominant_s * r * {HIGH} AS near FROM v_intervals i JOIN v_dominant USING (track_id), (VALUES (5e-1), (2e0)) v(r)),
g AS (SELECT *, beat_idx - row_number() OVER (PARTITION BY track_id, ratio ORDER BY beat_idx) AS island FROM f WHERE near),
k AS (SELECT track_id, ratio, beat_idx, count(*) OVER x >= 3 AND sum(interval_s) OVER x >= dominant_s * 4 AS ok FROM g WINDOW x AS (PARTITION BY track_id, ratio, island))
SELECT i.track_id, i.beat_idx, i.beat_s, i.beat_s + 0e0 AS from_s, n.beat_s AS to_s, dominant_s AS target,
  EXISTS (SELECT 1 FROM k WHERE k.track_id = i.track_id AND k.beat_idx = i.beat_idx AND ratio < 1 AND ok) AS dense, EXISTS (SELECT 1 FROM k WHERE k.track_id = i.track_id AND k.beat_idx = i.beat_idx AND ratio > 1 AND ok) AS sparse,
  EXISTS (SELECT 1 FROM v_beat_times d WHERE d.is_downbeat AND d.track_id = i.track_id AND abs(d.beat_s - i.beat_s) <= 1e-3) AS from_down, EXISTS (SELECT 1 FROM v_beat_times d WHERE d.is_downbeat AND d.track_id = i.track_id AND abs(d.beat_s - n.beat_s) <= 1e-3) AS to_down
FROM v_intervals i JOIN v_dominant USING (track_id) JOIN (SELECT track_id, beat_s, row_number() OVER (PARTITION BY track_id ORDER BY beat_s) - 2 AS beat_idx FROM v_beat_times) n ON n.track_id = i.track_id AND n.beat_idx = i.beat_idx""")
_HOMOGENIZED = f"""
WITH RECURSIVE fl AS MATERIALIZED (SELECT * FROM v_flags),
w AS (SELECT track_id, 0::BIGINT AS i, [from_s] AS out, from_s AS last_s, from_down AS last_down, NULL::DOUBLE AS prev_s FROM fl WHERE beat_idx = 0
  UNION ALL SELECT track_id, i + 1, CASE WHEN NOT dense THEN CASE WHEN sparse THEN list_concat(out, [last_s + (to_s - last_s) / 2, to_s]) ELSE list_append(out, to_s) END
      WHEN prefer THEN list_append(out[1:len(out) - 1], to_s) WHEN far THEN list_append(out, to_s) ELSE out END,
    CASE WHEN NOT dense OR prefer OR far THEN to_s ELSE last_s END, CASE WHEN NOT dense OR prefer OR far THEN to_down ELSE last_down END,
    CASE WHEN NOT dense THEN CASE WHEN sparse THEN last_s + (to_s - last_s) / 2 ELSE last_s END WHEN prefer THEN prev_s WHEN far THEN last_s ELSE prev_s END
  FROM (SELECT w.*, to_s, to_down, dense, sparse, to_down AND NOT last_down AND (prev_s IS NULL OR to_s - prev_s BETWEEN target * {LOW} AND target * {HIGH}) AS prefer, to_s - last_s >= target * {LOW} AS far
    FROM w JOIN fl ON fl.track_id = w.track_id AND fl.beat_idx = w.i)),
h AS (SELECT track_id, unnest(out) AS beat_s FROM w QUALIFY i = max(i) OVER (PARTITION BY track_id))"""


@query("homogenize_beats", f"""{_HOMOGENIZED}
SELECT track_id, round(beat_s, 6) AS beat_s, EXISTS (SELECT 1 FROM v_beat_times d WHERE d.is_downbeat AND d.track_id = h.track_id AND abs(d.beat_s - h.beat_s) <= 1e-3) AS is_downbeat FROM h""")
def homogenize_beats(t):
    return R.homogenize_beats(t.grid).select("track_id", r6("beat_s"), "is_downbeat")


@query("homogenized_bpm", f"""{_HOMOGENIZED}
SELECT track_id, count(*) AS n_beats, round(60 / median(g) FILTER (g > 0), 6) AS bpm FROM (SELECT track_id, lead(beat_s) OVER (PARTITION BY track_id ORDER BY beat_s) - beat_s AS g FROM h) GROUP BY ALL""")
def homogenized_bpm(t):
    return R.homogenized_bpm(R.homogenize_beats(t.grid)).select("track_id", "n_beats", r6("bpm"))


@query("local_bpm", """
WITH c AS (SELECT p.track_id, query_id, count(*) FILTER (beat_s < t_s) AS centre, count(*) AS n FROM v_positions p JOIN v_grid USING (track_id) GROUP BY ALL),
b AS (SELECT query_id, g.beat_idx, g.beat_s, lead(g.beat_s) OVER (PARTITION BY query_id ORDER BY g.beat_idx) - g.beat_s AS gap
  FROM c JOIN v_grid g ON g.track_id = c.track_id AND g.beat_idx BETWEEN greatest(0, centre - 4) AND least(n - 1, centre + 4)),
m AS (SELECT query_id, list_sort(list(gap) FILTER (gap BETWEEN 2e-1 AND 2)) AS l FROM b GROUP BY ALL),
s AS (SELECT b.*, l[len(l) // 2 + 1] AS med, coalesce(gap BETWEEN l[len(l) // 2 + 1] * 9e-1 AND l[len(l) // 2 + 1] * 11e-1, false) AS steady FROM b JOIN m USING (query_id)),
r AS (SELECT *, sum(CASE WHEN steady THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY beat_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM s),
k AS (SELECT query_id, coalesce(run, 0) AS run, count(*) AS n, min(beat_idx) AS f FROM r GROUP BY ALL),
best AS (SELECT query_id, arg_min(run, struct_pack(a := -n, f := f)) AS run FROM k GROUP BY ALL)
SELECT c.track_id, c.query_id, round(60 / nullif(regr_slope(beat_s, beat_idx), 0), 6) AS bpm FROM c LEFT JOIN best USING (query_id) LEFT JOIN r ON r.query_id = c.query_id AND coalesce(r.run, 0) = best.run GROUP BY ALL""")
def local_bpm(t):
    return R.local_bpm(t.positions, t.grid, 1.0).select("track_id", "query_id", r6("bpm"))


def _downbeats(t):
    stray = F.when(F.col("event_id") % 10 == 0, F.col("beat_us") + 1).otherwise(F.col("beat_us"))
    return t.raw.where("is_downbeat").select("track_id", (stray / 1e6).alias("downbeat_s"))


@query("downbeat_membership", """
WITH d AS (SELECT DISTINCT track_id, (beat_us + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) / 1e6 AS beat_s FROM v_raw WHERE is_downbeat),
b AS (SELECT DISTINCT track_id, beat_s FROM v_raw)
SELECT track_id, beat_s, CASE WHEN d.beat_s IS NULL THEN 'beat' ELSE 'downbeat' END AS kind FROM b LEFT JOIN d USING (track_id, beat_s)
UNION ALL SELECT track_id, beat_s, 'stray downbeat' FROM d ANTI JOIN b USING (track_id, beat_s)""")
def downbeat_membership(t):
    return R.downbeat_membership(t.raw, _downbeats(t))


_ANCHOR_SQL = """
SELECT p.track_id, query_id, {cols} FROM v_positions p LEFT JOIN LATERAL (SELECT {aggs} FROM {anchors} a WHERE a.track_id = p.track_id) ON true"""


@query("adjacent_beat", """
WITH a AS (SELECT track_id, beat_s, lag(beat_s) OVER w AS p, lead(beat_s) OVER w AS n FROM (SELECT DISTINCT track_id, beat_s FROM v_raw) WINDOW w AS (PARTITION BY track_id ORDER BY beat_s)),
h AS (SELECT q.track_id, query_id, t_s, arg_max(struct_pack(s := beat_s, p := p, n := n), beat_s) FILTER (beat_s <= t_s + 1e-2) AS b, min(beat_s) AS first_s
  FROM v_positions q LEFT JOIN a USING (track_id) GROUP BY ALL)
SELECT track_id, query_id, CASE WHEN b IS NULL THEN coalesce(first_s, t_s) ELSE coalesce(b.p, b.s) END AS prev_s,
  CASE WHEN b IS NULL THEN coalesce(first_s, t_s) ELSE coalesce(b.n, b.s) END AS next_s FROM h""")
def adjacent_beat(t):
    return N.adjacent_anchor(t.positions, t.raw.select("track_id", F.col("beat_s").alias("a_s"))).select(
        "track_id", "query_id", "prev_s", "next_s")


_NEAREST_SQL = """
SELECT track_id, query_id, coalesce(CASE WHEN b IS NULL OR t_s - b > f - t_s THEN f WHEN f IS NULL OR t_s - b <= f - t_s THEN b END, t_s) AS snapped_s
FROM (SELECT q.track_id, query_id, t_s, max(a_s) FILTER (a_s <= t_s) AS b, min(a_s) FILTER (a_s > t_s) AS f FROM {0} q LEFT JOIN {1} a USING ({2}) GROUP BY ALL)"""

view("v_beat_anchors", "SELECT track_id, beat_s AS a_s FROM v_raw")
view("v_anchors", """
SELECT track_id, 'beat' AS mode, beat_s AS a_s FROM v_raw UNION ALL SELECT track_id, 'chord', start_s FROM v_chords WHERE event_type <> 'view'
UNION ALL SELECT track_id, 'marker', start_s FROM v_markers UNION ALL SELECT track_id, 'lyrics', end_s FROM v_markers WHERE end_s IS NOT NULL""")


@query("nearest_beat", _NEAREST_SQL.format("v_positions", "v_beat_anchors", "track_id"))
def nearest_beat(t):
    return N.nearest_anchor(t.positions, t.raw.select("track_id", F.col("beat_s").alias("a_s"))).select("track_id", "query_id", "snapped_s")


def _anchors(t):
    parts = [
        ("beat", t.raw.select("track_id", F.col("beat_s").alias("a_s"))),
        ("chord", t.chords.where("event_type <> 'view'").select("track_id", F.col("start_s").alias("a_s"))),
        ("marker", t.markers.select("track_id", F.col("start_s").alias("a_s"))),
        ("lyrics", t.markers.where("end_s IS NOT NULL").select("track_id", F.col("end_s").alias("a_s"))),
    ]
    out = None
    for mode, df in parts:
        df = df.withColumn("mode", F.lit(mode))
        out = df if out is None else out.unionByName(df)
    return out


@query("snap_position", f"""
WITH q AS (SELECT *, ['beat','chord','marker','lyrics','time'][query_id % 5 + 1] AS mode FROM v_positions),
own AS (SELECT q.query_id, max(a_s) FILTER (a_s <= t_s) AS b, min(a_s) FILTER (a_s > t_s) AS f FROM q JOIN v_anchors a USING (track_id, mode) GROUP BY ALL),
beat AS ({_NEAREST_SQL.format('v_positions', 'v_beat_anchors', 'track_id')})
SELECT q.track_id, q.query_id, q.mode, coalesce(CASE WHEN b IS NULL OR t_s - b > f - t_s THEN f ELSE b END, snapped_s) AS snapped_s
FROM q LEFT JOIN own USING (query_id) JOIN beat USING (query_id)""")
def snap_position(t):
    modes = F.array(*[F.lit(m) for m in ("beat", "chord", "marker", "lyrics", "time")])
    q = t.positions.withColumn("mode", F.element_at(modes, (F.col("query_id") % 5 + 1).cast("int")))
    return N.snap_position(q, _anchors(t)).select("track_id", "query_id", "mode", "snapped_s")


view("v_boundaries", """
SELECT DISTINCT track_id, unnest([start_s, end_s]) AS boundary_s FROM (SELECT track_id, start_s, end_s FROM v_markers UNION ALL
  SELECT track_id, start_s, end_s FROM v_chords WHERE source_label = 'N')""")


def _lanes(t):
    return N.lane_boundaries(t.markers, t.chords.where("source_label = 'N'"))


@query("lane_boundaries", "SELECT track_id, boundary_s FROM v_boundaries WHERE boundary_s IS NOT NULL")
def lane_boundaries(t):
    return _lanes(t)


@query("snap_to_lanes", """
WITH h AS (SELECT p.track_id, query_id, t_s, arg_max(boundary_s, struct_pack(d := -abs(boundary_s - t_s), b := boundary_s)) AS s
  FROM v_positions p LEFT JOIN (SELECT * FROM v_boundaries WHERE boundary_s IS NOT NULL) USING (track_id) GROUP BY ALL)
SELECT track_id, query_id, CASE WHEN abs(s - t_s) <= 1e-1 THEN s ELSE t_s END AS snapped_s FROM h""")
def snap_to_lanes(t):
    return N.snap_to_lanes(t.positions, _lanes(t), 0.1).select("track_id", "query_id", "snapped_s")


@query("track_coverage", """
SELECT track_id, 'time' || CASE WHEN track_id IN (SELECT track_id FROM v_raw) THEN ',beat' ELSE '' END || CASE WHEN track_id IN (SELECT track_id FROM v_chords WHERE event_type = 'error') THEN ',chord' ELSE '' END
  || CASE WHEN track_id IN (SELECT track_id FROM v_markers) THEN ',marker' ELSE '' END || CASE WHEN track_id IN (SELECT track_id FROM v_positions WHERE query_id % 50 = 0) THEN ',lyrics' ELSE '' END AS modes FROM v_tracks""")
def track_coverage(t):
    return N.track_coverage(
        t.tracks, beat=t.raw, chord=t.chords.where("event_type = 'error'"), marker=t.markers, lyrics=t.positions.where("query_id % 50 = 0"))


view("v_views", """
SELECT track_id, query_id AS viewport_id, (1 + query_id % 8)::DOUBLE AS zoom, t_s / duration_s AS start, duration_s FROM v_positions JOIN (SELECT track_id, duration_s FROM v_tracks) USING (track_id)""")


def viewports(t):
    return t.positions.join(t.tracks.select("track_id", "duration_s"), "track_id").select(
        "track_id", F.col("query_id").alias("viewport_id"), (1 + F.col("query_id") % 8).cast("double").alias("zoom"),
        (F.col("t_s") / F.col("duration_s")).alias("start"), "duration_s")


@query("beat_lines", """
WITH h AS (SELECT viewport_id, zoom, start, duration_s, b.* FROM v_views v JOIN v_raw b ON b.track_id = v.track_id AND beat_s >= start * duration_s AND beat_s <= (start + 1 / zoom) * duration_s
  WHERE duration_s / zoom <= 30 OR (zoom >= 15e-1 AND is_downbeat)),
n AS (SELECT *, row_number() OVER (PARTITION BY viewport_id ORDER BY beat_s, beat_idx) - 1 AS i, count(*) OVER (PARTITION BY viewport_id) AS k FROM h)
SELECT track_id, viewport_id, beat_s, round((beat_s / duration_s - start) * zoom * 100, 6) AS percent, is_downbeat AS accent FROM n WHERE i % greatest(1, ceil(k / 5))::BIGINT = 0""")
def beat_lines(t):
    return R.beat_lines(t.raw, viewports(t), limit=5).select("track_id", "viewport_id", "beat_s", r6("percent"), "accent")


view("v_marker_ends", """
SELECT m.*, duration_s, row_number() OVER w - 1 AS idx, greatest(start_s, least(duration_s, coalesce(lead(start_s) OVER w, duration_s),
  coalesce(end_s, lead(start_s) OVER w, duration_s))) AS shown_end_s FROM v_markers m JOIN (SELECT track_id, duration_s FROM v_tracks) USING (track_id)
WINDOW w AS (PARTITION BY track_id ORDER BY start_s, marker_id)""")


@query("marker_ends", "SELECT track_id, marker_id, idx, shown_end_s FROM v_marker_ends")
def marker_ends(t):
    return M.marker_ends(t.markers, t.tracks).select("track_id", "marker_id", "idx", "shown_end_s")


@query("sorted_markers", "SELECT track_id, marker_id, start_s FROM v_markers ORDER BY track_id, start_s, marker_id")
def sorted_markers(t):
    return M.sorted_markers(t.markers).select("track_id", "marker_id", "start_s")


@query("active_marker", """
SELECT p.track_id, query_id, coalesce(max(idx), -1) AS idx, arg_max(marker_id, idx) AS marker_id FROM v_positions p
LEFT JOIN v_marker_ends m ON m.track_id = p.track_id AND t_s >= start_s AND t_s < shown_end_s GROUP BY ALL""")
def active_marker(t):
    return M.active_marker(t.positions, M.marker_ends(t.markers, t.tracks)).select(
        "track_id", "query_id", F.coalesce("idx", F.lit(-1)).alias("idx"), "marker_id")


@query("edge_snap", """
SELECT track_id, marker_id AS region_id, CASE WHEN l <= shown_end_s - 5e-2 THEN l END AS snapped_start_s, CASE WHEN r >= start_s + 5e-2 THEN r END AS snapped_end_s
FROM (SELECT *, coalesce(lag(shown_end_s) OVER w, 0) AS l, coalesce(lead(start_s) OVER w, duration_s) AS r FROM v_marker_ends WINDOW w AS (PARTITION BY track_id ORDER BY start_s, marker_id))""")
def edge_snap(t):
    regions = M.marker_ends(t.markers, t.tracks).select("track_id", F.col("marker_id").alias("region_id"), "start_s", F.col("shown_end_s").alias("end_s"))
    return M.edge_snap(regions, t.tracks)


@query("default_region_end", """
SELECT p.track_id, query_id, coalesce(min(start_s) FILTER (start_s > t_s + 1e-3), any_value(duration_s)) AS end_s
FROM v_positions p JOIN (SELECT track_id, duration_s FROM v_tracks) USING (track_id) LEFT JOIN v_markers m USING (track_id) GROUP BY ALL""")
def default_region_end(t):
    return M.default_region_end(t.positions, t.markers, t.tracks).select("track_id", "query_id", "end_s")


def _one_position(t):
    return t.positions.groupBy("track_id").agg(F.min("t_s").alias("start_s"), F.min("query_id").alias("query_id"))


@query("marker_upsert", """
WITH ch AS (SELECT track_id, marker_id, 'renamed' AS label, start_s, end_s, origin FROM v_markers WHERE label = 'Part 3'),
base AS (SELECT track_id, marker_id, label, start_s, end_s, origin FROM v_markers WHERE label <> 'Part 3' UNION ALL SELECT * FROM ch),
ended AS (SELECT b.*, shown_end_s, duration_s FROM base b JOIN v_marker_ends USING (track_id, marker_id)),
ins AS (SELECT track_id, greatest(0, least(min(t_s), greatest(0, any_value(duration_s) - 5e-2))) AS s, min(query_id) AS q FROM v_positions JOIN v_tracks USING (track_id) GROUP BY ALL),
ok AS (SELECT * FROM ins WHERE NOT EXISTS (SELECT 1 FROM ended e WHERE e.track_id = ins.track_id AND abs(start_s - s) < 1e-2) AND (SELECT count(*) FROM ended e WHERE e.track_id = ins.track_id) < 512)
SELECT e.track_id, marker_id, label, start_s, CASE WHEN start_s < s AND shown_end_s > s THEN s ELSE end_s END AS end_s, origin FROM ended e LEFT JOIN ok USING (track_id)
UNION ALL SELECT track_id, 'n' || q, 'New', s, NULL, 'user' FROM ok""")
def marker_upsert(t):
    shape = t.markers.select("track_id", "marker_id", "label", "start_s", "end_s", "origin")
    renamed = M.replace_markers(shape, shape.where("label = 'Part 3'").withColumn("label", F.lit("renamed")))
    inserts = _one_position(t).select(
        "track_id", F.concat(F.lit("n"), "query_id").alias("marker_id"), F.lit("New").alias("label"), "start_s",
        F.lit(None).cast("double").alias("end_s"), F.lit("user").alias("origin"))
    return M.insert_markers(renamed, t.tracks, inserts)


def _intervals(t):
    chords = t.chords.select("track_id", F.lit("chords").alias("lane"), F.col("idx").cast("string").alias("item_id"), "start_s", "end_s")
    marks = M.marker_ends(t.markers, t.tracks).select(
        "track_id", F.lit("markers").alias("lane"), F.col("marker_id").alias("item_id"), "start_s", F.col("shown_end_s").alias("end_s"))
    return chords.unionByName(marks)


@query("viewport_overlap", """
WITH i AS (SELECT track_id, 'chords' AS lane, idx::VARCHAR AS item_id, start_s, end_s FROM v_chords UNION ALL SELECT track_id, 'markers', marker_id, start_s, shown_end_s FROM v_marker_ends)
SELECT track_id, viewport_id, lane, item_id, round((lo / duration_s - start) * zoom * 100, 6) AS left_percent, round((hi - lo) / duration_s * zoom * 100, 6) AS width_percent
FROM (SELECT v.*, lane, item_id, greatest(start * duration_s, start_s) AS lo, least((start + 1 / zoom) * duration_s, end_s) AS hi FROM v_views v JOIN i USING (track_id)) WHERE hi > lo""")
def viewport_overlap(t):
    return N.viewport_overlap(_intervals(t), viewports(t)).select(
        "track_id", "viewport_id", "lane", "item_id", r6("left_percent"), r6("width_percent"))


def _settings(t):
    u = F.col("user_id")
    return t.tracks.select(
        "track_id", (F.lit(0.5) + u % 5 / 10).alias("start_rate"), (F.lit(0.9) + u % 12 / 10).alias("target_rate"), (u % 4).cast("int").alias("repetitions"),
        (u % 7 / 20).alias("increment"), (u % 6 != 0).alias("enabled"))


@query("practice_schedule", """
WITH s AS (SELECT track_id, greatest(5e-1, least(199e-2, 5e-1 + user_id % 5 / 10)) AS s, greatest(5e-1, least(2e0, 9e-1 + user_id % 12 / 10)) AS t,
  greatest(1, user_id % 4)::INT AS r, greatest(1e-2, least(25e-2, user_id % 7 / 20)) AS i, user_id % 6 <> 0 AS enabled FROM v_tracks)
SELECT track_id, k::INT AS stage, (k * r)::INT AS after_loops, round(least(s + k * i, t), 6) AS rate FROM s, range(200) g(k)
WHERE enabled AND t > s AND k <= ceil((t - 1e-6 - s) / i)""")
def practice_schedule(t):
    return R.practice_schedule(_settings(t)).select("track_id", "stage", "after_loops", r6("rate"))
