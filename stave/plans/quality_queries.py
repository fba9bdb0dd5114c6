"""Registered queries over contracts, incremental work, lyrics and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from stave.functions import scalars as S
from stave.functions import vocabulary as V
from stave.operators import incremental as INC
from stave.operators import lyrics as L
from stave.operators import navigation as N
from stave.operators import quality as Q
from stave.operators import telemetry as T
from stave.operators.timeline import annotate
from stave.plans.chord_queries import compact, r6
from stave.plans.registry import query, view
from stave.sinks import documents as D
from stave.sources import lyrics as LY
from stave.sources import worker as WK

# -- lyrics ------------------------------------------------------------------

_WS = r"[\s\x{00A0}\x{FEFF}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
_TRIM = lambda e: f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"
_LT, _WT = LY.LINE_TAG, LY.WORD_TAG
_MS = lambda m, s: f"floor(({m}::DOUBLE * 60 + {s}::DOUBLE) * 1000 + 5e-1)::BIGINT"
view("v_lrc_raw", f"""
SELECT track_id, duration_ms, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS pos FROM (
  SELECT track_id, duration_ms, string_split_regex({_TRIM('text')}, '\\r?\\n') AS ls FROM v_lyric_texts)""")
view("v_lrc_body", f"""
SELECT *, regexp_extract_all(raw, '{_LT}', 1) AS lm, regexp_extract_all(raw, '{_LT}', 2) AS lsec, regexp_extract_all(body, '{_WT}', 1) AS wm,
  regexp_extract_all(body, '{_WT}', 2) AS wsec, regexp_extract_all(body, '{_WT}', 3) AS wt FROM (SELECT *, {_TRIM(f"regexp_replace(raw, '{_LT}', '', 'g')")} AS body FROM v_lrc_raw)""")
view("v_lrc_lines", f"""
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY coalesce(start_ms, 9007199254740992), pos, tag) - 1 AS line_no, text, start_ms,
  CASE WHEN start_ms IS NOT NULL THEN coalesce(lead(start_ms) OVER (PARTITION BY track_id ORDER BY coalesce(start_ms, 9007199254740992), pos, tag), CASE WHEN duration_ms > start_ms THEN duration_ms END) END AS end_ms,
  wm, wsec, wt, timed FROM (
  SELECT *, CASE WHEN timed THEN {_MS('lm[tag]', 'lsec[tag]')} END AS start_ms FROM (
    SELECT *, unnest(CASE WHEN timed THEN range(1, len(lm) + 1) ELSE [1] END) AS tag FROM (
      SELECT *, len(lm) > 0 AS timed, CASE WHEN len(lm) > 0 AND len(wt) > 0 AND array_to_string(wt, '') <> '' THEN {_TRIM("array_to_string(wt, '')")} ELSE body END AS text FROM v_lrc_body)
    WHERE text <> '' AND (timed OR NOT regexp_matches(body, '(?i)^\\[[a-z]+:'))))""")
view("v_lrc_words", f"""
SELECT track_id, line_no, row_number() OVER (PARTITION BY track_id, line_no ORDER BY k) - 1 AS word_no, text, start_ms, end_ms FROM (
  SELECT track_id, line_no, k, wt[k] AS text, {_MS('wm[k]', 'wsec[k]')} AS start_ms, CASE WHEN k < len(wm) THEN {_MS('wm[k + 1]', 'wsec[k + 1]')} END AS end_ms
  FROM (SELECT *, unnest(range(1, len(wm) + 1)) AS k FROM v_lrc_lines WHERE timed)) WHERE text <> ''""")
view("v_docs", """
SELECT track_id, offset_ms, duration_ms, n_lines, CASE WHEN track_id IN (SELECT track_id FROM v_lrc_words) THEN 'word' WHEN timed THEN 'line' ELSE 'none' END AS sync_level
FROM v_lyric_texts JOIN (SELECT track_id, count(*) AS n_lines, bool_or(start_ms IS NOT NULL) AS timed FROM v_lrc_lines GROUP BY ALL) USING (track_id)""")
view("v_now", """
SELECT track_id, query_id, query_id * 2500 + 1234 AS now_ms FROM (SELECT track_id, unnest(range(duration_ms // 2500 - 2)) AS query_id FROM v_lyric_texts)""")


@query("parse_lrc", "SELECT track_id, line_no, text, coalesce(start_ms, -1) AS start_ms, coalesce(end_ms, -1) AS end_ms FROM v_lrc_lines")
def parse_lrc(t):
    lines, _ = LY.parse_lrc(t.lyric_texts, t.lyric_heads)
    return lines.select("track_id", "line_no", "text", F.coalesce("start_ms", F.lit(-1)).alias("start_ms"), F.coalesce("end_ms", F.lit(-1)).alias("end_ms"))


@query("parse_lrc_words", "SELECT track_id, line_no, word_no::INT AS word_no, text, start_ms, coalesce(end_ms, -1) AS end_ms FROM v_lrc_words")
def parse_lrc_words(t):
    _, words = LY.parse_lrc(t.lyric_texts, t.lyric_heads)
    return words.select("track_id", "line_no", "word_no", "text", "start_ms", F.coalesce("end_ms", F.lit(-1)).alias("end_ms"))


def _broken(t):
    """Lyric texts, some with a time tag out of range appended."""
    doc = F.regexp_extract("track_id", r"(\d+)", 1).cast("bigint")
    tail = F.when(doc % 5 == 1, "\n[01:60.00]late").when(doc % 5 == 2, "\nword <2:7>x").when(doc % 5 == 3, "\n[1:02.5]fine [ab:] <12:00.000>").otherwise("")
    return t.lyric_texts.select("track_id", F.concat("text", tail).alias("text"))


@query("lrc_validate", """
SELECT track_id, CASE WHEN (regexp_extract(track_id, '(\\d+)', 1)::BIGINT % 5) IN (1, 2) THEN 'invalid timestamp' ELSE 'ok' END AS verdict FROM v_lyric_texts""")
def lrc_validate(t):
    return LY.lrc_validate(_broken(t)).select("track_id", "verdict")


def _ttml(t):
    def paragraph(line, i):
        safe = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        begin, minute = (i * 2 + 1).cast("string"), F.lpad((i % 60).cast("string"), 2, "0")
        return F.concat(F.lit('<p begin="'), begin, F.lit('.5s" end="0:'), minute, F.lit(':30.25"><span begin="'), begin, F.lit('.5s">'), safe, F.lit("</span><br/></p>"))

    lines = F.transform(F.split("text", "\n"), paragraph)
    return t.source("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("track_id"), F.concat(F.lit("<tt><body>"), F.array_join(lines, "\n"), F.lit("</body></tt>")).alias("text"))


@query("parse_ttml", f"""
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS line_no, {_TRIM('line')} AS text, (i * 2 + 1) * 1000 + 500 AS start_ms, (i % 60) * 60000 + 30250 AS end_ms
FROM (SELECT 'd' || doc_id AS track_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE {_TRIM('line')} <> ''""")
def parse_ttml(t):
    return LY.parse_ttml(_ttml(t))[0]


@query("parse_ttml_words", f"""
SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY i) - 1 AS line_no, 0 AS word_no, line AS text, (i * 2 + 1) * 1000 + 500 AS start_ms, -1::BIGINT AS end_ms
FROM (SELECT 'd' || doc_id AS track_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE {_TRIM('line')} <> ''""")
def parse_ttml_words(t):
    return LY.parse_ttml(_ttml(t))[1].withColumn("end_ms", F.coalesce("end_ms", F.lit(-1).cast("bigint")))


@query("lyric_line_ends", """
SELECT track_id, line_no, coalesce(CASE WHEN start_ms IS NULL OR line_no % 5 = 0 THEN e ELSE coalesce(nxt, CASE WHEN duration_ms > start_ms THEN duration_ms END) END, -1) AS end_ms
FROM (SELECT *, CASE WHEN line_no % 5 = 0 THEN end_ms END AS e, (SELECT arg_min(b.start_ms, b.line_no) FROM v_lrc_lines b WHERE b.track_id = a.track_id AND b.line_no > a.line_no AND b.start_ms IS NOT NULL) AS nxt
  FROM v_lrc_lines a JOIN (SELECT track_id, duration_ms FROM v_lyric_texts) USING (track_id))""")
def lyric_line_ends(t):
    open_ends = t.lyric_lines.withColumn("end_ms", F.when(F.col("line_no") % 5 == 0, F.col("end_ms")))
    return L.lyric_line_ends(open_ends, t.lyric_heads.select("track_id", "duration_ms")).select("track_id", "line_no", F.coalesce("end_ms", F.lit(-1)).alias("end_ms"))


_ACTIVE = """
SELECT p.track_id, query_id, now_ms, now_ms - offset_ms AS at_ms, max(line_no) AS n, arg_max(end_ms, line_no) AS e FROM v_now p
JOIN (SELECT track_id, offset_ms FROM v_docs WHERE sync_level <> 'none') d USING (track_id) LEFT JOIN v_lrc_lines l ON l.track_id = p.track_id AND l.start_ms <= now_ms - offset_ms GROUP BY ALL"""
view("v_active", f"SELECT * EXCLUDE (n, e), CASE WHEN n IS NOT NULL AND (e IS NULL OR at_ms < e) THEN n END AS line_no FROM ({_ACTIVE})")


def active(t):
    return L.active_lyric_line(t.lyric_positions, t.lyric_docs, t.lyric_lines)


@query("active_lyric_line", "SELECT track_id, query_id::INT AS query_id, coalesce(line_no, -1) AS line_no FROM v_active")
def active_lyric_line(t):
    return active(t).select("track_id", "query_id", F.coalesce("line_no", F.lit(-1)).alias("line_no"))


@query("active_lyric_word", """
SELECT a.track_id, query_id::INT AS query_id, a.line_no, coalesce(max(word_no) FILTER (start_ms <= at_ms), -1)::INT AS word_no FROM v_active a
LEFT JOIN v_lrc_words w ON w.track_id = a.track_id AND w.line_no = a.line_no WHERE a.line_no IS NOT NULL GROUP BY ALL""")
def active_lyric_word(t):
    return L.active_lyric_word(active(t), t.lyric_parsed).select("track_id", "query_id", "line_no", "word_no")


@query("estimated_line", """
SELECT track_id, query_id::INT AS query_id, least(n_lines - 1, floor(greatest(0, least(1, now_ms / duration_ms)) * n_lines))::BIGINT AS line_no FROM v_now JOIN v_docs USING (track_id) WHERE sync_level = 'none'""")
def estimated_line(t):
    return L.estimated_line(t.lyric_positions, t.lyric_docs).select("track_id", "query_id", "line_no")


@query("line_progress", """
SELECT track_id, query_id::INT AS query_id, line_no, round(CASE WHEN e > s THEN greatest(0, least(1, (now_ms - s) / (e - s))) WHEN now_ms >= s THEN 1 ELSE 0 END, 6) AS progress
FROM (SELECT a.*, start_ms + offset_ms AS s, coalesce(end_ms, nxt, duration_ms) + offset_ms AS e FROM v_active a
  JOIN (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY line_no) AS nxt FROM v_lrc_lines) USING (track_id, line_no) JOIN v_docs USING (track_id))""")
def line_progress(t):
    return L.line_progress(active(t), t.lyric_docs, t.lyric_lines).select("track_id", "query_id", "line_no", r6("progress"))


@query("lyric_nav_points", """
SELECT track_id, line_no, (start_ms + offset_ms) / 1e3 AS point_s FROM v_lrc_lines JOIN v_docs USING (track_id) WHERE start_ms + offset_ms >= 0 AND (start_ms + offset_ms) / 1e3 <= duration_ms / 1e3""")
def lyric_nav_points(t):
    return L.lyric_nav_points(t.lyric_lines, t.lyric_docs)


@query("lyrics_viewport", """
WITH v AS (SELECT track_id, duration_ms / 1e3 AS d FROM v_docs WHERE sync_level <> 'none'),
i AS (SELECT track_id, line_no, (start_ms + offset_ms) / 1e3 AS s, (least(end_ms, nxt, duration_ms - offset_ms) + offset_ms) / 1e3 AS e
  FROM (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY line_no) AS nxt FROM v_lrc_lines) JOIN v_docs USING (track_id) WHERE start_ms IS NOT NULL AND sync_level <> 'none')
SELECT track_id, line_no::VARCHAR AS item_id, round((lo / d - 25e-2) * 4 * 100, 6) AS left_percent, round((hi - lo) / d * 4 * 100, 6) AS width_percent
FROM (SELECT *, greatest(0, 25e-2 * d, s) AS lo, least(d, 5e-1 * d, e) AS hi FROM i JOIN v USING (track_id)) WHERE hi > lo""")
def lyrics_viewport(t):
    views = t.lyric_docs.select(
        "track_id", F.lit(0).alias("viewport_id"), F.lit(4.0).alias("zoom"), F.lit(0.25).alias("start"), (F.col("duration_ms") / 1000.0).alias("duration_s"))
    return N.viewport_overlap(L.lyric_spans(t.lyric_lines, t.lyric_docs), views).select("track_id", "item_id", r6("left_percent"), r6("width_percent"))


def _two(e):
    return f"(CASE WHEN ({e}) < 10 THEN '0' ELSE '' END || ({e}))"


_T = lambda ms: f"({_two(f'({ms}) // 60000')} || ':' || {_two(f'(({ms}) % 60000) // 1000')} || '.' || {_two(f'(({ms}) % 1000) // 10')})"


@query("export_lrc", f"""
SELECT track_id, 0::BIGINT AS line_no, '[offset:' || offset_ms || ']' AS line FROM v_docs WHERE offset_ms <> 0
UNION ALL SELECT l.track_id, l.line_no + 1, CASE WHEN l.start_ms IS NULL THEN l.text ELSE '[' || {_T('l.start_ms')} || ']' || coalesce(w.s, l.text) END
FROM v_lrc_lines l LEFT JOIN (SELECT track_id, line_no, string_agg('<' || {_T('start_ms')} || '>' || text, '' ORDER BY word_no) AS s FROM v_lrc_words GROUP BY ALL) w USING (track_id, line_no)""")
def export_lrc(t):
    return D.export_lrc(t.lyric_docs, t.lyric_lines, t.lyric_words)


@query("lyrics_offset", "SELECT event_id, floor(greatest(-30, least(30, value / 5 - 50)) * 10 + 5e-1)::BIGINT * 100 AS offset_ms FROM v_ev")
def lyrics_offset(t):
    return t.events.select("event_id", S.offset_ms(F.col("value") / 5 - 50).alias("offset_ms"))


# -- contracts ---------------------------------------------------------------


@query("check_lyrics", """
WITH d AS (SELECT track_id, offset_ms * 200 AS offset_ms, CASE WHEN offset_ms = 100 THEN ' ' ELSE 'en' END AS language FROM v_docs),
l AS (SELECT track_id, line_no, text, CASE WHEN line_no % 10 = 9 THEN start_ms - 9000 ELSE start_ms END AS start_ms, CASE WHEN line_no % 10 = 5 THEN start_ms ELSE end_ms END AS end_ms FROM v_lrc_lines),
lo AS (SELECT *, last_value(start_ms IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps FROM l),
w AS (SELECT w.*, l.start_ms AS ls, l.end_ms AS le, lag(w.start_ms) OVER (PARTITION BY track_id, line_no ORDER BY word_no) AS pw FROM v_lrc_words w JOIN l USING (track_id, line_no)),
r AS (SELECT track_id, 'offset' AS rule FROM d WHERE abs(offset_ms) > 30000 UNION ALL SELECT track_id, 'language' FROM d WHERE trim(language) = ''
  UNION ALL SELECT track_id, 'line order' FROM lo WHERE start_ms < ps UNION ALL SELECT track_id, 'line range' FROM l WHERE end_ms <= start_ms UNION ALL SELECT track_id, 'line text' FROM l WHERE length(text) > 4096
  UNION ALL SELECT track_id, 'word text' FROM w WHERE trim(text) = '' OR length(text) > 512 UNION ALL SELECT track_id, 'word order' FROM w WHERE start_ms < pw UNION ALL SELECT track_id, 'word range' FROM w WHERE end_ms <= start_ms
  UNION ALL SELECT track_id, 'word outside line' FROM w WHERE start_ms < ls OR start_ms >= le)
SELECT track_id, rule, count(*) AS n_bad FROM r GROUP BY ALL
UNION ALL SELECT track_id, 'line count', count(*) - 10000 FROM l GROUP BY track_id HAVING count(*) > 10000 UNION ALL SELECT track_id, 'word count', count(*) - 100000 FROM w GROUP BY track_id HAVING count(*) > 100000""")
def check_lyrics(t):
    docs = t.lyric_docs.withColumn("language", F.when(F.col("offset_ms") == 100, " ").otherwise("en")).withColumn("offset_ms", F.col("offset_ms") * 200)
    n = F.col("line_no") % 10
    lines = t.lyric_parsed.withColumn("end_ms", F.when(n == 5, F.col("start_ms")).otherwise(F.col("end_ms"))).withColumn(
        "start_ms", F.when(n == 9, F.col("start_ms") - 9000).otherwise(F.col("start_ms")))
    return Q.check_lyrics(docs, lines)


@query("check_chords", """
WITH c AS (SELECT track_id, mode, idx, CASE WHEN event_id % 40 = 3 THEN label || '?' ELSE label END AS label, source_label, start_s, CASE WHEN event_id % 50 = 7 THEN start_s ELSE end_s END AS end_s, strength * 11e-1 AS strength FROM v_compact),
o AS (SELECT *, coalesce(lag(end_s) OVER (PARTITION BY track_id, mode ORDER BY idx), 0) AS pe FROM c),
r AS (SELECT track_id, mode, 'label' AS rule FROM o WHERE contains(label, '?') UNION ALL SELECT track_id, mode, 'bounds' FROM o WHERE end_s <= start_s UNION ALL SELECT track_id, mode, 'overlap' FROM o WHERE start_s < pe
  UNION ALL SELECT track_id, mode, 'strength' FROM o WHERE NOT strength BETWEEN 0 AND 1001e-3)
SELECT track_id, mode, rule, count(*) AS n_bad FROM r GROUP BY ALL UNION ALL SELECT track_id, mode, 'count', count(*) - 8192 FROM c GROUP BY ALL HAVING count(*) > 8192""")
def check_chords(t):
    broken = compact(t).withColumn("label", F.when(F.col("event_id") % 40 == 3, F.concat("label", F.lit("?"))).otherwise(F.col("label"))).withColumn(
        "end_s", F.when(F.col("event_id") % 50 == 7, F.col("start_s")).otherwise(F.col("end_s"))).withColumn("strength", F.col("strength") * 1.1)
    return Q.check_chords(broken)


@query("check_beats", """
WITH b AS (SELECT track_id, source, beat_idx, CASE WHEN event_id % 60 = 5 THEN beat_s - 1 ELSE beat_s END AS beat_s, is_downbeat, event_id FROM v_beats),
o AS (SELECT *, coalesce(lag(beat_s) OVER (PARTITION BY track_id, source ORDER BY beat_idx), -1) AS p FROM b),
d AS (SELECT track_id, source, beat_idx, beat_s + CASE WHEN event_id % 10 = 0 THEN 1e-6 ELSE 0 END AS downbeat_s FROM b WHERE is_downbeat),
e AS (SELECT *, coalesce(lag(downbeat_s) OVER (PARTITION BY track_id, source ORDER BY beat_idx), -1) AS p FROM d),
r AS (SELECT track_id, source, 'beat bounds' AS rule FROM o WHERE beat_s < 0 UNION ALL SELECT track_id, source, 'beat order' FROM o WHERE beat_s <= p UNION ALL SELECT track_id, source, 'downbeat bounds' FROM e WHERE downbeat_s < 0
  UNION ALL SELECT track_id, source, 'downbeat order' FROM e WHERE downbeat_s <= p UNION ALL SELECT track_id, source, 'stray downbeat' FROM d WHERE (track_id, source, downbeat_s) NOT IN (SELECT (track_id, source, beat_s) FROM b)
  UNION ALL SELECT track_id, source, 'bpm' FROM (SELECT track_id, source, 20 + count(*) * 2 AS bpm FROM b GROUP BY ALL) WHERE NOT bpm BETWEEN 30 AND 150 AND (bpm < 30 OR bpm > 300))
SELECT track_id, source, rule, count(*) AS n_bad FROM r GROUP BY ALL""")
def check_beats(t):
    beats = t.beats.withColumn("beat_s", F.when(F.col("event_id") % 60 == 5, F.col("beat_s") - 1).otherwise(F.col("beat_s")))
    shifted = F.col("beat_s") + F.when(F.col("event_id") % 10 == 0, 1e-6).otherwise(0.0)
    downs = beats.where("is_downbeat").select("track_id", "source", F.col("beat_idx").alias("down_idx"), shifted.alias("downbeat_s"))
    tempos = beats.groupBy("track_id", "source").agg((20 + F.count(F.lit(1)) * 2).cast("double").alias("bpm"))
    return Q.check_beats(beats, downs, tempos)


view("v_practice", """
SELECT track_id, (user_id % 9 - 1)::DOUBLE AS position_s, 3e-1 + (user_id % 20) / 10 AS playback_rate, (user_id % 30 - 15)::DOUBLE AS pitch_semitones, (user_id % 12) / 5 AS volume, (user_id % 7) / 5 AS metronome_volume,
  user_id % 2 = 0 AS loop_enabled, CASE WHEN user_id % 4 <> 0 THEN (user_id % 5 - 1)::DOUBLE END AS loop_a_s, CASE WHEN user_id % 6 <> 0 THEN (user_id % 3)::DOUBLE END AS loop_b_s,
  (user_id % 110)::INT AS trainer_repetitions, 4e-1 + (user_id % 18) / 10 AS trainer_start_rate, (user_id % 30) / 100 AS trainer_increment, 5e-1 + (user_id % 17) / 10 AS trainer_target_rate,
  CASE WHEN user_id % 8 = 0 THEN 'bad' || chr(7) ELSE 'fine' || chr(10) END AS track_notes, user_id FROM v_tracks""")


def practice(t):
    u = F.col("user_id")
    return t.tracks.select(
        "track_id", (u % 9 - 1).cast("double").alias("position_s"), (F.lit(0.3) + u % 20 / 10).alias("playback_rate"), (u % 30 - 15).cast("double").alias("pitch_semitones"),
        (u % 12 / 5).alias("volume"), (u % 7 / 5).alias("metronome_volume"), (u % 2 == 0).alias("loop_enabled"), F.when(u % 4 != 0, (u % 5 - 1).cast("double")).alias("loop_a_s"),
        F.when(u % 6 != 0, (u % 3).cast("double")).alias("loop_b_s"), (u % 110).cast("int").alias("trainer_repetitions"), (F.lit(0.4) + u % 18 / 10).alias("trainer_start_rate"),
        (u % 30 / 100).alias("trainer_increment"), (F.lit(0.5) + u % 17 / 10).alias("trainer_target_rate"), F.when(u % 8 == 0, "bad\x07").otherwise("fine\n").alias("track_notes"), "user_id")


@query("check_practice_state", """
WITH m AS (SELECT *, lag(start_s) OVER w AS ps, lag(end_s) OVER w AS pe FROM v_markers WINDOW w AS (PARTITION BY track_id ORDER BY start_s, marker_id)),
g AS (SELECT track_id, 'essential' AS mode, idx AS seq, CASE WHEN source_label = 'N' THEN 'N' ELSE source_label END AS label, start_s, end_s, lag(end_s) OVER (PARTITION BY track_id ORDER BY idx) AS pe FROM v_chords),
r AS (SELECT track_id, 'position' AS rule FROM v_practice WHERE position_s < 0 UNION ALL SELECT track_id, 'playback_rate' FROM v_practice WHERE NOT playback_rate BETWEEN 5e-1 AND 2
  UNION ALL SELECT track_id, 'pitch' FROM v_practice WHERE NOT pitch_semitones BETWEEN -12 AND 12 UNION ALL SELECT track_id, 'volume' FROM v_practice WHERE NOT volume BETWEEN 0 AND 2
  UNION ALL SELECT track_id, 'metronome_volume' FROM v_practice WHERE NOT metronome_volume BETWEEN 0 AND 1 UNION ALL SELECT track_id, 'repetitions' FROM v_practice WHERE NOT trainer_repetitions BETWEEN 1 AND 99
  UNION ALL SELECT track_id, 'start_rate' FROM v_practice WHERE NOT (trainer_start_rate >= 5e-1 AND trainer_start_rate < 2) UNION ALL SELECT track_id, 'increment' FROM v_practice WHERE NOT trainer_increment BETWEEN 1e-2 AND 25e-2
  UNION ALL SELECT track_id, 'target_rate' FROM v_practice WHERE NOT trainer_target_rate BETWEEN 5e-1 AND 2 OR trainer_start_rate >= trainer_target_rate UNION ALL SELECT track_id, 'notes' FROM v_practice WHERE user_id % 8 = 0
  UNION ALL SELECT track_id, 'loop' FROM v_practice WHERE loop_a_s IS NOT NULL AND loop_b_s IS NOT NULL AND (loop_a_s < 0 OR loop_b_s <= loop_a_s)
  UNION ALL SELECT track_id, 'marker order' FROM m WHERE start_s <= ps OR pe > start_s UNION ALL SELECT track_id, 'marker past end' FROM m JOIN v_tracks USING (track_id) WHERE start_s >= duration_s OR end_s > duration_s
  UNION ALL SELECT track_id, 'region order' FROM g WHERE start_s < coalesce(pe, 0) UNION ALL SELECT track_id, 'region bounds' FROM g WHERE end_s <= start_s
  UNION ALL SELECT track_id, 'region past end' FROM g JOIN v_tracks USING (track_id) WHERE start_s >= duration_s OR end_s > duration_s
  UNION ALL SELECT track_id, 'edit bounds' FROM v_edits WHERE end_s <= start_s UNION ALL SELECT track_id, 'stem gain' FROM v_stem_mix WHERE NOT gain * 22e-1 BETWEEN 0 AND 2)
SELECT track_id, rule, count(*) AS n_bad FROM r GROUP BY ALL
UNION ALL SELECT track_id, 'edit repeated', sum(x)::BIGINT FROM (SELECT track_id, count(*) - 1 AS x FROM v_edits GROUP BY track_id, mode, start_s, end_s) GROUP BY ALL HAVING sum(x) > 0""")
def check_practice_state(t):
    regions = t.chords.select("track_id", F.lit("essential").alias("mode"), F.col("idx").alias("seq"), F.col("source_label").alias("label"), "start_s", "end_s")
    mix = t.stem_mix.withColumn("gain", F.col("gain") * 2.2)
    return Q.check_practice_state(practice(t), t.edits, t.markers, regions, mix, t.tracks)


@query("normalize_legacy", """
WITH p AS (SELECT *, greatest(5e-1, least(199e-2, trainer_start_rate)) AS s, greatest(5e-1, least(2e0, trainer_target_rate)) AS g,
  (loop_a_s IS NULL AND loop_b_s IS NULL) OR coalesce(loop_a_s >= 0 AND loop_b_s > loop_a_s, false) AS sound FROM v_practice)
SELECT track_id, greatest(0e0, position_s) AS position_s, greatest(5e-1, least(2e0, playback_rate)) AS playback_rate, greatest(-12e0, least(12e0, pitch_semitones)) AS pitch_semitones, greatest(0e0, least(2e0, volume)) AS volume,
  greatest(0e0, least(1e0, metronome_volume)) AS metronome_volume, greatest(1, least(99, trainer_repetitions))::INT AS trainer_repetitions, s AS trainer_start_rate, greatest(1e-2, least(25e-2, trainer_increment)) AS trainer_increment,
  CASE WHEN g <= s THEN least(2e0, s + 1e-2) ELSE g END AS trainer_target_rate, loop_enabled AND sound AS loop_enabled, CASE WHEN sound THEN loop_a_s END AS loop_a_s, CASE WHEN sound THEN loop_b_s END AS loop_b_s FROM p""")
def normalize_legacy(t):
    return Q.normalize_legacy(practice(t)).drop("track_notes", "user_id")


@query("normalize_preferences", """
SELECT track_id, greatest(1, least(10, user_id % 15))::INT AS toast_duration_s, greatest(1, least(8, user_id % 12))::INT AS concurrent_downloads, greatest(0e0, least(2e0, (user_id % 12) / 5)) AS master_volume,
  greatest(1, least(60, user_id % 70))::INT AS navigation_time_s, CASE WHEN user_id % 40 <= 9 THEN 5 WHEN user_id % 40 <= 22 THEN 15 ELSE 30 END AS energy_window_s, greatest(5e-1, least(199e-2, (user_id % 25) / 10)) AS default_trainer_start_rate,
  greatest(greatest(5e-1, least(199e-2, (user_id % 25) / 10)) + 1e-2, least(2e0, (user_id % 23) / 10)) AS default_trainer_target_rate, CASE WHEN user_id % 3 = 0 THEN 'fr' ELSE 'en' END AS language FROM v_tracks""")
def normalize_preferences(t):
    u = F.col("user_id")
    prefs = t.tracks.select(
        "track_id", (u % 15).cast("int").alias("toast_duration_s"), (u % 12).cast("int").alias("concurrent_downloads"), (u % 12 / 5).alias("master_volume"), (u % 70).cast("int").alias("navigation_time_s"),
        (u % 40).alias("energy_window_s"), (u % 25 / 10).alias("default_trainer_start_rate"), (u % 23 / 10).alias("default_trainer_target_rate"), F.when(u % 3 == 0, "fr").otherwise("xx").alias("language"))
    return Q.normalize_preferences(prefs)


@query("check_export", """
WITH s AS (SELECT track_id, mode, CASE WHEN event_id % 30 = 4 THEN -1e0 ELSE start_s END AS time, source_label || CASE WHEN event_id % 45 = 6 THEN chr(9) ELSE '' END AS value, strength * 12e-1 AS confidence FROM v_chords),
r AS (SELECT track_id, mode, 'time' AS rule FROM s WHERE time < 0 UNION ALL SELECT track_id, mode, 'value' FROM s WHERE contains(value, chr(9)) UNION ALL SELECT track_id, mode, 'confidence' FROM s WHERE confidence > 1)
SELECT track_id, mode, rule, count(*) AS n_bad FROM r GROUP BY ALL""")
def check_export(t):
    e = F.col("event_id")
    return Q.check_export(t.chords.select(
        "track_id", "mode", F.when(e % 30 == 4, -1.0).otherwise(F.col("start_s")).alias("time"), (F.col("end_s") - F.col("start_s")).alias("duration"),
        F.concat("source_label", F.when(e % 45 == 6, "\t").otherwise("")).alias("value"), (F.col("strength") * 1.2).alias("confidence")))


@query("check_lyric_records", "SELECT query_id, seq, id FROM v_lyric_results WHERE id > 0 AND trim(track_name) <> '' AND duration_s BETWEEN 0 AND 86400")
def check_lyric_records(t):
    return Q.check_lyric_records(t.lyric_results).select("query_id", F.col("seq").cast("bigint").alias("seq"), "id")


# -- worker results ----------------------------------------------------------


def worker_rows(t):
    """One JSON result per track and contract-sized stretch of its timeline."""
    def build():
        stretch = F.floor(F.col("idx") / 4096)
        c = t.chords.withColumn("part", stretch)
        seg = F.struct(
            F.col("idx").alias("o"), F.col("source_label").alias("label"), F.col("source_label").alias("sourceLabel"), F.col("start_s").alias("startSeconds"),
            F.col("end_s").alias("endSeconds"), F.col("strength"))
        rows = c.groupBy("track_id", "part").agg(
            F.array_sort(F.collect_list(seg)).alias("segs"), F.array_sort(F.collect_list("start_s")).alias("beats"),
            F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("start_s")))).alias("downs"))
        rows = rows.join(t.tracks.select("track_id", "user_id"), "track_id")
        u = F.col("user_id")
        mode = F.when(u % 3 == 0, "essential").when(u % 3 == 1, "standard").otherwise("complete")
        made = F.when(u % 7 == 6, F.lit("standard")).otherwise(mode)
        result = F.struct(
            F.when(u % 11 == 5, "other@1").otherwise("lv-chordia@1").alias("modelVersion"), F.lit("beat-this@2").alias("downbeatModelVersion"),
            F.when(u % 5 != 0, F.col("beats")).alias("beats"), F.when(u % 5 != 0, F.col("downs")).alias("downbeats"), F.when(u % 10 > 5, F.col("beats")).alias("dbnBeats"),
            F.when(u % 10 > 5, F.col("downs")).alias("dbnDownbeats"), F.when(u % 13 != 4, F.map_from_arrays(F.array(made), F.array("segs"))).otherwise(F.create_map().cast(
                "map<string,array<struct<o:bigint,label:string,sourceLabel:string,startSeconds:double,endSeconds:double,strength:double>>>")).alias("modes"),
            F.when(u % 13 == 4, F.array(F.lit("LV-Chordia failed: no memory"))).when(u % 17 == 3, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
        return rows.select(F.concat_ws("#", "track_id", "part").alias("track_id"), "user_id", mode.alias("requested_mode"), F.to_json(result).alias("json"))

    return t.stored("worker_rows", build)


view("v_worker", """
SELECT *, ['essential','standard','complete'][user_id % 3 + 1] AS requested_mode, CASE WHEN user_id % 7 = 6 THEN 'standard' ELSE ['essential','standard','complete'][user_id % 3 + 1] END AS made,
  user_id % 13 = 4 AS failed FROM v_tracks""")
view("v_part", "SELECT c.*, c.track_id || '#' || (idx // 4096) AS result_id, idx % 4096 AS part_idx FROM v_chords c")
view("v_result", "SELECT DISTINCT w.* REPLACE (result_id AS track_id) FROM v_worker w JOIN v_part p ON p.track_id = w.track_id")


@query("check_worker_result", """
WITH r AS (SELECT track_id, requested_mode, 'model version' AS rule FROM v_result WHERE user_id % 11 = 5
  UNION ALL SELECT track_id, requested_mode, 'mode missing' FROM v_result WHERE NOT failed AND made <> requested_mode
  UNION ALL SELECT track_id, requested_mode, 'mode unexpected' FROM v_result WHERE NOT failed AND made <> requested_mode
  UNION ALL SELECT track_id, requested_mode, 'rhythm incomplete' FROM v_result WHERE (user_id % 5 <> 0) <> (user_id % 10 > 5)
  UNION ALL SELECT track_id, requested_mode, 'warning' FROM v_result WHERE user_id % 17 = 3 AND NOT failed)
SELECT track_id, requested_mode, rule, 1::BIGINT AS n_bad FROM r""")
def check_worker_result(t):
    return Q.check_worker_result(WK.parse_worker_results(worker_rows(t)))


@query("scan_worker_results", """
SELECT c.track_id || '#' || (c.idx // 4096) AS track_id, w.made AS mode, (c.idx % 4096)::INT AS idx, c.label, c.start_s, c.end_s, c.strength FROM v_compact c JOIN v_worker w USING (track_id) WHERE NOT w.failed""")
def scan_worker_results(t):
    return WK.chords(WK.parse_worker_results(worker_rows(t))).select("track_id", "mode", "idx", "label", "start_s", "end_s", "strength")


@query("scan_worker_beats", """
SELECT track_id, source, (row_number() OVER (PARTITION BY track_id, source ORDER BY beat_s) - 1)::INT AS beat_idx, beat_s, is_downbeat FROM (
  SELECT c.result_id AS track_id, source, start_s AS beat_s, bool_or(event_type = 'purchase') OVER (PARTITION BY c.result_id, source, start_s) AS is_downbeat FROM v_part c JOIN v_worker w USING (track_id),
    (VALUES ('raw'), ('dbn')) v(source) WHERE CASE source WHEN 'raw' THEN w.user_id % 5 <> 0 ELSE w.user_id % 10 > 5 END)""")
def scan_worker_beats(t):
    return WK.beats(WK.parse_worker_results(worker_rows(t)))


view("v_identity", "SELECT track_id, user_id, file_size_bytes AS source_size, user_id * 1000003 AS source_modified_ns FROM v_tracks")
view("v_cached", """
SELECT track_id, CASE WHEN user_id % 9 = 0 THEN 15 ELSE 16 END AS cache_version, source_size + CASE WHEN user_id % 8 = 0 THEN 1 ELSE 0 END AS source_size, source_modified_ns,
  CASE user_id % 4 WHEN 0 THEN ['standard'] WHEN 1 THEN ['essential', 'standard', 'complete'] ELSE [] END AS modes, user_id FROM v_identity WHERE user_id % 5 <> 1""")


def identity(t):
    return t.tracks.select("track_id", "user_id", F.col("file_size_bytes").alias("source_size"), (F.col("user_id") * 1000003).alias("source_modified_ns"))


def cached(t):
    u = F.col("user_id")
    modes = F.when(u % 4 == 0, F.array(F.lit("standard"))).when(u % 4 == 1, F.array(*[F.lit(m) for m in V.MODES])).otherwise(F.array().cast("array<string>"))
    return identity(t).where("user_id % 5 <> 1").select(
        "track_id", F.when(u % 9 == 0, 15).otherwise(16).alias("cache_version"), (F.col("source_size") + F.when(u % 8 == 0, 1).otherwise(0)).alias("source_size"), "source_modified_ns", modes.alias("modes"))


@query("analysis_worklist", """
SELECT t.track_id, m AS mode, c.track_id IS NULL AS include_rhythm FROM v_identity t LEFT JOIN (SELECT c.* FROM v_cached c JOIN v_identity i USING (track_id, source_size, source_modified_ns) WHERE cache_version = 16) c USING (track_id),
  (VALUES ('essential'), ('standard'), ('complete')) v(m) WHERE c.track_id IS NULL OR NOT list_contains(c.modes, m)""")
def analysis_worklist(t):
    return INC.analysis_worklist(identity(t), cached(t))


@query("stem_worklist", """
SELECT track_id FROM v_identity WHERE track_id NOT IN (SELECT track_id FROM v_cached JOIN v_identity USING (track_id, source_size, source_modified_ns) WHERE cache_version = 16)""")
def stem_worklist(t):
    manifests = cached(t).withColumn("model_revision", F.lit("r1"))
    return INC.stem_worklist(identity(t), manifests, 16, "r1").select("track_id")


def merge_inputs(t):
    u = F.col("user_id")
    one = lambda mode, value: F.map_from_arrays(F.array(mode), F.array(value))
    old = identity(t).where("user_id % 3 <> 0").select(
        "track_id", F.lit("m1").alias("model_version"), F.lit("d1").alias("downbeat_model_version"), F.lit(True).alias("has_rhythm"), one(F.lit("standard"), u).alias("modes"))
    mode = F.when(u % 2 == 0, "standard").otherwise("complete")
    new = identity(t).where("user_id % 4 <> 0").select(
        "track_id", F.when(u % 7 == 0, "m2").otherwise("m1").alias("model_version"), F.lit("d1").alias("downbeat_model_version"), (u % 5 == 0).alias("has_rhythm"),
        one(mode, -u).alias("modes"), F.when(u % 11 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return old, new


view("v_merge", """
SELECT *, CASE WHEN have AND new AND user_id % 5 = 0 THEN 'repeated rhythm' WHEN have AND new AND user_id % 7 = 0 THEN 'model version mismatch' WHEN NOT have AND new AND user_id % 5 <> 0 THEN 'rhythm missing' END AS reason
FROM (SELECT track_id, user_id, user_id % 3 <> 0 AS have, user_id % 4 <> 0 AS new FROM v_identity)""")


@query("merge_results", """
SELECT track_id, CASE WHEN have THEN 'm1' WHEN user_id % 7 = 0 THEN 'm2' ELSE 'm1' END AS model_version, have OR user_id % 5 = 0 AS has_rhythm,
  CASE WHEN NOT (new AND reason IS NULL) OR user_id % 11 <> 0 THEN true ELSE false END AS persist,
  CASE WHEN new AND reason IS NULL THEN CASE WHEN user_id % 2 = 0 THEN 'standard:' || (-user_id) WHEN have THEN 'complete:' || (-user_id) || ',standard:' || user_id ELSE 'complete:' || (-user_id) END ELSE 'standard:' || user_id END AS modes
FROM v_merge WHERE have OR (new AND reason IS NULL)""")
def merge_results(t):
    merged, _ = INC.merge_results(*merge_inputs(t))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("modes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return merged.select("track_id", "model_version", "has_rhythm", "persist", shown.alias("modes"))


@query("merge_rejects", "SELECT track_id, reason FROM v_merge WHERE reason IS NOT NULL")
def merge_rejects(t):
    return INC.merge_results(*merge_inputs(t))[1]


@query("tolerant_scan_report", """
SELECT reason, count(*) AS n FROM v_merge WHERE reason IS NOT NULL GROUP BY ALL""")
def tolerant_scan_report(t):
    return Q.tolerant_scan_report(INC.merge_results(*merge_inputs(t))[1])


# -- telemetry ---------------------------------------------------------------


@query("scan_logs", "SELECT event_id, ts_ms, origin, level, message FROM v_logs")
def scan_logs(t):
    return WK.scan_logs(t.logs.drop("ts"))


@query("log_origins", "SELECT origin, level, count(*) AS n FROM v_logs GROUP BY ALL")
def log_origins(t):
    return T.log_origins(WK.scan_logs(t.logs))


@query("filter_logs", "SELECT event_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || ' [' || origin || '] ' || upper(level) || ' ' || message AS line FROM v_logs WHERE level IN ('warn', 'error') AND origin = 'rust'")
def filter_logs(t):
    kept = T.filter_logs(WK.scan_logs(t.logs), "warn", "rust")
    return kept.select("event_id", T.format_logs(kept).alias("line"))


@query("log_ring", "SELECT event_id, ts_ms, level FROM v_logs ORDER BY ts_ms DESC, event_id DESC LIMIT 2000")
def log_ring(t):
    return T.log_ring(WK.scan_logs(t.logs)).select("event_id", "ts_ms", "level")


@query("import_batch_summary", """
SELECT batch_id, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed FROM (SELECT batch_id, job_id, arg_max(state, struct_pack(abs_us, event_id)) AS s FROM v_jobs GROUP BY ALL)
GROUP BY ALL HAVING count(*) = 4 AND count(*) FILTER (s NOT IN ('completed', 'failed')) = 0""")
def import_batch_summary(t):
    return T.import_batch_summary(t.jobs)


@query("resource_pressure", """
SELECT event_id, load, CASE WHEN load >= 85 THEN 'hot' WHEN load >= 65 THEN 'warm' ELSE 'normal' END AS pressure FROM (SELECT event_id, coalesce(greatest(CASE WHEN cpu IS NOT NULL THEN greatest(0, least(100, cpu)) END, CASE WHEN gpu IS NOT NULL THEN greatest(0, least(100, gpu)) END,
  CASE WHEN memory IS NOT NULL THEN greatest(0, least(100, memory)) END), 0)::DOUBLE AS load FROM (SELECT event_id, cpu, gpu, memory FROM v_metrics))""")
def resource_pressure(t):
    load = S.resource_load(F.col("cpu"), F.col("gpu"), F.col("memory"))
    return t.metrics.select("event_id", load.alias("load")).withColumn("pressure", S.pressure(F.col("load")))


@query("level_db", 'SELECT event_id, round(greatest(-60, 20 * log10(greatest("left", 1e-3))), 6) AS db FROM v_levels')
def level_db(t):
    return t.levels.select("event_id", F.round(S.level_db(F.col("left")), 6).alias("db"))


def _points(t):
    return t.levels.select("track_id", F.col("event_id").alias("point_id"), "ts_ms")


def _energy_sql(ms: int) -> str:
    return f"""
SELECT p.track_id, p.event_id AS point_id, max(l."left") AS max_left, max(l."right") AS max_right, round(avg(l."left"), 9) AS avg_left, round(avg(l."right"), 9) AS avg_right, count(*) AS n
FROM v_levels p JOIN v_levels l ON l.track_id = p.track_id AND l.ts_ms BETWEEN p.ts_ms - {ms} AND p.ts_ms GROUP BY ALL"""


def _energy(t, ms: int):
    return T.energy_history(t.levels, _points(t), ms).select("track_id", "point_id", "max_left", "max_right", F.round("avg_left", 9).alias("avg_left"), F.round("avg_right", 9).alias("avg_right"), "n")


@query("energy_history", _energy_sql(15_000))
def energy_history(t):
    return _energy(t, 15_000)


@query("energy_history_5s", _energy_sql(5_000))
def energy_history_5s(t):
    return _energy(t, 5_000)


@query("energy_history_30s", _energy_sql(30_000))
def energy_history_30s(t):
    return _energy(t, 30_000)


@query("meter_history", """
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts_ms, event_id) AS i FROM v_levels),
w AS (SELECT track_id, i, event_id, ts_ms, "left" AS level, "left" AS peak, ts_ms AS held FROM o WHERE i = 1
  UNION ALL SELECT track_id, i, event_id, ts_ms, level, CASE WHEN level >= pk THEN level WHEN ts_ms - held <= 1000 THEN pk ELSE greatest(level, pk - dt * 8e-4) END,
    CASE WHEN level >= pk THEN ts_ms WHEN ts_ms - held <= 1000 THEN held WHEN greatest(level, pk - dt * 8e-4) = level THEN ts_ms ELSE held END
  FROM (SELECT o.track_id, o.i, o.event_id, o.ts_ms, w.peak AS pk, w.held, CASE WHEN w.ts_ms > 0 THEN least(250, greatest(0, o.ts_ms - w.ts_ms)) ELSE 0 END AS dt,
    CASE WHEN o."left" >= w.level THEN o."left" ELSE w.level + (o."left" - w.level) * CASE WHEN w.ts_ms > 0 AND o.ts_ms > w.ts_ms THEN 1 - exp(-least(250, o.ts_ms - w.ts_ms) / 105e0) ELSE 1 END END AS level
    FROM w JOIN o ON o.track_id = w.track_id AND o.i = w.i + 1))
SELECT track_id, event_id, round(level, 6) AS level, round(peak, 6) AS held_peak FROM w""")
def meter_history(t):
    return T.meter_history(t.levels).select("track_id", "event_id", r6("level"), r6("held_peak"))


def eta_ms():
    """Milliseconds, cut where no reading falls on the edge, so both engines agree on the last digit."""
    return F.floor(F.col("remaining_s") * 1000 + 0.37).alias("remaining_ms")


_ETA_SQL = """
WITH RECURSIVE base AS MATERIALIZED (SELECT job_id, ts_ms, seq, profile, greatest(1, duration_s) AS d, stage, completed, total, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS i FROM v_progress),
o AS MATERIALIZED (SELECT *, CASE stage WHEN 'checkingCache' THEN 2 WHEN 'loadingModel' THEN lm WHEN 'loadingAudio' THEN la WHEN 'separating' THEN sp WHEN 'writingStems' THEN wr WHEN 'validatingStems' THEN va ELSE ca END AS cur,
    CASE stage WHEN 'checkingCache' THEN lm + la + sp + wr + va + ca WHEN 'loadingModel' THEN la + sp + wr + va + ca WHEN 'loadingAudio' THEN sp + wr + va + ca WHEN 'separating' THEN wr + va + ca WHEN 'writingStems' THEN va + ca WHEN 'validatingStems' THEN ca ELSE 0 END AS later,
    2 + lm + la + sp + wr + va + ca AS whole
  FROM (SELECT *, CASE profile WHEN 'hq' THEN 14 ELSE 9 END AS lm, greatest(2, d * 15e-3) AS la, CASE profile WHEN 'hq' THEN greatest(75, d * 15e-1) ELSE greatest(28, d * 35e-2) END AS sp, greatest(3, d * 25e-3) AS wr, greatest(3, d * 2e-2) AS va, greatest(2, d * 15e-3) AS ca FROM base)),
w AS (SELECT job_id, 0::BIGINT AS i, NULL::BIGINT AS seq, 'checkingCache' AS stage, ts_ms AS began, 0::BIGINT AS first_n, NULL::DOUBLE AS pace, whole::DOUBLE AS remaining, ts_ms AS seen FROM o WHERE i = 1
  UNION ALL SELECT job_id, i, seq, stage, CASE WHEN same THEN began ELSE ts_ms END, CASE WHEN same THEN first_n ELSE coalesce(completed, 0) END, CASE WHEN same THEN np END,
    CASE WHEN NOT same THEN cur + later ELSE least(7200, greatest(0, CASE WHEN np IS NULL THEN raw ELSE greatest(0, remaining - (ts_ms - seen) / 1e3) * 35e-2 + raw * 65e-2 END)) END, ts_ms
  FROM (SELECT *, CASE WHEN np IS NOT NULL AND total IS NOT NULL AND completed IS NOT NULL THEN np * greatest(0, total - completed) ELSE greatest(0, cur - elapsed) END + later AS raw FROM (
    SELECT *, CASE WHEN total IS NOT NULL AND completed IS NOT NULL AND completed - first_n > 0 AND elapsed >= 5e-1 THEN CASE WHEN pace IS NULL THEN elapsed / (completed - first_n) ELSE pace * 65e-2 + elapsed / (completed - first_n) * 35e-2 END ELSE pace END AS np
    FROM (SELECT o.*, w.began, w.first_n, w.pace, w.remaining, w.seen, o.stage = w.stage AS same, greatest(0, (o.ts_ms - w.began) / 1e3) AS elapsed FROM w JOIN o ON o.job_id = w.job_id AND o.i = w.i + 1)))
  )"""


@query("stem_eta", f"""{_ETA_SQL}
SELECT job_id, seq, floor(remaining * 1000 + 37e-2)::BIGINT AS remaining_ms, greatest(1, floor(remaining + 5e-1))::INT AS shown_s FROM w WHERE i > 0""")
def stem_eta(t):
    return T.stem_eta(t.progress).select("job_id", "seq", eta_ms(), "shown_s")


@query("remaining_shown", f"""{_ETA_SQL},
looks AS (SELECT job_id, ts_ms + CASE WHEN seq % 7 = 3 THEN -5 ELSE seq * 37 END AS at, seq AS look_id, CASE WHEN seq % 10 = 9 THEN 999e-3 ELSE 5e-1 END AS progress FROM v_progress)
SELECT l.job_id, l.look_id, coalesce(CASE WHEN w.remaining IS NOT NULL AND l.progress < 999e-3 THEN greatest(1, floor(floor(w.remaining * 1000 + 37e-2) / 1000 - (l.at - w.seen) / 1e3 + 5e-1)) END, -1)::INT AS shown_s
FROM looks l ASOF LEFT JOIN (SELECT job_id, seen, arg_max(remaining, i) AS remaining FROM w WHERE i > 0 GROUP BY ALL) w ON w.job_id = l.job_id AND l.at >= w.seen""")
def remaining_shown(t):
    """Looks between the reports, before the first of a job and at its end."""
    known = T.stem_eta(t.progress).join(t.progress.select("job_id", "seq", "ts_ms"), ["job_id", "seq"]).withColumn("remaining_s", eta_ms() / 1000)
    at = F.col("ts_ms") + F.when(F.col("seq") % 7 == 3, -5).otherwise(F.col("seq") * 37)
    looks = t.progress.select("job_id", at.alias("ts_ms"), F.col("seq").alias("look_id"), F.when(F.col("seq") % 10 == 9, 0.999).otherwise(0.5).alias("progress"))
    return T.remaining_shown(known, looks).withColumn("shown_s", F.coalesce("shown_s", F.lit(-1)))


@query("progress_sanity", "SELECT job_id, seq, CASE WHEN total IS NOT NULL AND completed <= total THEN completed ELSE -1 END AS completed, coalesce(total, -1)::BIGINT AS total FROM v_progress")
def progress_sanity(t):
    return T.progress_sanity(t.progress).select("job_id", "seq", F.coalesce("completed", F.lit(-1)).alias("completed"), F.coalesce("total", F.lit(-1)).alias("total"))
