"""Registered queries over chord timelines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stave.functions import music, sql_names
from stave.functions import vocabulary as V
from stave.operators import chords as C
from stave.operators.catalog import manifest_summary
from stave.plans.bindings import Tables
from stave.plans.registry import query, sql_case, view


def r6(name: str, out: str | None = None):
    return F.round(F.col(name), 6).alias(out or name)


_ROOT = "split_part(source_label, ':', 1)"
_QUALITY = "split_part(split_part(source_label, ':', 2), '/', 1)"
_DEGREE = "split_part(source_label, '/', 2)"


def _names(expr: str, flat: str) -> str:
    lists = {"s": str(V.SHARP_NAMES), "f": str(V.FLAT_NAMES)}
    return f"(CASE WHEN {flat} THEN {lists['f']} ELSE {lists['s']} END)[{expr} + 1]"


COMPACT_SQL = f"""CASE WHEN source_label IN ('N','X') THEN 'N' ELSE {_ROOT} || {sql_case(_QUALITY, V.COMPACT_QUALITY, _QUALITY)}
  || CASE WHEN contains(source_label, '/') THEN '/' || {_names(f"(({sql_case(_ROOT, V.WORKER_PITCH)}) + ({sql_case(_DEGREE, V.BASS_SEMITONES)})) % 12", f"contains({_ROOT}, 'b')")} ELSE '' END END"""

view("v_compact", f"SELECT *, {COMPACT_SQL} AS label FROM v_chords")
view("v_trimmed", """
SELECT * EXCLUDE (end_s, nxt), CASE WHEN end_s - nxt > 0 AND end_s - nxt <= 1e-3 + 1e-9 THEN nxt ELSE end_s END AS end_s
FROM (SELECT *, lead(start_s) OVER (PARTITION BY track_id ORDER BY start_s, idx) AS nxt FROM v_compact)""")
view("v_edited", """
SELECT c.* EXCLUDE (label), coalesce(e.label, c.label) AS label, e.label IS NOT NULL AS edited
FROM v_compact c LEFT JOIN (SELECT track_id, mode, start_s, end_s, arg_max(label, edit_seq) AS label FROM v_edits GROUP BY ALL) e
  USING (track_id, mode, start_s, end_s)""")

_TRANSPOSE = r"'^([A-G](?:#|b)?)([^/]*)(?:/([A-G](?:#|b)?))?$'"


def transposed_sql(expr: str, shift: str, flat: str = "false") -> str:
    pitch = {**V.EXPORT_PITCH, "Cb": 11, "Fb": 4, "E#": 5, "B#": 0}
    part = lambda n: f"regexp_extract({expr}, {_TRANSPOSE}, {n})"
    move = lambda n: _names(f"((({sql_case(part(n), pitch)}) + ({shift}) + 120) % 12)", flat)
    return f"""CASE WHEN {expr} IN ('N','-') OR NOT regexp_matches({expr}, {_TRANSPOSE}) THEN {expr}
  ELSE {move(1)} || {part(2)} || CASE WHEN {part(3)} <> '' THEN '/' || {move(3)} ELSE '' END END"""


def compact(t: Tables):
    return C.with_compact_labels(t.chords)


def trimmed(t: Tables):
    return C.segment_boundaries(compact(t))


@query("chord_statistics", """
SELECT track_id, label, round(d, 6) AS duration_s, n AS occurrences, s AS strength, round(d / sum(d) OVER (PARTITION BY track_id), 6) AS share
FROM (SELECT track_id, label, sum(end_s - start_s) AS d, count(*) AS n, max(strength) AS s FROM v_trimmed
  WHERE label NOT IN ('N','-') AND end_s - start_s > 0 GROUP BY ALL)""")
def chord_statistics(t):
    stats = C.chord_statistics(trimmed(t))
    return stats.select("track_id", "label", r6("duration_s"), "occurrences", "strength", r6("share"))


@query("segment_boundaries", "SELECT track_id, idx, start_s, end_s FROM v_trimmed")
def segment_boundaries(t):
    return C.segment_boundaries(t.chords).select("track_id", "idx", "start_s", "end_s")


@query("harte_to_compact", "SELECT DISTINCT source_label, label FROM v_compact")
def harte_to_compact(t):
    return compact(t).select("source_label", "label").distinct()


@query("triad_reduce", f"""
SELECT DISTINCT source_label, CASE WHEN source_label = 'N' THEN 'N' WHEN {_QUALITY} LIKE 'min%' THEN 'Minor' ELSE 'Major' END AS family,
  CASE WHEN source_label = 'N' THEN 'N' WHEN {_QUALITY} LIKE 'min%' THEN {_ROOT} || 'm' ELSE {_ROOT} END AS triad FROM v_chords""")
def triad_reduce(t):
    label = F.col("source_label")
    return t.chords.select("source_label", music.triad_family(label).alias("family"), music.triad_label(label).alias("triad")).distinct()


@query("compact_to_harte", f"""
SELECT DISTINCT label, CASE WHEN label = 'N' THEN 'N' ELSE r || ':' || {sql_case('q', V.HARTE_QUALITY, 'q')} || CASE WHEN b <> ''
  THEN '/' || {V.INTERVAL_NAMES}[(({sql_case('b', V.EXPORT_PITCH)}) - ({sql_case('r', V.EXPORT_PITCH)}) + 12) % 12 + 1] ELSE '' END END AS harte
FROM (SELECT label, regexp_extract(label, {_TRANSPOSE}, 1) AS r, regexp_extract(label, {_TRANSPOSE}, 2) AS q, regexp_extract(label, {_TRANSPOSE}, 3) AS b FROM v_compact)""")
def compact_to_harte(t):
    return compact(t).select("label", music.compact_to_harte(F.col("label")).alias("harte")).distinct()


@query("transpose_labels", f"""
SELECT track_id, idx, {transposed_sql('label', 'event_id % 25 - 12', 'event_id % 2 = 0')} AS shown FROM v_compact""")
def transpose_labels(t):
    shift = F.col("event_id") % 25 - 12
    return compact(t).select("track_id", "idx", music.transpose(F.col("label"), shift, F.col("event_id") % 2 == 0).alias("shown"))


@query("chord_pitch_sets", f"""
SELECT label, root, bass, array_to_string(CASE WHEN b <> '' AND NOT list_contains(ps, bass) THEN list_concat([bass], ps) ELSE ps END, ',') AS pitches,
  list_aggregate(list_transform(list_distinct(list_concat([bass], ps)), lambda p: 1 << p), 'sum')::INT AS mask
FROM (SELECT *, coalesce({sql_case('b', V.EXPORT_PITCH)}, root) AS bass, list_transform(st, lambda s: (root + s) % 12) AS ps
  FROM (SELECT DISTINCT label, regexp_extract(label, {_TRANSPOSE}, 3) AS b, {sql_case(f"regexp_extract(label, {_TRANSPOSE}, 1)", V.EXPORT_PITCH)} AS root,
    CASE regexp_extract(label, {_TRANSPOSE}, 2) WHEN '' THEN [0, 4, 7] WHEN 'm' THEN [0, 3, 7] WHEN '7' THEN [0, 4, 7, 10] WHEN 'm7' THEN [0, 3, 7, 10] END AS st
    FROM v_compact WHERE label <> 'N'))""")
def chord_pitch_sets(t):
    # labels repeat over a catalogue, so each is parsed once
    labels = music.with_pitch_sets(compact(t).select("label").distinct()).where(F.col("chord").isNotNull())
    pitches = F.array_join(F.transform("chord.pitches", lambda p: p.cast("string")), ",")
    return labels.select("label", "chord.root", "chord.bass", pitches.alias("pitches"), "chord.mask")


@query("normalize_label_entry", f"""
SELECT DISTINCT typed, CASE WHEN typed = 'n' THEN 'N' ELSE {transposed_sql('label', '0')} END AS entry
FROM (SELECT label, lower(substr(label, 1, 1)) || replace(substr(label, 2), '#', '♯') AS typed FROM v_compact)""")
def normalize_label_entry(t):
    typed = F.concat(F.lower(F.substring("label", 1, 1)), F.replace(F.substring(F.col("label"), F.lit(2), F.lit(99)), F.lit("#"), F.lit("♯")))
    return compact(t).select(typed.alias("typed")).distinct().transform(music.with_valid_entries, "typed")


@query("chord_repertoire", "SELECT DISTINCT track_id, label FROM v_compact WHERE label NOT IN ('N','-')")
def chord_repertoire(t):
    return C.chord_repertoire(compact(t))


@query("score_band", """
SELECT track_id, idx, CASE WHEN label = 'N' THEN -1 ELSE least(9, floor(greatest(0, least(1, strength)) * 10))::INT END AS band FROM v_compact""")
def score_band(t):
    return C.score_bands(compact(t)).select("track_id", "idx", F.coalesce("band", F.lit(-1)).alias("band"))


@query("apply_chord_edits", "SELECT track_id, idx, label, edited FROM v_edited")
def apply_chord_edits(t):
    return C.apply_chord_edits(compact(t), t.edits).select("track_id", "idx", "label", "edited")


@query("visible_chords", "SELECT track_id, idx, label FROM v_edited WHERE edited OR strength >= 5e-1")
def visible_chords(t):
    return C.visible_chords(C.apply_chord_edits(compact(t), t.edits), 0.5).select("track_id", "idx", "label")


@query("active_chord_asof", """
SELECT track_id, query_id, CASE WHEN t_s + 1e-2 < h.end_s THEN h.idx ELSE -1 END AS idx, CASE WHEN t_s + 1e-2 < h.end_s THEN h.label END AS label
FROM (SELECT p.track_id, query_id, t_s, arg_max(struct_pack(idx, label, end_s), idx) AS h FROM v_positions p
  LEFT JOIN v_compact c ON c.track_id = p.track_id AND c.start_s <= p.t_s + 1e-2 GROUP BY ALL)""")
def active_chord_asof(t):
    return C.active_chord(t.positions, compact(t)).select("track_id", "query_id", F.coalesce("idx", F.lit(-1)).alias("idx"), "label")


@query("adjacent_chord", """
WITH c AS (SELECT track_id, idx, start_s, end_s, lag(start_s) OVER w AS p, lead(start_s) OVER w AS n FROM v_compact WINDOW w AS (PARTITION BY track_id ORDER BY start_s, idx)),
held AS (SELECT q.track_id, query_id, t_s, arg_max(struct_pack(s := start_s, p := p, n := n), idx) AS h FROM v_positions q
  JOIN c ON c.track_id = q.track_id AND t_s >= start_s - 1e-2 AND t_s < end_s GROUP BY ALL)
SELECT track_id, query_id, coalesce(h.p, h.s) AS prev_s, coalesce(h.n, h.s) AS next_s FROM held
UNION ALL
SELECT q.track_id, query_id, coalesce((SELECT max(start_s) FROM c WHERE c.track_id = q.track_id AND start_s < t_s - 1e-2), t_s),
  coalesce((SELECT min(start_s) FROM c WHERE c.track_id = q.track_id AND start_s > t_s + 1e-2), t_s)
FROM v_positions q WHERE query_id NOT IN (SELECT query_id FROM held)""")
def adjacent_chord(t):
    return C.adjacent_chord(t.positions, t.chords).select("track_id", "query_id", "prev_s", "next_s")


@query("chord_beat_counts", """
WITH b AS (SELECT track_id, beat_s, row_number() OVER w - 1 AS n, beat_s - lag(beat_s) OVER w AS step
  FROM (SELECT DISTINCT track_id, beat_s FROM v_grid) WINDOW w AS (PARTITION BY track_id ORDER BY beat_s)),
edge AS (SELECT track_id, idx, start_s, start_s AS t, 0 AS side FROM v_chords WHERE end_s > start_s
  UNION ALL SELECT track_id, idx, start_s, end_s, 1 FROM v_chords WHERE end_s > start_s),
near AS (SELECT e.track_id, idx, e.start_s, t, side, max(b.n) FILTER (b.beat_s < t) AS bn, max(b.beat_s) FILTER (b.beat_s < t) AS bt,
  arg_max(b.step, b.beat_s) FILTER (b.beat_s < t) AS bstep, min(b.n) FILTER (b.beat_s >= t) AS fn, min(b.beat_s) FILTER (b.beat_s >= t) AS ft
  FROM edge e JOIN b USING (track_id) GROUP BY ALL),
place AS (SELECT track_id, idx, start_s, side, CASE WHEN bn IS NULL THEN 0 WHEN fn IS NOT NULL THEN CASE WHEN t - bt < ft - t THEN bn ELSE fn END
  WHEN bstep IS NULL THEN CASE WHEN t > bt THEN bn + 1 ELSE 0 END WHEN t - bt < bt + bstep - t THEN bn ELSE bn + 1 END AS i FROM near),
span AS (SELECT track_id, idx, start_s, min(i) FILTER (side = 0) AS a, min(i) FILTER (side = 1) AS z FROM place GROUP BY ALL),
own AS (SELECT s.track_id, b.n, arg_max(idx, struct_pack(start_s, idx)) AS idx FROM span s JOIN b ON b.track_id = s.track_id AND b.n >= a AND b.n < z GROUP BY ALL)
SELECT c.track_id, c.idx, coalesce(k, 0) AS beat_count FROM v_chords c LEFT JOIN (SELECT track_id, idx, count(*) AS k FROM own GROUP BY ALL) USING (track_id, idx)""")
def chord_beat_counts(t):
    return C.chord_beat_counts(t.chords, t.grid)


@query("materialize_regions", """
WITH RECURSIVE b AS (SELECT track_id, idx, label, start_s, least(end_s, duration_s) AS end_s,
  row_number() OVER (PARTITION BY track_id ORDER BY start_s, idx) AS i FROM v_compact JOIN (SELECT track_id, duration_s FROM v_tracks) USING (track_id)),
walk AS (SELECT track_id, 0::BIGINT AS i, 0::DOUBLE AS pos, NULL::BIGINT AS idx, NULL::VARCHAR AS label, NULL::DOUBLE AS start_s, NULL::DOUBLE AS end_s FROM b WHERE i = 1
  UNION ALL SELECT b.track_id, b.i, CASE WHEN b.end_s - greatest(pos, b.start_s) >= 5e-2 THEN b.end_s ELSE pos END,
  CASE WHEN b.end_s - greatest(pos, b.start_s) >= 5e-2 THEN b.idx END, b.label, greatest(pos, b.start_s), b.end_s
  FROM walk w JOIN b ON b.track_id = w.track_id AND b.i = w.i + 1)
SELECT track_id, idx, label, start_s, end_s FROM walk WHERE idx IS NOT NULL""")
def materialize_regions(t):
    return C.materialize_regions(compact(t), t.tracks)


def _requests(t):
    base = compact(t).groupBy("track_id", "mode").agg(F.min_by(F.struct("start_s", "end_s", "event_id"), F.struct("start_s", "idx")).alias("c"))
    return base.select(
        "track_id", "mode", "c.start_s", "c.end_s", F.lit("Gb").alias("replacement"), (F.col("c.event_id") % 2 == 0).alias("replace_all")
    )


@query("edits_upsert", f"""
WITH req AS (SELECT track_id, arg_min(start_s, idx) AS s, arg_min(end_s, idx) AS e, arg_min(event_id, idx) % 2 = 0 AS every FROM v_compact GROUP BY ALL),
eff AS (SELECT *, {transposed_sql('label', '0')} AS canon FROM v_edited),
want AS (SELECT req.*, canon AS wanted FROM req JOIN eff ON eff.track_id = req.track_id AND start_s = s AND end_s = e),
hit AS (SELECT DISTINCT eff.track_id, start_s, end_s FROM eff JOIN want USING (track_id) WHERE CASE WHEN every THEN canon = wanted ELSE start_s = s AND end_s = e END)
SELECT track_id, mode, start_s, end_s, label FROM v_edits ANTI JOIN hit USING (track_id, start_s, end_s)
UNION ALL SELECT track_id, mode, start_s, end_s, 'Gb' FROM v_compact SEMI JOIN hit USING (track_id, start_s, end_s) WHERE {transposed_sql('label', '0')} <> 'F#'""")
def edits_upsert(t):
    return C.edits_upsert(compact(t), t.edits, _requests(t))


def _frames(t):
    """Per-frame class probabilities: one vector for each half second of a track in which a chord starts."""
    at = F.rint(F.col("start_s") / 0.5).cast("bigint")
    seeds = t.chords.groupBy("track_id", at.alias("frame")).agg(F.min("idx").alias("seed"))
    return seeds.select("track_id", "frame", F.transform(F.sequence(F.lit(0), F.lit(72)), lambda i: (i * 7 + F.col("seed")) % 73 / 73.0).alias("probs"))


@query("segment_frame_scores", """
WITH fr AS (SELECT track_id, round_even(start_s / 5e-1, 0)::BIGINT AS frame, min(idx) AS seed FROM v_chords GROUP BY ALL),
seg AS (SELECT track_id, idx, greatest(0, round_even(start_s / 5e-1, 0))::BIGINT AS f, round_even(end_s / 5e-1, 0)::BIGINT AS l,
  CASE WHEN source_label = 'N' THEN 0 ELSE CASE WHEN contains(source_label, ':min') THEN 13 ELSE 1 END + """
       + f"({sql_case(_ROOT, V.WORKER_PITCH)})" + """ END AS k FROM v_chords)
SELECT seg.track_id, seg.idx, round(avg((k * 7 + seed) % 73 / 73e0), 6) AS score
FROM seg LEFT JOIN fr ON fr.track_id = seg.track_id AND frame >= f AND frame < greatest(f + 1, l) GROUP BY ALL""")
def segment_frame_scores(t):
    return C.segment_frame_scores(t.chords, _frames(t), 0.5).select("track_id", "idx", r6("score"))


@query("ensemble_mean", """
SELECT track_id, frame, class, round(avg(p), 6) AS p FROM (SELECT track_id, block_no // 4 AS frame, i AS class, abs(samples[i + 1]::DOUBLE) AS p FROM v_blocks, range(64) t(i)) GROUP BY ALL""")
def ensemble_mean(t):
    from stave.operators.signal import ensemble_mean as mean

    members = t.blocks.select(
        "track_id", F.floor(F.col("block_no") / 4).alias("frame"), (F.col("block_no") % 4).alias("member"),
        F.transform("samples", lambda x: F.abs(x.cast("double"))).alias("probs"),
    )
    return mean(members).select("track_id", "frame", "class", r6("p"))


@query("manifest_summary", """
SELECT project_id, count(*) AS track_count, round(sum(duration_s), 6) AS total_duration_s, sum(file_size_bytes)::BIGINT AS total_bytes, count(duration_s) AS with_duration FROM v_tracks GROUP BY ALL""")
def manifest_summary_query(t):
    return manifest_summary(t.tracks).select("project_id", "track_count", r6("total_duration_s"), "total_bytes", "with_duration")


def in_sql(t, rows, text: str):
    """A query in SQL text over a view of the rows, with the catalogue's function names."""
    sql_names.register(t.spark)
    name = f"v_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    return t.spark.sql(text.format(rows=name))


@query("sql_harte_to_compact", same_as="harte_to_compact")
def sql_harte_to_compact(t):
    return in_sql(t, t.chords, "SELECT DISTINCT source_label, harte_to_compact(source_label) AS label FROM {rows}")


@query("sql_triad_reduce", same_as="triad_reduce")
def sql_triad_reduce(t):
    return in_sql(t, t.chords, "SELECT DISTINCT source_label, triad_family(source_label) AS family, triad_label(source_label) AS triad FROM {rows}")


@query("sql_compact_to_harte", same_as="compact_to_harte")
def sql_compact_to_harte(t):
    return in_sql(t, compact(t), "SELECT DISTINCT label, compact_to_harte(label) AS harte FROM {rows}")


@query("sql_transpose_labels", same_as="transpose_labels")
def sql_transpose_labels(t):
    return in_sql(t, compact(t), "SELECT track_id, idx, transpose_label(label, event_id % 25 - 12, event_id % 2 = 0) AS shown FROM {rows}")
