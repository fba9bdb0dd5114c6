"""Registered queries over sample blocks, stems, fingerprints and manifests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stave.functions import scalars as S
from stave.operators import fingerprints as FP
from stave.operators import inference as NN
from stave.operators import signal as G
from stave.operators import spectrum as SP
from stave.operators import telemetry as T
from stave.plans.chord_queries import r6
from stave.plans.registry import query, view
from stave.sinks import tables as TB
from stave.sources import manifests as MF
from stave.sources import wav as WV

RATE, BLOCK = 4000, 64


def r6_array(name: str):
    """An array as text of values rounded to six digits, in whole millionths."""
    return F.array_join(F.transform(name, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",").alias(name)


view("v_frames", "SELECT track_id, count(*) AS frames FROM v_samples WHERE channel = 0 GROUP BY ALL")


@query("decoded_stats", "SELECT track_id, frames, 2::BIGINT AS channels, 4000 AS sample_rate, frames / 4e3 AS duration_s FROM v_frames")
def decoded_stats(t):
    return G.decoded_stats(t.stereo)


view("v_peaks", """
SELECT track_id, frame // per AS bucket, least(1, min(x)) AS "min", greatest(-1, max(x)) AS "max" FROM v_samples JOIN (SELECT track_id, greatest(1, ceil(frames / 100))::BIGINT AS per FROM v_frames) USING (track_id) GROUP BY ALL""")


@query("waveform_peaks", 'SELECT track_id, bucket, round("min", 6) AS "min", round("max", 6) AS "max" FROM v_peaks')
def waveform_peaks(t):
    return G.waveform_peaks(t.stereo, 100).select("track_id", "bucket", F.round(F.col("min").cast("double"), 6).alias("min"), F.round(F.col("max").cast("double"), 6).alias("max"))


@query("visible_peaks", """
SELECT track_id, (bucket - f) // g AS group_no, round(min("min"), 6) AS "min", round(max("max"), 6) AS "max" FROM v_peaks JOIN (
  SELECT track_id, f, e, greatest(1, ceil((e - f) / 10))::BIGINT AS g FROM (SELECT track_id, floor(3e-1 * n)::BIGINT AS f, least(n, floor(3e-1 * n)::BIGINT + greatest(1, ceil(n / 2e0))::BIGINT) AS e FROM (SELECT track_id, count(*) AS n FROM v_peaks GROUP BY ALL)))
USING (track_id) WHERE bucket >= f AND bucket < e GROUP BY ALL""")
def visible_peaks(t):
    peaks = G.waveform_peaks(t.stereo, 100)
    return G.visible_peaks(peaks, 2.0, 0.3, 10).select("track_id", "group_no", F.round(F.col("min").cast("double"), 6).alias("min"), F.round(F.col("max").cast("double"), 6).alias("max"))


@query("peak_pyramid", """
SELECT track_id, l::INT AS level, bucket // (4 ** l)::BIGINT AS bucket, round(min("min"), 6) AS "min", round(max("max"), 6) AS "max" FROM v_peaks, range(3) g(l) GROUP BY ALL""")
def peak_pyramid(t):
    made = G.peak_pyramid(G.waveform_peaks(t.stereo, 100), levels=3, factor=4)
    return made.select("track_id", "level", "bucket", F.round(F.col("min").cast("double"), 6).alias("min"), F.round(F.col("max").cast("double"), 6).alias("max"))


@query("true_peak", """
WITH q AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS c, lead(x, 2) OVER w AS d FROM v_samples WINDOW w AS (PARTITION BY track_id, channel ORDER BY frame))
SELECT track_id, round(max(greatest(abs(x), coalesce(v, 0))), 6) AS true_peak FROM (SELECT track_id, x, CASE WHEN a IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL
  THEN abs(5e-1 * (2 * x + (c - a) * s + (2 * a - 5 * x + 4 * c - d) * s * s + (3 * x - a - 3 * c + d) * s * s * s)) END AS v FROM q, (VALUES (25e-2), (5e-1), (75e-2)) g(s)) GROUP BY ALL""")
def true_peak(t):
    return G.true_peak(t.stereo).select("track_id", r6("true_peak"))


def _filter_sql() -> str:
    """The two filters as a frame-by-frame recursion over all tracks and channels at once."""
    (b, a), (c, d) = G.k_filters(RATE)
    lit = lambda v: f"({float(v)!r}::DOUBLE)"
    return f"""
    k AS (SELECT track_id, channel, frame, x, 0e0 AS x1, 0e0 AS x2, {lit(b[0])} * x AS y, 0e0 AS y1, {lit(c[0])} * {lit(b[0])} * x AS z, 0e0 AS z1 FROM v_samples WHERE frame = 0
      UNION ALL SELECT track_id, channel, frame, x, x1, x2, y, y1, {lit(c[0])} * y + {lit(c[1])} * y1 + {lit(c[2])} * y2 - {lit(d[1])} * z1 - {lit(d[2])} * z2, z1
      FROM (SELECT s.track_id, s.channel, s.frame, s.x, k.x AS x1, k.x1 AS x2, {lit(b[0])} * s.x + {lit(b[1])} * k.x + {lit(b[2])} * k.x1 - {lit(a[1])} * k.y - {lit(a[2])} * k.y1 AS y, k.y AS y1, k.y1 AS y2, k.z AS z1, k.z1 AS z2
        FROM k JOIN s ON s.track_id = k.track_id AND s.channel = k.channel AND s.frame = k.frame + 1))"""


_K = f"WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM v_samples), {_filter_sql().replace('FROM v_samples WHERE', 'FROM s WHERE')}"
_E = """,
    e AS (SELECT track_id, w AS window_no, sum(z * z) / 1600 AS energy FROM (SELECT *, unnest(range(greatest(0, floor((frame - 1600) / 400e0)::BIGINT + 1), frame // 400 + 1)) AS w FROM k) JOIN v_frames USING (track_id) WHERE w * 400 + 1600 <= frames GROUP BY ALL)"""


@query("k_weight", f"{_K} SELECT track_id, channel, frame // 64 AS block_no, round(sum(z * z), 6) AS energy FROM k GROUP BY ALL")
def k_weight(t):
    energy = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x * x)
    return G.k_weight(t.stereo, BLOCK).select("track_id", "channel", "block_no", F.round(energy, 6).alias("energy"))


def energies(t):
    return G.block_energies(t.stereo, BLOCK)


@query("block_energies", f"{_K}{_E} SELECT track_id, window_no, round(energy, 6) AS energy FROM e")
def block_energies(t):
    return energies(t).select("track_id", "window_no", r6("energy"))


_L = """,
    g AS (SELECT track_id, pow(10, (-691e-3 + 10 * log10(avg(energy)) - 10 + 691e-3) / 10) AS gate FROM e WHERE energy >= pow(10, (-70 + 691e-3) / 10) GROUP BY ALL),
    l AS (SELECT track_id, -691e-3 + 10 * log10(avg(energy)) AS lufs FROM e JOIN g USING (track_id) WHERE energy >= pow(10, (-70 + 691e-3) / 10) AND energy >= gate GROUP BY ALL)"""


@query("gated_loudness", f"{_K}{_E}{_L} SELECT track_id, round(lufs, 6) AS lufs FROM l")
def gated_loudness(t):
    return G.gated_loudness(energies(t)).select("track_id", r6("lufs"))


@query("normalization_gain", """
SELECT event_id, round(CASE WHEN value > 1 THEN least(pow(10, (-16 - (value / 10 - 40)) / 20), pow(10, -1 / 20e0) / ((value - 1) / 400)) ELSE 1 END, 6) AS gain FROM v_ev""")
def normalization_gain(t):
    return t.events.select("event_id", F.round(S.normalization_gain(F.col("value") / 10 - 40, (F.col("value") - 1) / 400), 6).alias("gain"))


view("v_mono", "SELECT track_id, frame, avg(x) AS x FROM v_samples GROUP BY ALL")


@query("mixdown_mono", "SELECT track_id, frame // 64 AS block_no, string_agg(round(x * 1e6)::BIGINT, ',' ORDER BY frame) AS samples FROM v_mono GROUP BY ALL")
def mixdown_mono(t):
    return G.mixdown_mono(t.stereo).select("track_id", "block_no", r6_array("samples"))


@query("mix_stats", "SELECT track_id, round(avg(x), 6) AS mean, round(stddev_pop(x) + 1e-8, 6) AS std FROM v_mono GROUP BY ALL")
def mix_stats(t):
    return G.mix_stats(G.mixdown_mono(t.stereo)).select("track_id", r6("mean"), r6("std"))


def _positions(t):
    """A frame around every fifth of a block, beyond both ends included."""
    return t.blocks.select("track_id", F.col("block_no").alias("frame_no"), (F.col("first_frame") + F.col("block_no") % 64).alias("position"))


def _frames(t):
    return SP.hann_frames(G.mixdown_mono(t.stereo), _positions(t), BLOCK, 64)


view("v_windowed", """
SELECT p.track_id, frame_no, i, x * (5e-1 - 5e-1 * cos(2 * pi() * i / 63)) AS v FROM (SELECT track_id, block_no AS frame_no, greatest(0, block_no * 64 + block_no % 64 - 32) AS start FROM v_blocks) p, range(64) g(i)
JOIN v_frames f ON f.track_id = p.track_id JOIN v_mono m ON m.track_id = p.track_id AND m.frame = least(start + i, frames - 1)""")


@query("hann_frames", "SELECT track_id, frame_no, round(sum(v), 6) AS total, round(sum(v * i), 6) AS moment FROM v_windowed GROUP BY ALL")
def hann_frames(t):
    rows = _frames(t).select("track_id", "frame_no", F.posexplode("windowed").alias("i", "v"))
    return rows.groupBy("track_id", "frame_no").agg(F.round(F.sum("v"), 6).alias("total"), F.round(F.sum(F.col("v") * F.col("i")), 6).alias("moment"))


_EDGES = ", ".join(f"({band}, {a}, {z})" for band, (a, z) in enumerate(SP.band_edges(RATE, 64, 16)))
view("v_bands", f"""
SELECT track_id, frame_no, band, greatest(0, least(1, (20 * log10(greatest(max(m), 1e-6)) + 72) / 72)) AS level FROM (VALUES {_EDGES}) e(band, a, z) JOIN (
  SELECT track_id, frame_no, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) / 64 AS m FROM v_windowed, range(33) h(k) GROUP BY ALL) ON k >= a AND k < z GROUP BY ALL""")


def spectra(t):
    return SP.band_spectrum(_frames(t), 16)


@query("band_spectrum", "SELECT track_id, frame_no, band, round(level, 6) AS level FROM v_bands")
def band_spectrum(t):
    return spectra(t).select("track_id", "frame_no", F.posexplode("bands").alias("band", "level")).select("track_id", "frame_no", "band", r6("level"))


@query("spectrum_range", """
SELECT track_id, frame_no, r AS part, count(*) AS n, round(sum(level), 6) AS total FROM v_bands JOIN (VALUES ('low', 0, 7), ('mid', 4, 12), ('high', 10, 16)) v(r, a, z) ON band >= a AND band < z GROUP BY ALL""")
def spectrum_range(t):
    rows = spectra(t)
    out = None
    for part in ("low", "mid", "high"):
        cut = S.band_range(F.col("bands"), part)
        one = rows.select("track_id", "frame_no", F.lit(part).alias("part"), F.size(cut).cast("bigint").alias("n"), F.round(F.aggregate(cut, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("smooth_bands", """
WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM v_bands), w AS (SELECT track_id, frame_no, band, level AS v FROM b WHERE frame_no = 0
  UNION ALL SELECT b.track_id, b.frame_no, b.band, greatest(0, least(1, w.v + (b.level - w.v) * 38e-2)) FROM w JOIN b ON b.track_id = w.track_id AND b.band = w.band AND b.frame_no = w.frame_no + 1)
SELECT track_id, frame_no, band, round(v, 6) AS level FROM w""")
def smooth_bands(t):
    return T.smooth_bands(spectra(t)).select("track_id", "frame_no", F.posexplode("bands").alias("band", "level")).select("track_id", "frame_no", "band", r6("level"))


view("v_gains", """
SELECT track_id, stem, CASE WHEN off THEN 0 ELSE gain * (1 - greatest(pan, 0)) END AS gl, CASE WHEN off THEN 0 ELSE gain * (1 + least(pan, 0)) END AS gr
FROM (SELECT *, muted OR (bool_or(soloed) OVER (PARTITION BY track_id) AND NOT soloed) AS off FROM v_stem_mix)""")


@query("stem_gain", "SELECT track_id, stem, gl::DOUBLE AS gain_left, gr::DOUBLE AS gain_right FROM v_gains")
def stem_gain(t):
    return G.stem_channel_gains(t.stem_mix)


@query("stem_mix", """
SELECT track_id, block_no, channel, string_agg(round(v * 1e6)::BIGINT, ',' ORDER BY i) AS samples FROM (
  SELECT s.track_id, block_no, channel::INT AS channel, i, sum(samples[i + 1]::DOUBLE * CASE channel WHEN 0 THEN gl ELSE gr END) AS v FROM v_stems s JOIN v_gains USING (track_id, stem), range(2) c(channel), range(64) g(i)
  WHERE CASE channel WHEN 0 THEN gl ELSE gr END > 0 GROUP BY ALL) GROUP BY ALL""")
def stem_mix(t):
    return G.stem_mix(t.stems, G.stem_channel_gains(t.stem_mix)).select("track_id", "block_no", "channel", r6_array("samples"))


@query("stem_peaks", """
SELECT track_id, stem, block_no, round(max(abs(samples[i + 1]::DOUBLE)) * greatest(gl, gr), 6) AS peak FROM v_stems JOIN v_gains USING (track_id, stem), range(64) g(i) WHERE greatest(gl, gr) > 0 GROUP BY track_id, stem, block_no, gl, gr""")
def stem_peaks(t):
    return G.stem_peaks(t.stems, G.stem_channel_gains(t.stem_mix)).select("track_id", "stem", "block_no", r6("peak"))


@query("align_stem", """
WITH n AS (SELECT track_id, frames, floor(frames * 3 / 4 * 11e-1)::BIGINT AS target FROM v_frames),
p AS (SELECT track_id, frames, f, f * (4e3 / 3e3) AS pos FROM (SELECT *, unnest(range(target)) AS f FROM n)),
q AS (SELECT *, least(floor(pos)::BIGINT, frames - 1) AS a FROM p)
SELECT q.track_id, c::INT AS channel, f AS frame, round(x.x + (y.x - x.x) * (pos - a), 6) AS v FROM q, range(2) g(c) JOIN v_samples x ON x.track_id = q.track_id AND x.channel = c AND x.frame = a JOIN v_samples y ON y.track_id = q.track_id AND y.channel = c AND y.frame = least(a + 1, frames - 1)""")
def align_stem(t):
    made = G.align_stem(t.stereo, 3000, F.floor(F.col("frames") * 3 / 4 * 1.1))
    return made.select("track_id", "channel", "first_frame", F.posexplode("samples").alias("i", "v")).select("track_id", "channel", (F.col("first_frame") + F.col("i")).alias("frame"), r6("v"))


@query("overlap_add", "SELECT track_id, 0 AS stem, channel, frame // 64 AS block_no, string_agg(round(x * 1e6)::BIGINT, ',' ORDER BY frame) AS samples FROM v_samples GROUP BY ALL")
def overlap_add(t):
    return NN.overlap_add(t.stereo, "identity", chunk=400, overlaps=4, batch=2, block_frames=BLOCK).select("track_id", "stem", "channel", "block_no", r6_array("samples"))


@query("batch_infer", "SELECT track_id, block_no, round(sum(x), 6) AS total, false AS failed FROM (SELECT track_id, block_no, unnest(samples)::DOUBLE AS x FROM v_blocks) GROUP BY ALL")
def batch_infer(t):
    made = NN.batch_infer(t.blocks.select("track_id", "block_no", F.array("samples").alias("chunk")), "identity", batch=8)
    total = F.aggregate(F.flatten(F.flatten("outputs")), F.lit(0.0), lambda a, x: a + x)
    return made.select("track_id", "block_no", F.round(total, 6).alias("total"), F.col("error").isNotNull().alias("failed"))


view("v_items", """
SELECT track_id, position, i AS idx, code, code >> 20 AS bits, count(*) OVER (PARTITION BY track_id) AS n, count(*) OVER (PARTITION BY track_id) * 1238e-4 AS d FROM (
  SELECT track_id || '-' || (block_no // 64) || CASE flip WHEN 1 THEN 'x' ELSE '' END AS track_id, flip AS position, block_no % 64 AS i,
    xor(list_aggregate(list_transform(range(32), lambda k: CASE WHEN samples[2 * k + 1] > samples[2 * k + 2] THEN 1::BIGINT << k ELSE 0 END), 'sum')::BIGINT, CASE flip WHEN 1 THEN 1::BIGINT << ((block_no % 64) % 32) ELSE 0 END) AS code
  FROM v_blocks, range(2) g(flip))""")
view("v_levels_fp", """
SELECT o.a, o.b, o.off, o.need, row_number() OVER w AS r, sum(bit_count(xor(x.code, y.code)) - 5) OVER w AS level FROM (
    SELECT x.track_id AS a, y.track_id AS b, x.idx - y.idx AS off, ceil(least(6, greatest(3, 1365e0 / 11025 * least(any_value(x.n), any_value(y.n)) * 6e-1)) / (1365e0 / 11025) - 1e-9)::BIGINT AS need
    FROM v_items x JOIN v_items y ON x.bits = y.bits AND (x.position < y.position OR (x.position = y.position AND x.track_id < y.track_id)) AND abs(x.d - y.d) <= greatest(2, least(x.d, y.d) / 100)
    GROUP BY x.track_id, y.track_id, x.idx - y.idx HAVING count(*) >= 2) o
  JOIN v_items x ON x.track_id = o.a JOIN v_items y ON y.track_id = o.b AND y.idx = x.idx - o.off WINDOW w AS (PARTITION BY o.a, o.b, o.off ORDER BY y.idx)""")


def prints(t):
    flipped = F.col("track_id").endswith("x").cast("bigint")
    return t.fingerprints.withColumn("position", flipped)


@query("fingerprint_matches", """
SELECT DISTINCT e.a, e.b FROM v_levels_fp e
WHERE (e.r >= e.need AND e.level <= 0) OR EXISTS (SELECT 1 FROM v_levels_fp q WHERE q.a = e.a AND q.b = e.b AND q.off = e.off AND q.r <= e.r - e.need AND q.level >= e.level)""")
def fingerprint_matches(t):
    return FP.fingerprint_matches(FP.representatives(prints(t)))


@query("fingerprint_duplicates", """
SELECT track_id, left(track_id, length(track_id) - 1) AS duplicate_of FROM (SELECT DISTINCT track_id, n FROM v_items WHERE position = 1) WHERE n >= 25""")
def fingerprint_duplicates(t):
    # every fingerprint comes twice, once with one bit of each item flipped
    return FP.fingerprint_duplicates(prints(t))


# -- manifests ---------------------------------------------------------------


def manifest_texts(t):
    """Project documents as JSON text, built from the catalogue tables; projects hold at most 25 tracks."""
    def build():
        u = F.col("user_id")
        marks = t.markers.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct(
            F.col("start_s").alias("o"), F.col("marker_id").alias("id"), "label", F.col("start_s").alias("startSeconds"), F.col("end_s").alias("endSeconds"), "origin"))).alias("markers"))
        mix = t.stem_mix.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("stem", "gain", "pan", "muted", "soloed"))).alias("mix"))
        sized = F.when(u % 5 == 1, F.concat("mix", F.slice("mix", 1, 2))).when(u % 5 == 2, F.slice("mix", 1, 3)).when(u % 5 != 3, F.col("mix"))
        practice = F.struct(
            F.lit(1.0).alias("playbackRate"), F.when(u % 2 == 0, 3.0).alias("pitchSemitones"), F.coalesce("markers", F.array().cast(
                "array<struct<o:double,id:string,label:string,startSeconds:double,endSeconds:double,origin:string>>")).alias("markers"), sized.alias("stemMix"),
            F.when(u % 2 == 0, F.transform("markers", lambda m: F.struct(F.lit("standard").alias("mode"), m["startSeconds"].alias("startSeconds"), (m["startSeconds"] + 0.5).alias("endSeconds"), F.lit("Am").alias("label")))).alias("chordEdits"),
            F.when(u % 3 == 0, F.array(F.struct(F.lit("essential").alias("mode"), F.transform("markers", lambda m: F.struct(
                m["id"].alias("id"), m["label"].alias("label"), m["startSeconds"].alias("startSeconds"), (m["startSeconds"] + 2).alias("endSeconds"))).alias("regions")))).alias("chordTimelines"))
        track = F.struct(
            F.col("position").alias("o"), F.col("track_id").alias("id"), "title", F.col("source_path").alias("sourcePath"), "format", F.col("file_size_bytes").alias("fileSizeBytes"),
            F.col("duration_s").alias("durationSeconds"), practice.alias("practice"))
        whole = t.tracks.join(marks, "track_id", "left").join(mix, "track_id").groupBy("project_id").agg(F.array_sort(F.collect_list(track)).alias("tracks"))
        number = F.substring("project_id", 2, 20).cast("bigint")
        doc = F.to_json(F.struct(F.when(number % 6 == 5, 2).otherwise(1).alias("formatVersion"), F.col("project_id").alias("id"), F.concat(F.lit("Set "), "project_id").alias("name"), "tracks"))
        return whole.select(F.col("project_id").alias("path"), F.when(number % 6 == 4, F.left(doc, F.length(doc) - 3)).otherwise(doc).alias("json"))

    return t.stored("manifest_texts", build)


view("v_project", "SELECT *, substr(project_id, 2)::BIGINT % 6 AS k FROM v_tracks")


@query("scan_manifests", """
SELECT project_id, (row_number() OVER (PARTITION BY project_id ORDER BY position) - 1)::INT AS position, track_id, title, source_path, duration_s, 1e0 AS playback_rate, CASE WHEN user_id % 2 = 0 THEN 3e0 ELSE 0e0 END AS pitch_semitones FROM v_project WHERE k < 4""")
def scan_manifests(t):
    tracks = MF.track_rows(MF.parse_manifests(manifest_texts(t)))
    settings = MF.practice(tracks).select("track_id", "playback_rate", "pitch_semitones")
    return tracks.select("project_id", "position", "track_id", "title", "source_path", "duration_s").join(settings, "track_id")


@query("manifest_report", "SELECT CASE k WHEN 4 THEN 'invalid metadata' ELSE 'unsupported version' END AS reason, count(DISTINCT project_id) AS n FROM v_project WHERE k >= 4 GROUP BY ALL")
def manifest_report(t):
    from stave.operators.quality import tolerant_scan_report

    return tolerant_scan_report(MF.parse_manifests(manifest_texts(t)))


@query("manifest_children", """
SELECT track_id, 'marker' AS kind, marker_id AS item, start_s AS value FROM v_markers JOIN v_project USING (track_id) WHERE k < 4
UNION ALL SELECT track_id, 'stem', stem::VARCHAR, CASE WHEN user_id % 5 = 3 THEN 1 ELSE gain END FROM v_stem_mix JOIN v_project USING (track_id) WHERE k < 4 AND user_id % 5 <> 2
UNION ALL SELECT track_id, 'rejected', 'stems', 3 FROM v_project WHERE k < 4 AND user_id % 5 = 2""")
def manifest_children(t):
    tracks = MF.track_rows(MF.parse_manifests(manifest_texts(t)))
    marks = MF.markers(tracks).select("track_id", F.lit("marker").alias("kind"), F.col("marker_id").alias("item"), F.col("start_s").alias("value"))
    stems = MF.stem_mix(tracks).select("track_id", F.lit("stem").alias("kind"), F.col("stem").cast("string").alias("item"), F.col("gain").alias("value"))
    bad = MF.rejected_stems(tracks).select("track_id", F.lit("rejected").alias("kind"), F.lit("stems").alias("item"), F.col("n_stems").cast("double").alias("value"))
    return marks.unionByName(stems).unionByName(bad)


@query("manifest_chords", """
SELECT track_id, 'edit' AS kind, 'standard' AS mode, (row_number() OVER (PARTITION BY track_id ORDER BY start_s, marker_id) - 1)::VARCHAR AS item, 'Am' AS label, start_s, start_s + 5e-1 AS end_s
FROM v_markers JOIN v_project USING (track_id) WHERE k < 4 AND user_id % 2 = 0
UNION ALL SELECT track_id, 'region', 'essential', marker_id, label, start_s, start_s + 2 FROM v_markers JOIN v_project USING (track_id) WHERE k < 4 AND user_id % 3 = 0""")
def manifest_chords(t):
    """Chord edits and regions of the projects' tracks as rows."""
    tracks = MF.track_rows(MF.parse_manifests(manifest_texts(t)))
    edits = MF.chord_edits(tracks).select("track_id", F.lit("edit").alias("kind"), "mode", F.col("edit_seq").cast("string").alias("item"), "label", "start_s", "end_s")
    regions = MF.chord_regions(tracks).select("track_id", F.lit("region").alias("kind"), "mode", F.col("region_id").alias("item"), "label", "start_s", "end_s")
    return edits.unionByName(regions)


def wav_files(t):
    """WAV files written from the block table: one per 64 blocks of a track, odd ones as 16-bit integers."""
    import struct

    from stave.session import new_dir

    folder = new_dir(t.spark, "wav")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name, part = pdf["track_id"].iloc[0], int(pdf["part"].iloc[0])
        x = np.concatenate(list(pdf.sort_values("block_no")["samples"])).astype("<f4")
        wide = part % 2 == 0
        body = x.tobytes() if wide else np.clip(np.round(x * 32768), -32768, 32767).astype("<i2").tobytes()
        size = 4 if wide else 2
        head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3 if wide else 1, 1, RATE, RATE * size, size, size * 8) + b"data" + struct.pack("<I", len(body))
        target = f"{folder}/{name}-{part}.wav"
        local = fs.LocalFileSystem() if "://" not in target else None
        system, inner = (local, target) if local else fs.FileSystem.from_uri(target)
        system.create_dir(folder if local else inner.rsplit("/", 1)[0])
        with system.open_output_stream(inner) as out:
            out.write(head + body)
        return pd.DataFrame({"path": [target]})

    grouped = t.blocks.select("track_id", "block_no", "samples", F.floor(F.col("block_no") / 64).alias("part"))
    grouped.groupBy("track_id", "part").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


@query("scan_wav_blocks", """
SELECT track_id || '-' || part AS file, i // 1000 AS block_no, count(*) AS n, round(sum(CASE WHEN part % 2 = 0 THEN x ELSE greatest(-32768, least(32767, round_even(x * 32768, 0))) / 32768 END), 6) AS total
FROM (SELECT track_id, block_no // 64 AS part, (block_no % 64) * 64 + k AS i, samples[k + 1]::DOUBLE AS x FROM v_blocks, range(64) g(k)) GROUP BY ALL""")
def scan_wav_blocks(t):
    blocks = WV.scan_wav_blocks(WV.wav_metadata(t.spark, wav_files(t)), block_frames=1000)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return blocks.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("file"), "block_no", F.size("samples").cast("bigint").alias("n"), F.round(total, 6).alias("total"))


@query("wav_waveform", """
WITH s AS (SELECT track_id || '-' || part AS file, i, CASE WHEN part % 2 = 0 THEN x ELSE greatest(-32768, least(32767, round_even(x * 32768, 0))) / 32768 END AS v
  FROM (SELECT track_id, block_no // 64 AS part, (block_no % 64) * 64 + k AS i, samples[k + 1]::DOUBLE AS x FROM v_blocks, range(64) g(k))),
f AS (SELECT file, greatest(1, ceil(count(*) / 10e0))::BIGINT AS per FROM s GROUP BY ALL)
SELECT file, i // per AS bucket, round(least(1, min(v)), 6) AS "min", round(greatest(-1, max(v)), 6) AS "max" FROM s JOIN f USING (file) GROUP BY ALL""")
def wav_waveform(t):
    """Peaks of WAV files, of blocks read with all they need of their file."""
    blocks = WV.scan_wav_blocks(WV.wav_metadata(t.spark, wav_files(t)), block_frames=1000)
    peaks = G.waveform_peaks(blocks.withColumn("track_id", F.regexp_extract("path", r"([^/]*)\.wav$", 1)), 10)
    return peaks.select(F.col("track_id").alias("file"), "bucket", F.round(F.col("min").cast("double"), 6).alias("min"), F.round(F.col("max").cast("double"), 6).alias("max"))


@query("write_tables", "SELECT track_id, beat_idx, beat_s FROM v_raw")
def write_tables(t):
    from stave.session import new_dir

    path = new_dir(t.spark, "published")
    TB.write_table(t.raw, path, version=1, buckets=8, order=("track_id", "beat_idx"))
    return TB.read_table(t.spark, path, 1).select("track_id", "beat_idx", "beat_s")
