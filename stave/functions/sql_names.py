"""SQL names of the catalogue's label and title functions.

``register`` makes temporary SQL functions whose bodies are SQL expressions, so a query in
text is inlined by Catalyst as the column forms of ``music`` and ``text`` are.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from stave.functions import vocabulary as V
from stave.functions.scalars import _sql


def _map(table: dict, key: str) -> str:
    return f"element_at(map({', '.join(f'{_sql(k)}, {_sql(v)}' for k, v in table.items())}), {key})"


def _note(pitch: str, flat: str) -> str:
    return f"get(CASE WHEN {flat} THEN {_sql(V.FLAT_NAMES)} ELSE {_sql(V.SHARP_NAMES)} END, CAST({pitch} AS INT))"


_COMPACT = "R'^([A-G](?:#|b)?)([^/]*)(?:/([A-G](?:#|b)?))?$'"


def _part(i: int) -> str:
    return f"regexp_extract(label, {_COMPACT}, {i})"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Arguments, type and body of each function by its name."""
    suffix = "regexp_extract(label, '^[^:]*:(.*)$', 1)"
    quality, root = f"substring_index({suffix}, '/', 1)", "substring_index(label, ':', 1)"
    degree = f"regexp_extract({suffix}, '^[^/]*/(.*)$', 1)"
    bass = f"pmod({_map(V.WORKER_PITCH, root)} + {_map(V.BASS_SEMITONES, degree)}, 12)"
    family = f"""CASE WHEN label IN ('N', 'X') THEN 'N' WHEN NOT contains(label, ':') THEN NULL WHEN {quality} IN ('hdim', 'dim7') THEN 'Diminished'
      WHEN startswith({quality}, 'min') OR {quality} = 'm' THEN 'Minor' WHEN startswith({quality}, 'dim') THEN 'Diminished' WHEN startswith({quality}, 'aug') THEN 'Augmented'
      WHEN startswith({quality}, 'sus2') THEN 'Sus2' WHEN startswith({quality}, 'sus4') OR {quality} = 'sus' THEN 'Sus4' ELSE 'Major' END"""
    moved = "pmod({} + CAST(floor(semitones + 0.5) AS INT), 12)"
    own_root, own_bass = (f"nullif({_part(i)}, '')" for i in (1, 3))
    step = f"pmod({_map(V.EXPORT_PITCH, _part(3))} - {_map(V.EXPORT_PITCH, _part(1))}, 12)"
    near = "1D - levenshtein(a, b) / greatest(char_length(a), char_length(b))"
    stops = ", ".join(map(_sql, V.TITLE_STOP_TOKENS))
    return {
        "harte_to_compact": ("label STRING", "STRING", f"""CASE WHEN label IN ('N', 'X') THEN 'N' WHEN NOT contains(label, ':') THEN NULL
          ELSE concat({root}, coalesce({_map(V.COMPACT_QUALITY, quality)}, {quality}), CASE WHEN contains({suffix}, '/') THEN concat('/', {_note(bass, f"contains({root}, 'b')")}) ELSE '' END) END"""),
        "triad_family": ("label STRING", "STRING", family),
        "triad_label": ("label STRING", "STRING", f"CASE WHEN label IN ('N', 'X') THEN 'N' ELSE concat({root}, {_map(V.TRIAD_SUFFIX, f'({family})')}) END"),
        "compact_to_harte": ("label STRING", "STRING", f"""CASE WHEN label = 'N' OR contains(label, ':') OR NOT label RLIKE {_COMPACT} THEN label
          ELSE concat({_part(1)}, ':', coalesce({_map(V.HARTE_QUALITY, _part(2))}, {_part(2)}), coalesce(concat('/', get({_sql(V.INTERVAL_NAMES)}, CAST({step} AS INT))), '')) END"""),
        "transpose_label": ("label STRING, semitones DOUBLE, flats BOOLEAN", "STRING", f"""CASE WHEN label IN ('N', '-') OR NOT label RLIKE {_COMPACT} THEN label
          ELSE concat({_note(moved.format(_map(V.NOTE_CLASS, own_root)), 'flats')}, {_part(2)}, coalesce(concat('/', {_note(moved.format(_map(V.NOTE_CLASS, own_bass)), 'flats')}), '')) END"""),
        "title_tokens": ("title STRING", "ARRAY<STRING>", rf"""slice(filter(transform(split(regexp_replace(lower(title), R"['’‘ʼ]", ''), R'[^\p{{IsAlphabetic}}\p{{N}}]+'), t -> left(t, 64)), t -> t <> '' AND t NOT IN ({stops})), 1, 32)"""),
        "token_similarity": ("a STRING, b STRING", "DOUBLE", f"""CASE WHEN a = b THEN 1D WHEN greatest(char_length(a), char_length(b)) < 4 THEN 0D WHEN {near} >= 0.72D THEN {near} ELSE 0D END"""),
    }


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, (arguments, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
