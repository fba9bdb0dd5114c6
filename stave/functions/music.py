"""Chord-label expressions: spelling, reduction, transposition and pitch sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.functions import vocabulary as V
from stave.functions.scalars import half_up, lookup


def _name(pitch: Column, flat: Column | bool) -> Column:
    sharp = F.get(F.array(*[F.lit(n) for n in V.SHARP_NAMES]), pitch.cast("int"))
    flats = F.get(F.array(*[F.lit(n) for n in V.FLAT_NAMES]), pitch.cast("int"))
    if isinstance(flat, bool):
        return flats if flat else sharp
    return F.when(flat, flats).otherwise(sharp)


def harte_to_compact(label: Column) -> Column:
    """``C:maj7`` -> ``Cmaj7``; a bass degree becomes a note; no chord -> ``N``; unreadable -> null."""
    root = F.substring_index(label, ":", 1)
    suffix = F.regexp_extract(label, "^[^:]*:(.*)$", 1)
    quality = F.substring_index(suffix, "/", 1)
    degree = F.regexp_extract(suffix, "^[^/]*/(.*)$", 1)
    compact = F.coalesce(lookup(V.COMPACT_QUALITY, quality), quality)
    bass = F.pmod(lookup(V.WORKER_PITCH, root) + lookup(V.BASS_SEMITONES, degree), F.lit(12))
    return (
        F.when(label.isin("N", "X"), "N")
        .when(~label.contains(":"), F.lit(None).cast("string"))
        .when(~suffix.contains("/"), F.concat(root, compact))
        .otherwise(F.concat(root, compact, F.lit("/"), _name(bass, root.contains("b"))))
    )


def triad_family(label: Column) -> Column:
    quality = F.substring_index(F.regexp_extract(label, "^[^:]*:(.*)$", 1), "/", 1)
    return (
        F.when(label.isin("N", "X"), "N")
        .when(~label.contains(":"), F.lit(None).cast("string"))
        .when(quality.isin("hdim", "dim7"), "Diminished")
        .when(quality.startswith("min") | (quality == "m"), "Minor")
        .when(quality.startswith("dim"), "Diminished")
        .when(quality.startswith("aug"), "Augmented")
        .when(quality.startswith("sus2"), "Sus2")
        .when(quality.startswith("sus4") | (quality == "sus"), "Sus4")
        .otherwise("Major")
    )


def triad_root(label: Column) -> Column:
    return F.when(~label.isin("N", "X"), F.substring_index(label, ":", 1))


def triad_label(label: Column) -> Column:
    family = triad_family(label)
    return F.when(family == "N", "N").otherwise(F.concat(triad_root(label), lookup(V.TRIAD_SUFFIX, family)))


def triad_class(label: Column) -> Column:
    """Index of a label's triad among the model's native classes; 0 is no chord."""
    order = {name: 1 + 12 * i for i, name in enumerate(V.TRIAD_CLASS_ORDER)}
    family = triad_family(label)
    return F.when(family == "N", F.lit(0)).otherwise(
        lookup(order, family) + lookup(V.WORKER_PITCH, triad_root(label))
    )


_COMPACT = r"^([A-G](?:#|b)?)([^/]*)(?:/([A-G](?:#|b)?))?$"


def _pitch(note: Column) -> Column:
    """Pitch class of a note; null when unreadable."""
    return lookup(V.NOTE_CLASS, note)


def transpose(label: Column, semitones: Column, flat: Column | bool) -> Column:
    """Shift root and bass; labels outside the compact grammar stay as they are."""
    root = _pitch(F.regexp_extract(label, _COMPACT, 1))
    bass_text = F.regexp_extract(label, _COMPACT, 3)
    bass = _pitch(F.when(bass_text != "", bass_text))
    shift = half_up(semitones).cast("int")
    moved = F.concat(
        _name(F.pmod(root + shift, F.lit(12)), flat),
        F.regexp_extract(label, _COMPACT, 2),
        F.coalesce(F.concat(F.lit("/"), _name(F.pmod(bass + shift, F.lit(12)), flat)), F.lit("")),
    )
    return F.when(label.isin("N", "-") | ~label.rlike(_COMPACT), label).otherwise(moved)


def canonical(label: Column) -> Column:
    """Sharp spelling, for comparing labels."""
    return transpose(label, F.lit(0), False)


def compact_to_harte(label: Column) -> Column:
    """Compact spelling -> Harte spelling with an interval for the bass."""
    root = F.regexp_extract(label, _COMPACT, 1)
    raw = F.regexp_extract(label, _COMPACT, 2)
    bass = F.regexp_extract(label, _COMPACT, 3)
    quality = F.coalesce(lookup(V.HARTE_QUALITY, raw), raw)
    step = F.pmod(lookup(V.EXPORT_PITCH, bass) - lookup(V.EXPORT_PITCH, root), F.lit(12))
    interval = F.get(F.array(*[F.lit(n) for n in V.INTERVAL_NAMES]), step.cast("int"))
    slash = F.coalesce(F.concat(F.lit("/"), interval), F.lit(""))
    return F.when(
        (label == "N") | label.contains(":") | ~label.rlike(_COMPACT), label
    ).otherwise(F.concat(root, F.lit(":"), quality, slash))


def degree_semitones(degree: Column) -> Column:
    """Semitones above the root for a degree such as ``b7`` or ``#11``; null when unreadable."""
    return lookup(V.DEGREE_SEMITONES, degree)


def _degree_class(degree: Column) -> Column:
    return F.pmod(degree_semitones(degree), F.lit(12))


_CHORD = r"^([A-G](?:#|b)*)(:?)(.*)$"
_SLASH = r"^(.*)/((?:[^/()]|\([^()]*\))*)$"


def with_pitch_sets(df: DataFrame, label: str = "label") -> DataFrame:
    """Add struct ``chord``: root, bass, degrees, ordered pitches and a 12-bit mask; null when unreadable.

    Built in stages, so each part is made once per row.
    """
    names = df.columns
    made = df.select(
        "*", F.regexp_extract(label, _CHORD, 1).alias("_root"), (F.regexp_extract(label, _CHORD, 2) == ":").alias("_harte"),
        F.regexp_extract(label, _CHORD, 3).alias("_suffix"),
    )
    slashed = F.col("_suffix").rlike(_SLASH)
    made = made.select(
        "*", _pitch(F.col("_root")).alias("_r"),
        F.when(slashed, F.regexp_extract("_suffix", _SLASH, 1)).otherwise(F.col("_suffix")).alias("_quality"),
        F.when(slashed, F.regexp_extract("_suffix", _SLASH, 2)).otherwise(F.lit("")).alias("_slash"),
    )
    shape = r"^([^()]*)(\([^()]*\))?$"
    made = made.select("*", F.regexp_extract("_quality", shape, 1).alias("_base"), F.regexp_extract("_quality", shape, 2).alias("_extra"))
    base = F.coalesce(lookup(V.SHORTHAND_ALIASES, F.col("_base")), F.col("_base"))
    bare = (F.col("_base") == "") & (F.col("_extra") != "")
    parts = F.split(F.regexp_extract("_extra", r"^\((.*)\)$", 1), ",")
    made = made.select(
        "*", F.when(bare, F.array().cast("array<string>")).otherwise(lookup(V.SHORTHAND_DEGREES, base)).alias("_start"),
        F.filter(parts, lambda m: m != "").alias("_changes"),
    )
    plain = lambda m: F.regexp_replace(m, r"^\*", "")
    made = made.withColumn("_merged", F.aggregate(
        "_changes", F.col("_start"),
        lambda acc, m: F.when(
            m.startswith("*"), F.filter(acc, lambda d: degree_semitones(d) != degree_semitones(plain(m)))
        ).otherwise(F.concat(acc, F.array(m))),
    ))
    readable = F.col(label).rlike(_CHORD) & ~F.col(label).isin("N", "X", "-") & F.col("_quality").rlike(shape) & ~F.exists(
        "_changes", lambda m: degree_semitones(plain(m)).isNull()
    )
    made = made.withColumn("_classes", F.transform("_merged", _degree_class)).withColumn("_ok", readable)
    made = made.withColumn("_degrees", F.filter(
        "_merged", lambda d, i: F.array_position("_classes", _degree_class(d)) == (i + 1).cast("bigint")))
    named = F.when(F.col("_harte"), F.pmod(F.col("_r") + degree_semitones(F.col("_slash")), F.lit(12))).otherwise(_pitch(F.col("_slash")))
    made = made.withColumn("_bass", F.when(F.col("_slash") != "", named).otherwise(F.col("_r")))
    made = made.withColumn("_pitches", F.transform(
        F.array_sort(F.array_distinct("_classes")), lambda step: F.pmod(F.col("_r") + step, F.lit(12))))
    lead = (F.col("_slash") != "") & ~F.array_contains("_pitches", F.col("_bass"))
    made = made.withColumn("_pitches", F.when(lead, F.concat(F.array("_bass"), F.col("_pitches"))).otherwise(F.col("_pitches")))
    mask = F.aggregate("_pitches", F.lit(0), lambda acc, p: acc.bitwiseOR(
        F.get(F.array(*[F.lit(1 << n) for n in range(12)]), p.cast("int"))))
    usable = F.col("_ok") & (F.size("_degrees") > 0) & F.col("_bass").isNotNull() & F.col("_r").isNotNull()
    chord = F.struct(
        F.col("_r").alias("root"), F.col("_bass").alias("bass"), F.col("_degrees").alias("degrees"),
        F.col("_pitches").alias("pitches"), mask.alias("mask"),
    )
    return made.select(*names, F.when(usable, chord).alias("chord"))


def degree_names(chord: Column) -> Column:
    """Degree label of each pitch of a pitch set, chromatic when the chord does not name it."""
    def name(pitch: Column) -> Column:
        step = F.pmod(pitch - chord["root"], F.lit(12))
        own = F.filter(chord["degrees"], lambda d: _degree_class(d) == step)
        return F.coalesce(F.get(own, F.lit(0)), F.get(F.array(*[F.lit(n) for n in V.INTERVAL_NAMES]), step.cast("int")))

    return F.transform(chord["pitches"], name)


def normalize_entry(text: Column) -> Column:
    """Typed chord -> tidy spelling, before validation."""
    plain = F.translate(F.trim(text), "♯♭", "#b")
    shape = r"^([a-gA-G])([bB#]?)(.*)$"
    tail = F.regexp_extract(plain, shape, 3)
    # upper-case every slash bass note and write its flat as "b"
    for note in "abcdefg":
        tail = F.regexp_replace(tail, f"/{note}", f"/{note.upper()}")
    tail = F.regexp_replace(tail, r"/([A-G])B", "/$1b")
    mark = F.regexp_replace(F.regexp_extract(plain, shape, 2), "B", "b")
    tidy = F.concat(F.upper(F.regexp_extract(plain, shape, 1)), mark, tail)
    return F.when(plain.rlike(shape), tidy).otherwise(plain)


def with_valid_entries(df: DataFrame, typed: str, flat: bool = False) -> DataFrame:
    """Add ``entry``: the label a typed chord stands for, ``N`` for no chord, null when invalid."""
    tidy = df.withColumn("_tidy", normalize_entry(F.col(typed)))
    sets = with_pitch_sets(tidy, "_tidy")
    entry = F.when((F.col("_tidy") == "-") | (F.upper("_tidy") == "N"), "N").when(
        F.col("chord").isNotNull(), transpose(F.col("_tidy"), F.lit(0), flat)
    )
    return sets.select(*df.columns, entry.alias("entry"))
