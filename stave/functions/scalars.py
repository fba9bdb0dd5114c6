"""Small numeric and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value) -> str:
    if isinstance(value, list):
        return f"array({', '.join(map(_sql, value))})"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)


def lookup(table: dict, key: Column) -> Column:
    """A literal map lookup; null when the key is absent."""
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.element_at(F.expr(f"map({entries})"), key)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_up(value: Column) -> Column:
    """Round half towards positive infinity, as whole number."""
    return F.floor(value + F.lit(0.5))


def finite(value: Column) -> Column:
    """True for a present, finite double."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def relevance_percent(score: Column) -> Column:
    return F.when(finite(score), half_up(clamp(score, 0.0, 1.0) * 100)).otherwise(F.lit(0)).cast("int")


def level_of_percent(percent: Column) -> Column:
    return (
        F.when(percent >= 100, 4).when(percent >= 75, 3).when(percent >= 50, 2).when(percent >= 25, 1).otherwise(0)
    )


def duration_level(candidate: Column, audio: Column) -> Column:
    """How well a record's duration fits the audio: 4 close to 0 unrelated."""
    gap = F.abs(candidate - audio)
    ratio = gap / F.when(audio != 0, audio)
    usable = finite(candidate) & finite(audio) & (candidate > 0) & (audio > 0)
    return (
        F.when(~usable, 0)
        .when((gap <= 2) | (ratio <= 0.015), 4)
        .when((gap <= 8) | (ratio <= 0.05), 3)
        .when((gap <= 15) | (ratio <= 0.1), 2)
        .when(ratio <= 0.2, 1)
        .otherwise(0)
    )


def resource_load(*metrics: Column) -> Column:
    return F.coalesce(F.greatest(*[F.when(m.isNotNull(), clamp(m, 0.0, 100.0)) for m in metrics]), F.lit(0.0))


def pressure(load: Column) -> Column:
    return F.when(load >= 85, "hot").when(load >= 65, "warm").otherwise("normal")


def score_band(label: Column, strength: Column) -> Column:
    band = F.least(F.lit(9), F.floor(clamp(strength, 0.0, 1.0) * 10)).cast("int")
    return F.when(~label.isin("N", "-"), band)


def _two(value: Column) -> Column:
    text = value.cast("bigint").cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def clock(seconds: Column) -> Column:
    """``mm:ss``; minutes grow past two digits."""
    shown = F.concat(_two(F.floor(seconds / 60)), F.lit(":"), _two(F.floor(seconds % 60)))
    return F.when(finite(seconds) & (seconds >= 0), shown).otherwise("00:00")


def clock_ms(seconds: Column) -> Column:
    ms = half_up(seconds * 1000).cast("bigint")
    shown = F.concat(
        _two(F.floor(ms / 60000)),
        F.lit(":"),
        _two(F.floor((ms % 60000) / 1000)),
        F.lit("."),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )
    return F.when(finite(seconds) & (seconds >= 0), shown).otherwise("00:00.000")


def clock_short(seconds: Column) -> Column:
    """``m:ss`` of the rounded duration."""
    total = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5).cast("bigint")
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), _two(total % 60))


def pitch_text(semitones: Column) -> Column:
    cents = half_up(semitones * 100).cast("bigint")
    near = F.concat(F.when(cents > 0, "+").otherwise(""), cents.cast("string"), F.lit(" ct"))
    far = F.concat(F.when(semitones > 0, "+").otherwise(""), F.format_string("%.2f", semitones), F.lit(" st"))
    return F.when(F.abs(semitones) < 1, near).otherwise(far)


def lrc_time(ms: Column) -> Column:
    """``mm:ss.cc``, truncated to centiseconds."""
    ms = ms.cast("bigint")
    return F.concat(
        _two(F.floor(ms / 60000)),
        F.lit(":"),
        _two(F.floor((ms % 60000) / 1000)),
        F.lit("."),
        _two(F.floor((ms % 1000) / 10)),
    )


def level_db(level: Column) -> Column:
    return F.greatest(F.lit(-60.0), F.lit(20.0) * F.log10(F.greatest(level, F.lit(0.001))))


def normalization_gain(lufs: Column, peak: Column) -> Column:
    """Gain to -16 LUFS, held so the peak stays below -1 dBFS; 1 when not measurable."""
    wanted = F.pow(F.lit(10.0), (F.lit(-16.0) - lufs) / 20)
    ceiling = F.pow(F.lit(10.0), F.lit(-1.0) / 20) / F.when(peak > 0, peak)
    return F.when(finite(lufs) & (peak > 0), F.least(wanted, ceiling)).otherwise(F.lit(1.0))


def offset_ms(seconds: Column) -> Column:
    """Offset limited to 30 s either way, in steps of 100 ms."""
    steps = half_up(clamp(seconds, -30.0, 30.0) * 10) * 100
    return F.when(finite(seconds), steps).otherwise(F.lit(0)).cast("bigint")


def stem_gains(gain: Column, pan: Column, silent: Column) -> tuple[Column, Column]:
    left = gain * (F.lit(1.0) - F.greatest(pan, F.lit(0.0)))
    right = gain * (F.lit(1.0) + F.least(pan, F.lit(0.0)))
    return F.when(silent, 0.0).otherwise(left), F.when(silent, 0.0).otherwise(right)


def band_range(values: Column, name: str) -> Column:
    """The low, mid or high part of a band array."""
    low, high = {"full": (0.0, 1.0), "low": (0.0, 0.43), "mid": (0.31, 0.74), "high": (0.63, 1.0)}[name]
    if name == "full":
        return values
    first = F.floor(F.size(values) * F.lit(low)).cast("int")
    end = F.greatest(first + 1, F.ceil(F.size(values) * F.lit(high)).cast("int"))
    return F.slice(values, first + 1, end - first)
