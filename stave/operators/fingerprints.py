"""Duplicate tracks by acoustic fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.operators.timeline import keep_first

# Fingerprint version, item length, match limits; and the alignment
# rule of the published fingerprint matcher: an offset is considered when at
# least two aligned items agree in their top 12 bits.
VERSION = 2
ITEM_S = 1365 / 11025
MAX_BIT_ERROR = 5.0
MAX_GAP_S, MAX_GAP_SHARE = 2.0, 0.01
ALIGN_BITS, MIN_HITS = 12, 2


def durations_fit(a: Column, b: Column) -> Column:
    allowed = F.greatest(F.lit(MAX_GAP_S), F.least(a, b) * MAX_GAP_SHARE)
    return a.isNull() | b.isNull() | (F.abs(a - b) <= allowed)


def duration_bucket(duration: Column) -> Column:
    """Buckets so wide that fitting durations are at most one bucket apart."""
    wide = 100 + F.floor(F.ln(duration / 200.0) / float(np.log1p(MAX_GAP_SHARE)))
    return F.when(duration <= 200.0, F.floor(duration / 2.0)).otherwise(wide)


def _classes(prints: DataFrame) -> DataFrame:
    """First track of each group with equal fingerprint and duration, and the members it stands for."""
    usable = prints.where((F.col("version") == VERSION) & (F.size("values") > 0))
    return usable.withColumn("_code", F.sha2(F.to_json(F.struct("values", "duration_s")), 256))


def representatives(prints: DataFrame) -> DataFrame:
    """One track per distinct (fingerprint, duration): the first in order. Copies never reach the pairing."""
    return keep_first(_classes(prints), ["_code"], ["position", "track_id"]).drop("_code")


def aligned_offsets(prints: DataFrame) -> DataFrame:
    """(a, b, offset) of fingerprint pairs with enough aligned agreements; a comes first in order.

    Items meet on their top bits within neighbouring duration buckets; a track
    without duration fits every other and meets them on the bits alone. Hits are
    counted map-side before the exchange. A bucket skewed by one popular code is
    split by the adaptive skew join.
    """
    items = prints.select(
        "track_id", "position", "duration_s", F.posexplode("values").alias("idx", "code")
    ).withColumn("bits", F.shiftrightunsigned(F.col("code").cast("bigint"), 32 - ALIGN_BITS)).withColumn("bucket", duration_bucket(F.col("duration_s"))).drop("code")
    rank = F.struct("position", "track_id")
    left = items.select(F.col("track_id").alias("a"), rank.alias("ra"), F.col("duration_s").alias("da"), F.col("idx").alias("ia"), "bits", "bucket")
    right = items.select(F.col("track_id").alias("b"), rank.alias("rb"), F.col("duration_s").alias("db"), F.col("idx").alias("ib"), "bits", "bucket")
    near = right.where(F.col("bucket").isNotNull()).withColumn(
        "bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    timed = left.join(near, ["bits", "bucket"]).where(durations_fit(F.col("da"), F.col("db")))
    untimed_left = left.where(F.col("bucket").isNull()).drop("bucket").join(right.drop("bucket"), "bits")
    untimed_right = left.where(F.col("bucket").isNotNull()).drop("bucket").join(right.where(F.col("bucket").isNull()).drop("bucket"), "bits")
    shape = ["a", "b", "ra", "rb", "ia", "ib"]
    hits = timed.select(*shape).unionByName(untimed_left.select(*shape)).unionByName(untimed_right.select(*shape)).where(F.col("ra") < F.col("rb"))
    counts = hits.groupBy("a", "b", (F.col("ia") - F.col("ib")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= MIN_HITS).select("a", "b", "offset")


def required_items(shorter: int) -> int:
    seconds = min(6.0, max(3.0, ITEM_S * shorter * 0.6))
    return int(np.ceil(seconds / ITEM_S - 1e-9))


def has_run(a: np.ndarray, b: np.ndarray, offset: int) -> bool:
    """Whether some long enough aligned run differs by at most five bits an item on average."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    need = required_items(min(len(a), len(b)))
    if high - low < need:
        return False
    wrong = np.bitwise_count(np.bitwise_xor(a[low:high], b[low - offset : high - offset]).astype(np.uint32))
    level = np.concatenate([[0.0], np.cumsum(wrong - MAX_BIT_ERROR)])
    best = np.maximum.accumulate(level)[: len(level) - need]
    return bool((best >= level[need:] - 1e-9).any())


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        good = [
            (x == y).all() if len(x) == len(y) and (x == y).all() else has_run(np.asarray(x, np.int64), np.asarray(y, np.int64), int(o))
            for x, y, o in zip(b["va"], b["vb"], b["offset"])
        ]
        yield b.loc[np.asarray(good, dtype=bool), ["a", "b"]]


def fingerprint_matches(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that are duplicates; a comes first in order."""
    offsets = aligned_offsets(prints)
    values = prints.select("track_id", "values")
    paired = offsets.join(values.select(F.col("track_id").alias("a"), F.col("values").alias("va")), "a").join(
        values.select(F.col("track_id").alias("b"), F.col("values").alias("vb")), "b")
    return paired.select("a", "b", "offset", "va", "vb").mapInPandas(_verify, "a string, b string").distinct()


def fingerprint_duplicates(prints: DataFrame) -> DataFrame:
    """Tracks to set aside, each with the first track in order it duplicates.

    ``prints``: track_id, position, version, duration_s (nullable), values. Exact
    copies are tied to the first of their kind without pairing; other duplicates
    are reported against their earliest match, one row per track.
    """
    first = representatives(prints)
    keyed = _classes(prints)
    heads = keyed.join(first.select("track_id"), "track_id", "left_semi").select("_code", F.col("track_id").alias("head"), F.col("position").alias("_hp"))
    members = keyed.join(heads, "_code").select("track_id", "position", "head", "_hp")
    matches = fingerprint_matches(first)
    earliest = matches.join(first.select(F.col("track_id").alias("a"), "position"), "a").groupBy("b").agg(
        F.min_by("a", F.struct("position", "a")).alias("earlier"))
    joined = members.join(earliest.withColumnRenamed("b", "head"), "head", "left")
    origin = F.coalesce("earlier", F.when(F.col("track_id") != F.col("head"), F.col("head")))
    return joined.select("track_id", origin.alias("duplicate_of")).where(F.col("duplicate_of").isNotNull())
