"""Catalogue rules: duplicates, ranking, playlists, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stave.functions import text as X
from stave.functions import vocabulary as V
from stave.functions.scalars import clamp
from stave.operators.timeline import annotate, keep_first

RESULTS_PER_QUERY = 10


def relevance_score(rows: DataFrame) -> DataFrame:
    """Score search results (query, title, channel, views, verified, search_index) against their query."""
    artist, wanted = X.artist_and_title(F.col("query"))
    prepared = rows.select(
        "*", X.tokens(F.col("query")).alias("_q"), X.tokens(F.col("title")).alias("_t"), X.tokens(F.col("channel")).alias("_c"),
        X.tokens(artist).alias("_a"), X.tokens(wanted).alias("_w"), artist.isNotNull().alias("_structured"),
    )
    q, t, c = F.col("_q"), F.col("_t"), F.col("_c")
    combined = X.recall(q, F.concat(t, c))
    title, precision, channel = X.recall(q, t), X.recall(t, q), X.recall(q, c)
    hinted = F.lit(False)
    for hint in V.OFFICIAL_HINTS:
        hinted = hinted | F.lower("channel").contains(hint)
    popularity = F.coalesce(clamp(F.log10(F.col("views") + F.lit(1.0)) / 9.0, 0.0, 1.0), F.lit(0.0))
    position = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("search_index") / F.lit(float(RESULTS_PER_QUERY)))
    metadata = (
        F.coalesce(F.col("verified"), F.lit(False)).cast("int") * F.lit(0.03) + hinted.cast("int") * F.lit(0.005)
        + popularity * F.lit(0.01) + position * F.lit(0.005)
    )
    by_artist = F.greatest(X.recall(F.col("_a"), t), X.recall(F.col("_a"), c))
    structured = (
        X.recall(F.col("_w"), t) * F.lit(0.42) + by_artist * F.lit(0.24) + title * F.lit(0.17) + combined * F.lit(0.07)
        + precision * F.lit(0.05) + metadata
    )
    loose = title * F.lit(0.58) + precision * F.lit(0.24) + combined * F.lit(0.10) + channel * F.lit(0.03) + metadata
    unasked = F.lit(0)
    for marker in V.VERSION_MARKERS:
        unasked = unasked + (~F.array_contains(q, marker) & F.array_contains(t, marker)).cast("int")
    raw = F.when(F.col("_structured"), structured).otherwise(loose) - F.least(F.lit(0.36), unasked * F.lit(0.12))
    return prepared.withColumn("score", clamp(raw, 0.01, 0.99)).drop("_q", "_t", "_c", "_a", "_w", "_structured")


def top_results(scored: DataFrame, keep: int = 5) -> DataFrame:
    """Best results per query without repeated titles; ties keep search order.

    The repeat filter is a keep-first aggregate; the cut is the published top-k
    and is pushed below the exchange by the window group limit.
    """
    key = F.array_join(X.tokens(F.col("title")), "\x1f")
    keyed = scored.withColumn("_key", F.when(key == "", F.concat(F.lit("\x00"), F.col("search_index"))).otherwise(key)).withColumn(
        "_worse", -F.col("score")
    )
    unique = keep_first(keyed, ["query_id", "_key"], ["_worse", "search_index"])
    ranked = unique.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_worse", "search_index"))
    )
    return ranked.where(F.col("rank") <= keep).drop("_key", "_worse")


def preferred_lyrics(results: DataFrame) -> DataFrame:
    """One lyric record per query: timed ones first, then the closest duration, then the first.

    ``results``: query_id, audio_s (nullable), seq, duration_s, instrumental, has_synced, has_plain.
    """
    usable = results.where(~F.col("instrumental") & (F.col("has_synced") | F.col("has_plain")))
    untimed = (~F.col("has_synced")).cast("int")
    gap = F.coalesce(F.abs(F.col("duration_s") - F.col("audio_s")), F.lit(0.0))
    return keep_first(
        usable.withColumn("_u", untimed).withColumn("_g", gap), ["query_id"], ["_u", "_g", "seq"]
    ).drop("_u", "_g")


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """First candidate per batch and key, in input order."""
    keyed = candidates.withColumn("candidate_key", X.candidate_key(F.col("kind"), F.col("input")))
    return keep_first(keyed, ["batch_id", "candidate_key"], ["seq"])


def source_duplicates(incoming: DataFrame, tracks: DataFrame) -> DataFrame:
    """Incoming files whose path is the stored or the original path of a track."""
    known = tracks.select(F.col("source_path").alias("path")).unionByName(
        tracks.where(F.col("original_source_path").isNotNull()).select(F.col("original_source_path").alias("path"))
    )
    return incoming.join(known, "path", "left_semi")


def missing_media(tracks: DataFrame, listing: DataFrame) -> DataFrame:
    """Tracks whose media file is not in the storage listing (path)."""
    return tracks.join(listing.select(F.col("path").alias("source_path")), "source_path", "left_anti")


def playlist_reorder(tracks: DataFrame, moves: DataFrame) -> DataFrame:
    """Positions after moving one track of each project to a new index.

    ``tracks``: project_id, track_id, position (0-based, dense); ``moves``:
    project_id, track_id, new_index. Everything between the old and new place
    shifts by one, which needs no sort.
    """
    counts = tracks.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    moved = (
        moves.select("project_id", "track_id", "new_index").join(tracks.select("project_id", "track_id", "position"), ["project_id", "track_id"])
        .join(counts, "project_id")
        .select(
            "project_id", F.col("track_id").alias("_moved"), F.col("position").alias("_old"),
            F.least("new_index", F.col("_n") - 1).alias("_new"),
        )
    )
    p, old, new = F.col("position"), F.col("_old"), F.col("_new")
    place = (
        F.when(old.isNull(), p).when(F.col("track_id") == F.col("_moved"), new)
        .when((old < new) & (p > old) & (p <= new), p - 1).when((new < old) & (p >= new) & (p < old), p + 1).otherwise(p)
    )
    return tracks.join(moved, "project_id", "left").withColumn("position", place).drop("_moved", "_old", "_new")


def manifest_summary(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("track_count"), F.sum("duration_s").alias("total_duration_s"),
        F.sum("file_size_bytes").alias("total_bytes"), F.count("duration_s").alias("with_duration"),
    )


def dense_positions(tracks: DataFrame) -> DataFrame:
    return annotate(tracks, ["project_id"], ["position", "track_id"], ordinal="_p").withColumn("position", F.col("_p")).drop("_p")


def playable_format(path: Column) -> Column:
    return X.extension(path).isin(*V.CATALOGUE_FORMATS)


def droppable(path: Column) -> Column:
    return X.extension(path).isin(*V.DROPPABLE_FORMATS)
