"""Search results and playlist entries as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stave.functions import text as X
from stave.operators.timeline import keep_first

# Explicit schema of the compacted rows; absent keys read as null.
ROW = (
    "id string, title string, track string, channel string, uploader string, artist string, creator string, "
    "album_artist string, view_count bigint, channel_is_verified boolean, webpage_url string, url string, format_id string"
)
_ID = r"^[A-Za-z0-9_-]{1,64}$"


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "json")


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _parsed(rows: DataFrame) -> DataFrame:
    """The rows with their JSON as ``row``; exploded, so that it is parsed once and not again in each filter on its fields."""
    return rows.select("*", F.explode(F.array(F.from_json("json", ROW))).alias("row"))


def _channel() -> Column:
    return F.coalesce("row.channel", "row.uploader", "row.artist", "row.creator", "row.album_artist")


def scan_search_results(rows: DataFrame) -> DataFrame:
    """Typed candidates from search rows (query_id, query, search_index, provider, json).

    Rows without a usable id, title or channel are left out.
    """
    parsed = _parsed(rows).where(F.col("row.id").rlike(_ID))
    title = _filled(F.coalesce("row.title", "row.track"))
    channel = _filled(_channel())
    typed = parsed.select(
        "query_id", "query", "search_index", "provider", F.col("row.id").alias("id"), F.left(title, F.lit(256)).alias("title"),
        F.left(channel, F.lit(160)).alias("channel"), F.col("row.view_count").alias("views"),
        F.coalesce("row.channel_is_verified", F.lit(False)).alias("verified"),
        F.coalesce("row.webpage_url", "row.url").alias("link"),
    ).where(F.col("title").isNotNull() & F.col("channel").isNotNull())
    suffix = F.concat(F.lit(" ["), F.col("id"), F.lit("]"))
    cut = F.when(
        F.col("title").endswith(suffix), F.left("title", F.char_length("title") - F.char_length(suffix))
    ).otherwise(F.col("title"))
    video = F.col("provider") == "youtube"
    return typed.select(
        "query_id", "query", "search_index", "provider", "id", F.trim(cut).alias("title"), "channel", "views", "verified",
        F.when(video, F.concat(F.lit("https://www.youtube.com/watch?v="), "id")).otherwise(F.col("link")).alias("source_url"),
    ).where(video | (X.provider_of(F.col("source_url")) == "SoundCloud"))


def scan_playlist_entries(rows: DataFrame) -> DataFrame:
    """Candidates from playlist rows (playlist_url, seq, json), each source address once."""
    parsed = _parsed(rows).withColumn("provider", X.provider_of(F.col("playlist_url")))
    video = F.col("provider") == "YouTube"
    link = F.coalesce("row.webpage_url", "row.url")
    address = F.when(
        video, F.when(F.col("row.id").rlike(_ID), F.concat(F.lit("https://www.youtube.com/watch?v="), "row.id"))
    ).otherwise(F.when(X.provider_of(link) == F.col("provider"), link))
    title = F.coalesce(
        F.left(_filled(F.coalesce("row.title", "row.track")), F.lit(256)), F.when(video, F.col("row.id")),
        F.concat("provider", F.lit(" track")),
    )
    made = parsed.select(
        "playlist_url", "seq", address.alias("source_url"), title.alias("title"),
        F.left(F.coalesce(_channel(), "provider"), F.lit(160)).alias("detail"), F.lower("provider").alias("provider"),
        (~video & (F.coalesce("row.format_id", F.lit("")) == "")).alias("blocked"),
    ).where(F.col("source_url").isNotNull())
    return keep_first(made, ["playlist_url", "source_url"], ["seq"])
