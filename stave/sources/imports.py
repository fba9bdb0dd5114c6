"""Pasted text, chapter metadata and their clipping to a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stave.functions import text as X
from stave.functions.scalars import finite
from stave.functions.vocabulary import MAX_MARKERS
from stave.operators.timeline import annotate, keep_first
from stave.sources.lyrics import trimmed

MAX_FILE_BYTES = 1024 * 1024


def read_import_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files, one row each: batch_id (the path), text, and the error of one above 1 MiB, which is not read."""
    files = spark.read.format("binaryFile").load(path)
    named = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin("txt", "md")
    none = F.lit(None).cast("string")
    # the size tests are on file metadata, and the content of the large ones is not asked for
    small = files.where((F.col("length") <= MAX_FILE_BYTES) & named).select(F.col("path").alias("batch_id"), F.decode("content", "UTF-8").alias("text"), none.alias("error"))
    large = files.where((F.col("length") > MAX_FILE_BYTES) & named).select(F.col("path").alias("batch_id"), none.alias("text"), F.lit("larger than 1 MiB").alias("error"))
    return small.unionByName(large)


def parse_import_text(texts: DataFrame, listing: DataFrame) -> DataFrame:
    """Candidates of pasted texts (batch_id, text), deduplicated in input order.

    Every address in a line is a candidate; a line without any is a stored file
    (path in ``listing``) or, up to 180 bytes, a search.
    """
    # trimmed before they become rows, so that no filter on a line trims it again
    lines = texts.select("batch_id", F.posexplode(F.transform(F.split("text", r"\r?\n"), trimmed)).alias("line_no", "line")).where(F.col("line") != "")
    linked = F.col("line").contains("http://") | F.col("line").contains("https://")
    bared = F.transform(F.split("line", r"\s+"), lambda token: F.regexp_replace(token, r"""^[,;:()\[\]<>"']+|[,;:()\[\]<>"']+$""", ""))
    tokens = lines.where(linked).select("batch_id", "line_no", F.posexplode(bared).alias("token_no", "input"))
    urls = tokens.where(F.col("input").startswith("http://") | F.col("input").startswith("https://"))
    provider, listed = X.provider_of(F.col("input")), X.is_playlist(F.col("input"))
    remote = urls.select(
        "batch_id", "line_no", "token_no", "input", F.col("input").alias("title"),
        F.concat(provider, F.when(listed, " playlist").otherwise(" URL")).alias("detail"),
        F.when(listed, "playlist").otherwise("video").alias("kind"), F.lower(provider).alias("provider"), F.col("input").alias("source_url"),
    )
    bare = F.replace(F.regexp_replace("line", r"^(?:file://)+", ""), F.lit("\\@"), F.lit("@"))
    rooted = F.when(bare.startswith("localhost/"), F.concat(F.lit("/"), F.regexp_replace(bare, "^localhost/", ""))).otherwise(bare)
    decoded = F.try_url_decode(F.replace(rooted, F.lit("+"), F.lit("%2B")))
    known = listing.select(F.col("path").alias("_path")).distinct().withColumn("_known", F.lit(True))
    plain = lines.where(~linked).withColumn("_path", decoded).join(known, "_path", "left")
    stored = F.coalesce("_known", F.lit(False))
    local = plain.where(stored | (F.octet_length("line") <= 180)).select(
        "batch_id", "line_no", F.lit(0).alias("token_no"), F.col("line").alias("input"),
        F.when(stored, F.regexp_extract("_path", r"([^/]*)$", 1)).otherwise(F.col("line")).alias("title"),
        F.when(stored, "Local file").otherwise("YouTube search").alias("detail"), F.when(stored, "local").otherwise("search").alias("kind"),
        F.when(stored, "local").otherwise("youtube").alias("provider"), F.lit(None).cast("string").alias("source_url"),
    )
    keyed = remote.unionByName(local).withColumn("candidate_key", X.candidate_key(F.col("kind"), F.col("input")))
    return keep_first(keyed, ["batch_id", "candidate_key"], ["line_no", "token_no"]).withColumn("blocked", F.lit(False))


CHAPTERS = "struct<chapters: array<struct<title: string, start_time: double, end_time: double>>>"


def chapters_to_markers(infos: DataFrame) -> DataFrame:
    """Markers from chapter metadata (track_id, json); the first 512 valid chapters in order."""
    parsed = infos.select("track_id", F.posexplode(F.from_json("json", CHAPTERS)["chapters"]).alias("seq", "c"))
    label = trimmed(F.coalesce("c.title", F.lit("")))
    valid = parsed.select(
        "track_id", "seq", label.alias("label"), F.col("c.start_time").alias("start_s"),
        F.when(finite(F.col("c.end_time")) & (F.col("c.end_time") > F.col("c.start_time")), F.col("c.end_time")).alias("end_s"),
    ).where(
        finite(F.col("start_s")) & (F.col("start_s") >= 0) & F.char_length("label").between(1, 120)
        & ~F.col("label").rlike(r"[\x00-\x1f\x7f-\x9f]")
    )
    # the cut is the lane's contract
    ranked = annotate(valid, ["track_id"], ["seq"], ordinal="_n").where(F.col("_n") < MAX_MARKERS).drop("_n")
    return ranked.withColumn("origin", F.lit("source"))


def clip_markers_to_track(markers: DataFrame, tracks: DataFrame) -> DataFrame:
    """Drop markers from the track's end on and cut ends to it; an end not after the start is dropped."""
    spans = tracks.select("track_id", F.col("duration_s").alias("_d"))
    end = F.when(F.col("_d").isNull(), F.col("end_s")).otherwise(
        F.when(F.least("end_s", "_d") > F.col("start_s"), F.when(F.col("end_s").isNotNull(), F.least("end_s", "_d")))
    )
    return markers.join(spans, "track_id").where(F.col("_d").isNull() | (F.col("start_s") < F.col("_d"))).withColumn(
        "end_s", end
    ).drop("_d")
