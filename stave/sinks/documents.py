"""Exports as ordered document lines.

A document is a table of (document, line_no, line) rows, never one string built
in one task: lines are made where their rows are, and the writer range-sorts
them, so even a document with a third of all lines is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.functions.music import compact_to_harte
from stave.functions.scalars import clock_short, lrc_time
from stave.operators.timeline import annotate


def _text(value: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def export_playlist(projects: DataFrame, tracks: DataFrame, form: str = "json") -> DataFrame:
    """Playlist of each project (project_id, name) as JSON or a Markdown table."""
    ordered = annotate(tracks, ["project_id"], ["position", "track_id"], ordinal="_i", lead={"_more": F.lit(1)})
    if form == "json":
        head = projects.select("project_id", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit('{"project":'), _text(F.col("name")), F.lit(',"tracks":[')).alias("line"))
        row = F.concat(
            F.lit('{"position":'), (F.col("_i") + 1).cast("string"), F.lit(',"title":'), _text(F.col("title")),
            F.lit(',"durationSeconds":'), _number(F.col("duration_s")), F.lit("}"), F.when(F.col("_more").isNotNull(), ",").otherwise(""),
        )
        body = ordered.select("project_id", (F.col("_i") + 1).alias("line_no"), row.alias("line"))
        tail = projects.select("project_id", F.lit((1 << 62)).cast("bigint").alias("line_no"), F.lit("]}").alias("line"))
        return head.unionByName(body).unionByName(tail)
    if form != "markdown":
        raise ValueError(f"unsupported playlist format {form}")
    rule = ["", "| # | Song | Duration | Notes |", "|---:|---|---:|---|"]
    head = projects.select(
        "project_id", F.posexplode(F.array(F.concat(F.lit("# "), "name"), *[F.lit(r) for r in rule])).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no").cast("bigint"))
    title = F.replace(F.replace("title", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(
        F.lit("| "), (F.col("_i") + 1).cast("string"), F.lit(" | "), title, F.lit(" | "), F.coalesce(clock_short(F.col("duration_s")), F.lit("")), F.lit(" |  |")
    )
    return head.unionByName(ordered.select("project_id", (F.col("_i") + 4).alias("line_no"), row.alias("line")))


def export_segments(chords: DataFrame) -> DataFrame:
    """Chord segments in annotation form: time, duration, Harte value, confidence."""
    return chords.select(
        "track_id", "mode", "idx", F.col("start_s").alias("time"), F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")).alias("duration"),
        compact_to_harte(F.coalesce("source_label", "label")).alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "strength")).alias("confidence"),
    )


def export_jams(chords: DataFrame, tracks: DataFrame, curator: str = "stave") -> DataFrame:
    """JAMS 0.3.5 chord annotation per (track, mode)."""
    keys = ["track_id", "mode"]
    ordered = annotate(export_segments(chords), keys, ["time", "idx"], ordinal="_i", lead={"_more": F.lit(1)})
    row = F.concat(
        F.lit('{"time":'), _number(F.col("time")), F.lit(',"duration":'), _number(F.col("duration")), F.lit(',"value":'), _text(F.col("value")),
        F.lit(',"confidence":'), _number(F.col("confidence")), F.lit("}"), F.when(F.col("_more").isNotNull(), ",").otherwise(""),
    )
    body = ordered.select(*keys, (F.col("_i") + 1).alias("line_no"), row.alias("line"))
    documents = chords.select(*keys).distinct().join(tracks.select("track_id", "title", "duration_s"), "track_id")
    head = F.concat(
        F.lit('{"jams_version":"0.3.5","file_metadata":{"title":'), _text(F.col("title")), F.lit(',"artist":"","release":"","duration":'),
        _number(F.col("duration_s")), F.lit(',"identifiers":{}},"annotations":[{"namespace":"chord","annotation_metadata":{"curator":{"name":"'
        + curator + '","email":""},"annotator":{},"version":"1","corpus":"","annotation_tools":"' + curator
        + '","annotation_rules":"","validation":"","data_source":"automatic"},"data":['),
    )
    tail = F.concat(F.lit('],"sandbox":{"chord_mode":'), _text(F.col("mode")), F.lit('}}],"sandbox":{}}'))
    first = documents.select(*keys, F.lit(0).cast("bigint").alias("line_no"), head.alias("line"))
    last = documents.select(*keys, F.lit(1 << 62).cast("bigint").alias("line_no"), tail.alias("line"))
    return first.unionByName(body).unionByName(last)


def export_lrc(docs: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """LRC documents: an offset header where there is one, then every line."""
    tagged = F.concat(F.lit("<"), lrc_time(F.col("start_ms")), F.lit(">"), F.col("text"))
    # words per line are bounded by the line's own text
    spoken = words.groupBy("track_id", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", tagged.alias("w")))), lambda s: s["w"]), "").alias("_words")
    )
    body = lines.join(spoken, ["track_id", "line_no"], "left")
    line = F.when(F.col("start_ms").isNull(), F.col("text")).otherwise(
        F.concat(F.lit("["), lrc_time(F.col("start_ms")), F.lit("]"), F.coalesce("_words", "text"))
    )
    head = docs.where(F.col("offset_ms") != 0).select(
        "track_id", F.lit(0).cast("bigint").alias("line_no"), F.concat(F.lit("[offset:"), F.col("offset_ms").cast("string"), F.lit("]")).alias("line"))
    return head.unionByName(body.select("track_id", (F.col("line_no") + 1).alias("line_no"), line.alias("line")))


def export_lyrics_markdown(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Markdown lyrics: a title (``docs.title``), then every line with a hard break."""
    head = docs.select("track_id", F.posexplode(F.array(F.concat(F.lit("# "), F.trim("title")), F.lit(""))).alias("line_no", "line"))
    last = lines.groupBy("track_id").agg(F.max("line_no").alias("_last"))
    body = lines.join(last, "track_id").select(
        "track_id", (F.col("line_no") + 2).alias("line_no"), F.concat("text", F.when(F.col("line_no") < F.col("_last"), "  ").otherwise("")).alias("line"))
    return head.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(body)


def write_documents(lines: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Write line tables as one folder of text parts per document; parts in name order make the document."""
    order = [*keys, "line_no"]
    ranged = lines.repartitionByRange(partitions, *order) if partitions else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(*keys, "line").write.mode("overwrite").partitionBy(*keys).text(path)
