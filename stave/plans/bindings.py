"""The driver's tables bound to the catalogue model, for both engines.

Every property of :class:`Tables` derives one catalogue table from the given
parquet files with Spark and writes it once per session to the shared folder, as
a catalogue would hold it; queries then read it back with pushdown and pruning.
Joins with tables that grow are merge joins: their packed files seem small enough for
a broadcast long before their rows fit the driver.
The ``view`` beside it is the same derivation in SQL, used by the oracles only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from stave.functions.scalars import lrc_time
from stave.operators.timeline import annotate
from stave.plans.registry import view
from stave.session import new_dir, shared_dir

_written: set[str] = set()
#: Rows of a file that lands, at most.
LANDED_ROWS = 2_000_000
#: Lyric files that a task makes and parses, on the average.
TASK_TEXTS = 2_000


class Tables:
    """Catalogue tables derived from one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        tag = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]
        return f"{shared_dir(self.spark)}/{tag}/{name}"

    def stored(self, name: str, build, spread: bool = False) -> DataFrame:
        """The table, written when first asked for; ``spread`` deals it evenly over files, whose number follows its size."""
        path = self.path(name)
        if path not in _written:
            made = build()
            if spread:
                made = made.hint("rebalance")
            made.write.mode("overwrite").parquet(path)
            _written.add(path)
        return self.spark.read.parquet(path)

    def landed(self, name: str, df: DataFrame, axis: str, parts: int = 5) -> str:
        """A table as files that have arrived one after another in the order of ``axis``, each part after the one before.

        The number of parts, and so of files and micro-batches, grows with the rows, so that none
        holds more than some ``LANDED_ROWS``, unless more share one moment.
        """
        path = self.path(f"{name}_landed")
        if path not in _written:
            at = F.col(axis).cast("double")
            parts = max(parts, -(-df.count() // LANDED_ROWS))
            cuts = df.agg(F.percentile_approx(at, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
            cuts = sorted(set(cuts))
            part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < at)) if cuts else F.lit(0)
            dealt = new_dir(self.spark, f"{name}-parts")
            # dealt in one pass, so that no part reads the rows of the others
            df.withColumn("_part", part).write.partitionBy("_part").parquet(dealt)
            whole = StructType([*df.schema.fields, StructField("_part", IntegerType())])
            rows = self.spark.read.schema(whole).parquet(dealt)
            for i in range(len(cuts) + 1):
                rows.where(F.col("_part") == i).drop("_part").repartition(1).write.mode("append" if i else "overwrite").parquet(path)
            _written.add(path)
        return path

    # -- timelines -------------------------------------------------------

    @property
    def events(self) -> DataFrame:
        def build():
            events = self.source("events")
            us = F.unix_micros(F.col("ts").cast("timestamp"))
            # one origin per user: a partial aggregate, joined back
            origin = events.groupBy("user_id").agg(F.min(us).alias("origin_us"))
            return (
                events.join(origin, "user_id")
                .withColumn("abs_us", us)
                .select(
                    "event_id", F.concat(F.lit("t"), "user_id").alias("track_id"), "user_id", "event_type", "value",
                    "abs_us", F.floor((F.col("abs_us") - F.col("origin_us")) / 40000).alias("beat_us"),
                )
            )

        return self.stored("events", build)

    @property
    def beats(self) -> DataFrame:
        def build():
            events = self.events
            shape = lambda df, name: annotate(
                df, ["track_id"], ["beat_us", "event_id"], ordinal="beat_idx"
            ).select(
                "track_id", F.lit(name).alias("source"), "beat_idx", "beat_us",
                (F.col("beat_us") / 1e6).alias("beat_s"), (F.col("event_type") == "purchase").alias("is_downbeat"),
                "event_id",
            )
            return shape(events, "raw").unionByName(shape(events.where("event_type <> 'error'"), "dbn"))

        return self.stored("beats", build)

    @property
    def raw(self) -> DataFrame:
        return self.beats.where("source = 'raw'").drop("source")

    @property
    def grid(self) -> DataFrame:
        def build():
            i = F.col("beat_idx")
            even = 500000 * F.least(i, F.lit(19))
            dense = 250000 * F.greatest(F.lit(0), F.least(i - 19, F.lit(12)))
            sparse = 1000000 * F.greatest(F.lit(0), F.least(i - 31, F.lit(8)))
            rest = 500000 * F.greatest(F.lit(0), i - 39)
            jitter = (F.pmod("event_id", F.lit(7)) - 3) * 1000 + 10000
            return self.raw.select(
                "track_id", "beat_idx", (even + dense + sparse + rest + jitter).cast("bigint").alias("beat_us"),
                "is_downbeat",
            ).withColumn("beat_s", F.col("beat_us") / 1e6)

        return self.stored("grid", build)

    @property
    def intervals(self) -> DataFrame:
        from stave.operators.rhythm import distinct_beats, with_intervals

        return self.stored("intervals", lambda: with_intervals(distinct_beats(self.grid)))

    @property
    def tracks(self) -> DataFrame:
        def build():
            spans = self.events.groupBy("user_id", "track_id").agg((F.max("beat_us") + 1000000).alias("duration_us"))
            parts = self.source("part").select(F.col("p_partkey").alias("user_id"), "p_name")
            fmt = F.element_at(F.array(*[F.lit(x) for x in ("wav", "mp3", "flac", "ogg")]), (F.col("user_id") % 4 + 1).cast("int"))
            name = F.coalesce("p_name", F.lit("untitled"))
            uid = F.col("user_id").cast("string")
            return spans.join(parts.hint("merge"), "user_id", "left").select(
                "track_id", F.concat(F.lit("p"), F.floor(F.col("user_id") / 25)).alias("project_id"),
                (F.col("user_id") % 25).alias("position"), F.concat(name, F.lit(" "), uid).alias("title"),
                F.concat(F.lit("/music/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("/"), uid, F.lit("."), fmt).alias("source_path"),
                F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("/orig/"), uid, F.lit("."), fmt)).alias("original_source_path"),
                fmt.alias("format"), (F.lit(1000000) + F.col("user_id") * 977).alias("file_size_bytes"),
                "duration_us", (F.col("duration_us") / 1e6).alias("duration_s"),
                F.lit(44100).alias("sample_rate"), (F.col("user_id") % 2 + 1).cast("int").alias("channels"), "user_id",
            )

        return self.stored("tracks", build)

    @property
    def chords(self) -> DataFrame:
        def build():
            ends = self.tracks.select("track_id", "duration_us")
            roots = F.array(*[F.lit(x) for x in ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")])
            root = F.element_at(roots, (F.col("event_id") % 12 + 1).cast("int"))
            kind = F.col("event_type")
            label = (
                F.when(kind == "view", F.concat(root, F.lit(":maj"))).when(kind == "click", F.concat(root, F.lit(":7")))
                .when(kind == "purchase", F.concat(root, F.lit(":min"))).when(kind == "signup", F.concat(root, F.lit(":min7/b3")))
                .otherwise("N")
            )
            slack = F.when(F.col("event_id") % 5 == 0, 600).when(F.col("event_id") % 5 == 1, 5000).otherwise(0)
            ordered = annotate(
                self.events, ["track_id"], ["beat_us", "event_id"], ordinal="idx", lead={"next_us": F.col("beat_us")}
            )
            return (
                ordered.join(ends, "track_id")
                .withColumn("end_us", F.coalesce(F.col("next_us") + slack, "duration_us").cast("bigint"))
                .select(
                    "track_id", F.lit("standard").alias("mode"), "idx", label.alias("source_label"),
                    F.col("beat_us").alias("start_us"), "end_us", (F.col("beat_us") / 1e6).alias("start_s"),
                    (F.col("end_us") / 1e6).alias("end_s"), F.least(F.col("value") / 500, F.lit(1.0)).alias("strength"),
                    "event_id", "event_type",
                )
            )

        return self.stored("chords", build)

    @property
    def markers(self) -> DataFrame:
        def build():
            end = F.when(F.col("event_id") % 2 == 1, F.col("beat_us") + 500000)
            origin = F.element_at(F.array(F.lit("source"), F.lit("detected"), F.lit("user")), (F.col("event_id") % 3 + 1).cast("int"))
            return self.events.where("event_type = 'signup'").select(
                "track_id", F.concat(F.lit("m"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("marker_id"),
                F.concat(F.lit("Part "), F.col("event_id") % 7).alias("label"), F.col("beat_us").alias("start_us"),
                end.alias("end_us"), (F.col("beat_us") / 1e6).alias("start_s"), (end / 1e6).alias("end_s"), origin.alias("origin"),
            )

        return self.stored("markers", build)

    @property
    def positions(self) -> DataFrame:
        return self.events.where("event_type = 'click'").select(
            "track_id", F.col("event_id").alias("query_id"), (F.col("beat_us") + 13000).alias("t_us"),
            ((F.col("beat_us") + 13000) / 1e6).alias("t_s"),
        )

    @property
    def edits(self) -> DataFrame:
        base = self.chords.where("event_type = 'click'")
        shape = ["track_id", "mode", "start_s", "end_s"]
        first = base.select(*shape, F.lit("F#m7").alias("label"), F.col("event_id").alias("edit_seq"))
        second = base.where("event_id % 2 = 0").select(
            *shape, F.lit("Bb").alias("label"), (F.col("event_id") + 1000000000).alias("edit_seq")
        )
        return first.unionByName(second)

    # -- catalogue -------------------------------------------------------

    @property
    def search_rows(self) -> DataFrame:
        """Ten result rows per query, as the search worker's JSON lines."""
        def build():
            parts = self.source("part")
            total = parts.count()
            queries = parts.select(
                F.col("p_partkey").alias("query_id"),
                F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
                .when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(" - "), "p_name"))
                .otherwise(F.concat("p_name", F.lit(" live"))).alias("query"),
                F.explode(F.sequence(F.lit(0), F.lit(9))).alias("search_index"),
            ).withColumn("r", (F.col("query_id") * 7 + F.col("search_index")) % F.lit(total))
            r = F.col("r")
            rid = F.when(r % 17 == 0, F.concat(F.lit("id "), r)).otherwise(F.concat(F.lit("id_"), r))
            title = (
                F.when(r % 19 == 0, F.lit("   ")).when(r % 4 == 0, F.col("p_name"))
                .when(r % 4 == 1, F.concat("p_name", F.lit(" (Official Video)")))
                .when(r % 4 == 2, F.concat(F.upper("p_name"), F.lit(" ["), rid, F.lit("]")))
                .otherwise(F.concat("p_name", F.lit(" cover")))
            )
            channel = F.when(r % 5 == 0, F.concat("p_brand", F.lit(" Official"))).otherwise(F.col("p_brand"))
            row = F.struct(
                rid.alias("id"), F.when(r % 23 != 0, title).alias("title"), F.when(r % 23 == 0, F.col("p_name")).alias("track"),
                F.when((r % 29 != 0) & (r % 7 != 0), channel).alias("channel"), F.when((r % 29 != 0) & (r % 7 == 0), channel).alias("uploader"),
                F.floor(F.col("p_retailprice") * 1000).cast("bigint").alias("view_count"), (F.col("p_size") % 2 == 0).alias("channel_is_verified"),
            )
            return queries.join(parts.hint("merge"), F.col("r") == F.col("p_partkey")).select(
                "query_id", "query", "search_index", F.lit("youtube").alias("provider"), F.to_json(row).alias("json")
            )

        return self.stored("search_rows", build, spread=True)

    @property
    def lyric_results(self) -> DataFrame:
        def build():
            parts = self.source("part")
            total = parts.count()
            queries = parts.select(
                F.col("p_partkey").alias("query_id"),
                F.when(F.col("p_partkey") % 10 != 0, (100 + F.col("p_partkey") % 200).cast("double")).alias("audio_s"),
                F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"),
            ).withColumn("r", (F.col("query_id") * 5 + F.col("seq")) % F.lit(total))
            return queries.join(parts.hint("merge"), F.col("r") == F.col("p_partkey")).select(
                "query_id", "audio_s", "seq", F.col("r").alias("id"), F.col("p_name").alias("track_name"),
                (F.col("p_size") * 7 + 90).cast("double").alias("duration_s"), (F.col("r") % 6 == 0).alias("instrumental"),
                (F.col("r") % 2 == 0).alias("has_synced"), (F.col("r") % 3 == 0).alias("has_plain"),
            )

        return self.stored("lyric_results", build)

    @property
    def import_texts(self) -> DataFrame:
        """Pasted texts: every document, and every page address in prose."""
        return self.stored("import_texts", self._import_texts, spread=True)

    def _import_texts(self) -> DataFrame:
        docs = self.source("documents")
        half = F.floor(F.col("doc_id") / 2).cast("string")
        from_docs = docs.select(
            F.concat(F.lit("d"), "doc_id").alias("batch_id"),
            F.concat(
                "text", F.lit("\nhttps://youtu.be/v"), half, F.lit(" https://www.youtube.com/watch?v=v"), half,
                F.lit("&t=3\nhttps://WWW.Example.com/Album/"), half, F.lit("/#top"),
            ).alias("text"),
        )
        pages = self.source("pages")
        song = (F.col("page_id") % 50).cast("string")
        from_pages = pages.select(
            F.concat(F.lit("g"), "page_id").alias("batch_id"),
            F.concat(
                F.lit("see ("), "url", F.lit("), https://soundcloud.com/a/sets/"), F.col("page_id").cast("string"),
                F.lit("\nfile:///music/Track%20"), song, F.lit(".mp3\n  file:///MUSIC/track%20"), song, F.lit(".MP3 "),
            ).alias("text"),
        )
        return from_docs.unionByName(from_pages)

    @property
    def storage(self) -> DataFrame:
        """Listing of stored files."""
        return self.source("pages").select(
            F.concat(F.lit("/music/Track "), F.col("page_id") % 50, F.lit(".mp3")).alias("path")
        ).distinct()

    # -- lyrics ----------------------------------------------------------

    @property
    def lyric_texts(self) -> DataFrame:
        """Documents as lyric files: plain, line-tagged or word-tagged.

        Not stored: a text is made where it is read, of documents dealt evenly over tasks, whose number follows theirs.
        """
        kind = F.col("doc_id") % 3
        lines = F.split("text", "\n")

        def plain(line, i):
            return line

        def tagged(line, i):
            at = i * 2500
            twice = F.when(i % 7 == 3, F.concat(F.lit("["), lrc_time(at + 1000), F.lit("]"))).otherwise("")
            return F.concat(F.lit("["), lrc_time(at), F.lit("]"), twice, line)

        def worded(line, i):
            words = F.transform(
                F.split(line, " "),
                lambda w, j: F.concat(F.lit("<"), lrc_time(i * 2500 + j * 150), F.lit(">"), w, F.lit(" ")),
            )
            return F.concat(F.lit("["), lrc_time(i * 2500), F.lit("]"), F.array_join(words, ""))

        made = (
            F.when(kind == 0, F.transform(lines, plain)).when(kind == 1, F.transform(lines, tagged))
            .otherwise(F.transform(lines, worded))
        )
        docs = self.source("documents").select("doc_id", "text")
        tasks = max(1, -(-docs.count() // TASK_TEXTS))
        return docs.repartition(tasks, F.xxhash64("doc_id", "text")).select(self._lyric_id, F.array_join(made, "\n").alias("text"), *self._lyric_times)

    @property
    def lyric_heads(self) -> DataFrame:
        """Lyric files without their texts."""
        return self.source("documents").select(self._lyric_id, *self._lyric_times)

    @property
    def _lyric_id(self) -> Column:
        return F.concat(F.lit("d"), "doc_id").alias("track_id")

    @property
    def _lyric_times(self) -> list[Column]:
        n_lines = F.size(F.split("text", "\n"))
        return [((F.col("doc_id") % 5 - 2) * 100).alias("offset_ms"), (n_lines * 2500 + 5000).cast("bigint").alias("duration_ms")]

    @property
    def lyric_parsed(self) -> DataFrame:
        from stave.sources.lyrics import parse_lrc_rows

        return self.stored("lyric_parsed", lambda: parse_lrc_rows(self.lyric_texts, self.lyric_heads))

    @property
    def lyric_lines(self) -> DataFrame:
        return self.lyric_parsed.drop("words")

    @property
    def lyric_words(self) -> DataFrame:
        from stave.sources.lyrics import lyric_words

        return lyric_words(self.lyric_parsed)

    @property
    def lyric_docs(self) -> DataFrame:
        from stave.operators.lyrics import sync_levels

        def build():
            levels = sync_levels(self.lyric_lines, self.lyric_parsed.where(F.size("words") > 0))
            return self.lyric_heads.join(levels.hint("merge"), "track_id")

        return self.stored("lyric_docs", build)

    @property
    def lyric_positions(self) -> DataFrame:
        return self.lyric_heads.select(
            "track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_ms") / 2500).cast("int") - 3)).alias("query_id")
        ).withColumn("now_ms", (F.col("query_id") * 2500 + 1234).cast("bigint"))

    # -- telemetry -------------------------------------------------------

    @property
    def logs(self) -> DataFrame:
        def build():
            kind = F.col("event_type")
            level = (
                F.when(kind == "error", "ERROR").when(kind == "click", "WARN").when(kind == "view", "DEBUG")
                .when(kind == "signup", "TRACE").otherwise("INFO")
            )
            origin = F.element_at(F.array(F.lit("rust"), F.lit("mlx"), F.lit("webview")), (F.col("user_id") % 3 + 1).cast("int"))
            return self.events.select(
                "event_id", F.timestamp_micros("abs_us").alias("ts"), F.floor(F.col("abs_us") / 1000).alias("ts_ms"),
                origin.alias("origin"), F.concat(F.lit("  at "), level, F.lit(" track "), "track_id", F.lit(" ")).alias("line"),
            )

        return self.stored("logs", build, spread=True)

    @property
    def jobs(self) -> DataFrame:
        def build():
            kind = F.col("event_type")
            state = (
                F.when(kind == "view", "queued").when(kind == "click", "importing").when(kind == "error", "failed")
                .otherwise("completed")
            )
            return self.events.select(
                "event_id", F.timestamp_micros("abs_us").alias("ts"), F.col("track_id").alias("batch_id"), F.lit(4).alias("expected"),
                F.concat("track_id", F.lit("-"), F.col("event_id") % 4).alias("job_id"), state.alias("state"),
                (F.col("value") / 500).alias("progress"),
            )

        return self.stored("jobs", build, spread=True)

    @property
    def progress(self) -> DataFrame:
        def build():
            stages = F.array(*[F.lit(x) for x in (
                "checkingCache", "loadingModel", "loadingAudio", "separating", "writingStems", "validatingStems", "cachingStems")])
            rows = self.raw.join(self.tracks.select("track_id", "user_id", "duration_s"), "track_id")
            return rows.select(
                F.col("track_id").alias("job_id"), F.floor(F.col("beat_us") / 1000).alias("ts_ms"), F.col("beat_idx").alias("seq"),
                F.when(F.col("user_id") % 2 == 0, "fast").otherwise("hq").alias("profile"), "duration_s",
                F.element_at(stages, (F.least(F.lit(6), F.floor(F.col("beat_idx") / 10)) + 1).cast("int")).alias("stage"),
                ((F.col("beat_idx") % 10) * 2).alias("completed"), F.when(F.col("event_id") % 9 != 0, F.lit(20).cast("bigint")).alias("total"),
            )

        return self.stored("progress", build, spread=True)

    @property
    def levels(self) -> DataFrame:
        def build():
            left = F.least(F.col("value") / 500, F.lit(1.0))
            return self.events.select(
                "track_id", "event_id", F.floor(F.col("beat_us") / 1000).alias("ts_ms"), left.alias("left"), (1 - left).alias("right")
            )

        return self.stored("levels", build, spread=True)

    @property
    def metrics(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.select(
            "event_id", F.col("track_id").alias("host"), F.when(kind != "error", F.col("value") / 4).alias("cpu"),
            F.when(kind != "view", F.col("value") / 5).alias("gpu"), F.when(~kind.isin("error", "click"), F.col("value") / 6 - 5).alias("memory"),
        )

    # -- signal ----------------------------------------------------------

    @property
    def blocks(self) -> DataFrame:
        """Mono blocks of 64 frames at 4 kHz; one track per label."""
        def build():
            vectors = self.source("embeddings").select("vec_id", "label", "embedding")
            ordered = annotate(vectors, ["label"], ["vec_id"], ordinal="block_no")
            return ordered.select(
                F.concat(F.lit("a"), "label").alias("track_id"), F.lit(0).alias("channel"), "block_no",
                (F.col("block_no") * 64).alias("first_frame"), F.lit(4000).alias("sample_rate"), F.col("embedding").alias("samples"), "vec_id",
            )

        return self.stored("blocks", build, spread=True)

    @property
    def stereo(self) -> DataFrame:
        """The same blocks with a second, inverted and quieter channel."""
        second = self.blocks.withColumn("channel", F.lit(1)).withColumn(
            "samples", F.transform("samples", lambda x: (x * F.lit(-0.5)).cast("float"))
        )
        return self.blocks.unionByName(second)

    @property
    def stems(self) -> DataFrame:
        """Four stems per track: every fourth vector, in order."""
        def build():
            vectors = self.source("embeddings").select(
                F.concat(F.lit("a"), "label").alias("track_id"), (F.col("vec_id") % 4).cast("int").alias("stem"), "vec_id", "embedding"
            )
            ordered = annotate(vectors, ["track_id", "stem"], ["vec_id"], ordinal="block_no")
            return ordered.select("track_id", "stem", F.lit(0).alias("channel"), "block_no", F.col("embedding").alias("samples"))

        return self.stored("stems", build)

    @property
    def stem_mix(self) -> DataFrame:
        """Four stem settings per track of the timeline catalogue and of the block catalogue."""
        def build():
            users = self.tracks.select("track_id", "user_id")
            audio = self.source("embeddings").select(
                F.concat(F.lit("a"), "label").alias("track_id"), F.col("label").cast("bigint").alias("user_id")).distinct()
            i, u = F.col("stem"), F.col("user_id")
            return users.unionByName(audio).withColumn("stem", F.explode(F.array(*[F.lit(n) for n in range(4)]))).select(
                "track_id", "stem", ((u + i) % 5 / 4).alias("gain"), ((u * 3 + i) % 9 / 4 - 1).alias("pan"),
                ((u + i) % 7 == 0).alias("muted"), ((u % 3 == 0) & (i == u % 4)).alias("soloed"),
            )

        return self.stored("stem_mix", build)

    @property
    def fingerprints(self) -> DataFrame:
        """Sign-bit codes of the blocks; each track again with one bit flipped per item."""
        def build():
            bits = [F.when(F.col("samples")[2 * i] > F.col("samples")[2 * i + 1], F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
            code = sum(bits[1:], bits[0]).cast("bigint")
            # a fingerprint covers at most 64 items, so the list per track is bounded
            items = self.blocks.select(
                F.concat("track_id", F.lit("-"), F.floor(F.col("block_no") / 64)).alias("track_id"),
                (F.col("block_no") % 64).alias("block_no"), code.alias("code"),
            )
            flipped = F.col("code").bitwiseXOR(F.expr("shiftleft(1L, cast(block_no % 32 AS int))"))
            both = items.select("track_id", "block_no", "code").unionByName(
                items.select(F.concat("track_id", F.lit("x")).alias("track_id"), "block_no", flipped.alias("code")))
            return both.groupBy("track_id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("block_no", "code"))), lambda s: s["code"]).alias("values")
            ).select("track_id", F.lit(2).alias("version"), (F.size("values") * 0.1238).alias("duration_s"), "values")

        return self.stored("fingerprints", build)


view("v_ev", """
SELECT event_id, 't' || user_id AS track_id, user_id, event_type, value, epoch_us(ts) AS abs_us,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 40000 AS beat_us FROM events""")
view("v_beats", """
SELECT track_id, 'raw' AS source, row_number() OVER (PARTITION BY track_id ORDER BY beat_us, event_id) - 1 AS beat_idx,
  beat_us, beat_us / 1e6 AS beat_s, event_type = 'purchase' AS is_downbeat, event_id FROM v_ev
UNION ALL
SELECT track_id, 'dbn', row_number() OVER (PARTITION BY track_id ORDER BY beat_us, event_id) - 1,
  beat_us, beat_us / 1e6, event_type = 'purchase', event_id FROM v_ev WHERE event_type <> 'error'""")
view("v_raw", "SELECT * EXCLUDE (source) FROM v_beats WHERE source = 'raw'")
view("v_grid", """
SELECT *, beat_us / 1e6 AS beat_s FROM (SELECT track_id, beat_idx, 500000 * least(beat_idx, 19)
  + 250000 * greatest(0, least(beat_idx - 19, 12)) + 1000000 * greatest(0, least(beat_idx - 31, 8))
  + 500000 * greatest(0, beat_idx - 39) + (event_id % 7 - 3) * 1000 + 10000 AS beat_us, is_downbeat FROM v_raw)""")
view("v_tracks", """
SELECT track_id, 'p' || (user_id // 25) AS project_id, user_id % 25 AS position,
  coalesce(p_name, 'untitled') || ' ' || user_id AS title,
  '/music/' || replace(coalesce(p_name, 'untitled'), ' ', '_') || '/' || user_id || '.' || fmt AS source_path,
  CASE WHEN user_id % 3 = 0 THEN '/orig/' || user_id || '.' || fmt END AS original_source_path,
  fmt AS format, 1000000 + user_id * 977 AS file_size_bytes, duration_us, duration_us / 1e6 AS duration_s,
  44100 AS sample_rate, user_id % 2 + 1 AS channels, user_id
FROM (SELECT user_id, track_id, max(beat_us) + 1000000 AS duration_us, ['wav','mp3','flac','ogg'][user_id % 4 + 1] AS fmt
  FROM v_ev GROUP BY ALL) LEFT JOIN part ON p_partkey = user_id""")
view("v_chords", """
SELECT track_id, 'standard' AS mode, idx, CASE event_type WHEN 'view' THEN root || ':maj' WHEN 'click' THEN root || ':7'
  WHEN 'purchase' THEN root || ':min' WHEN 'signup' THEN root || ':min7/b3' ELSE 'N' END AS source_label,
  beat_us AS start_us, end_us, beat_us / 1e6 AS start_s, end_us / 1e6 AS end_s, least(value / 500, 1e0) AS strength, event_id, event_type
FROM (SELECT *, ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][event_id % 12 + 1] AS root,
  row_number() OVER w - 1 AS idx, coalesce(lead(beat_us) OVER w + CASE event_id % 5 WHEN 0 THEN 600 WHEN 1 THEN 5000 ELSE 0 END,
  max(beat_us) OVER (PARTITION BY track_id) + 1000000) AS end_us FROM v_ev WINDOW w AS (PARTITION BY track_id ORDER BY beat_us, event_id))""")
view("v_markers", """
SELECT track_id, 'm' || lpad(event_id::VARCHAR, 12, '0') AS marker_id, 'Part ' || (event_id % 7) AS label, beat_us AS start_us,
  CASE WHEN event_id % 2 = 1 THEN beat_us + 500000 END AS end_us, beat_us / 1e6 AS start_s,
  CASE WHEN event_id % 2 = 1 THEN (beat_us + 500000) / 1e6 END AS end_s, ['source','detected','user'][event_id % 3 + 1] AS origin
FROM v_ev WHERE event_type = 'signup'""")
view("v_positions", """
SELECT track_id, event_id AS query_id, beat_us + 13000 AS t_us, (beat_us + 13000) / 1e6 AS t_s FROM v_ev WHERE event_type = 'click'""")
view("v_edits", """
SELECT track_id, mode, start_s, end_s, 'F#m7' AS label, event_id AS edit_seq FROM v_chords WHERE event_type = 'click'
UNION ALL SELECT track_id, mode, start_s, end_s, 'Bb', event_id + 1000000000 FROM v_chords WHERE event_type = 'click' AND event_id % 2 = 0""")
view("v_search", """
SELECT q.p_partkey AS query_id, CASE q.p_partkey % 3 WHEN 0 THEN q.p_name WHEN 1 THEN q.p_brand || ' - ' || q.p_name ELSE q.p_name || ' live' END AS query,
  search_index, r, CASE WHEN r % 17 = 0 THEN 'id ' || r ELSE 'id_' || r END AS id,
  CASE WHEN r % 23 = 0 THEN p.p_name WHEN r % 19 = 0 THEN '   ' WHEN r % 4 = 0 THEN p.p_name WHEN r % 4 = 1 THEN p.p_name || ' (Official Video)'
    WHEN r % 4 = 2 THEN upper(p.p_name) ELSE p.p_name || ' cover' END AS title,
  CASE WHEN r % 29 <> 0 THEN p.p_brand || CASE WHEN r % 5 = 0 THEN ' Official' ELSE '' END END AS channel,
  floor(p.p_retailprice * 1000)::BIGINT AS views, p.p_size % 2 = 0 AS verified
FROM (SELECT *, (p_partkey * 7 + search_index) % (SELECT count(*) FROM part) AS r
  FROM part, range(10) t(search_index)) q JOIN part p ON p.p_partkey = q.r""")
view("v_candidates", """
SELECT query_id, query, search_index, id, title, channel, views, verified FROM v_search
WHERE r % 17 <> 0 AND trim(title) <> '' AND channel IS NOT NULL""")
view("v_lyric_results", """
SELECT q.p_partkey AS query_id, CASE WHEN q.p_partkey % 10 <> 0 THEN (100 + q.p_partkey % 200)::DOUBLE END AS audio_s, seq, r AS id,
  p.p_name AS track_name, (p.p_size * 7 + 90)::DOUBLE AS duration_s, r % 6 = 0 AS instrumental, r % 2 = 0 AS has_synced, r % 3 = 0 AS has_plain
FROM (SELECT *, (p_partkey * 5 + seq) % (SELECT count(*) FROM part) AS r FROM part, range(5) t(seq)) q JOIN part p ON p.p_partkey = q.r""")
view("v_texts", """
SELECT 'd' || doc_id AS batch_id, text || chr(10) || 'https://youtu.be/v' || (doc_id // 2) || ' https://www.youtube.com/watch?v=v' || (doc_id // 2)
  || '&t=3' || chr(10) || 'https://WWW.Example.com/Album/' || (doc_id // 2) || '/#top' AS text FROM documents
UNION ALL SELECT 'g' || page_id, 'see (' || url || '), https://soundcloud.com/a/sets/' || page_id || chr(10) || 'file:///music/Track%20' || (page_id % 50)
  || '.mp3' || chr(10) || '  file:///MUSIC/track%20' || (page_id % 50) || '.MP3 ' FROM pages""")
view("v_storage", "SELECT DISTINCT '/music/Track ' || (page_id % 50) || '.mp3' AS path FROM pages")


def _lrc(ms: str) -> str:
    two = lambda e: f"(CASE WHEN ({e}) < 10 THEN '0' ELSE '' END || ({e}))"
    return f"({two(f'({ms}) // 60000')} || ':' || {two(f'(({ms}) % 60000) // 1000')} || '.' || {two(f'(({ms}) % 1000) // 10')})"


view("v_lyric_texts", f"""
SELECT 'd' || doc_id AS track_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN ls
  WHEN 1 THEN list_transform(ls, lambda l, i: '[' || {_lrc('(i - 1) * 2500')} || ']' || CASE WHEN (i - 1) % 7 = 3 THEN '[' || {_lrc('(i - 1) * 2500 + 1000')} || ']' ELSE '' END || l)
  ELSE list_transform(ls, lambda l, i: '[' || {_lrc('(i - 1) * 2500')} || ']' || array_to_string(list_transform(string_split(l, ' '),
    lambda w, j: '<' || {_lrc('(i - 1) * 2500 + (j - 1) * 150')} || '>' || w || ' '), '')) END, chr(10)) AS text,
  (doc_id % 5 - 2) * 100 AS offset_ms, (len(ls) * 2500 + 5000)::BIGINT AS duration_ms
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
view("v_logs", """
SELECT event_id, abs_us, abs_us // 1000 AS ts_ms, ['rust','mlx','webview'][user_id % 3 + 1] AS origin,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' WHEN 'view' THEN 'debug' WHEN 'signup' THEN 'debug' ELSE 'info' END AS level,
  'at ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'DEBUG' WHEN 'signup' THEN 'TRACE' ELSE 'INFO' END
  || ' track ' || track_id AS message FROM v_ev""")
view("v_jobs", """
SELECT event_id, abs_us, track_id AS batch_id, 4 AS expected, track_id || '-' || (event_id % 4) AS job_id,
  CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'importing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS state,
  value / 500 AS progress FROM v_ev""")
view("v_progress", """
SELECT track_id AS job_id, beat_us // 1000 AS ts_ms, beat_idx AS seq, CASE WHEN user_id % 2 = 0 THEN 'fast' ELSE 'hq' END AS profile, duration_s,
  ['checkingCache','loadingModel','loadingAudio','separating','writingStems','validatingStems','cachingStems'][least(6, beat_idx // 10) + 1] AS stage,
  (beat_idx % 10) * 2 AS completed, CASE WHEN event_id % 9 <> 0 THEN 20 END AS total
FROM v_raw JOIN (SELECT track_id, user_id, duration_s FROM v_tracks) USING (track_id)""")
view("v_levels", """
SELECT track_id, event_id, beat_us // 1000 AS ts_ms, least(value / 500, 1e0) AS "left", 1 - least(value / 500, 1e0) AS "right" FROM v_ev""")
view("v_metrics", """
SELECT event_id, track_id AS host, CASE WHEN event_type <> 'error' THEN value / 4 END AS cpu, CASE WHEN event_type <> 'view' THEN value / 5 END AS gpu,
  CASE WHEN event_type NOT IN ('error', 'click') THEN value / 6 - 5 END AS memory FROM v_ev""")
view("v_blocks", """
SELECT 'a' || label AS track_id, 0 AS channel, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS block_no, embedding AS samples, vec_id FROM embeddings""")
view("v_stereo", """
SELECT * FROM v_blocks UNION ALL SELECT track_id, 1, block_no, list_transform(samples, lambda x: (x * -5e-1)::FLOAT), vec_id FROM v_blocks""")
view("v_samples", """
SELECT track_id, channel, block_no * 64 + i AS frame, samples[i + 1]::DOUBLE AS x FROM v_stereo, range(64) t(i)""")
view("v_stems", """
SELECT 'a' || label AS track_id, (vec_id % 4)::INT AS stem, row_number() OVER (PARTITION BY label, vec_id % 4 ORDER BY vec_id) - 1 AS block_no, embedding AS samples FROM embeddings""")
view("v_stem_mix", """
SELECT track_id, i::INT AS stem, (user_id + i) % 5 / 4 AS gain, (user_id * 3 + i) % 9 / 4 - 1 AS pan, (user_id + i) % 7 = 0 AS muted,
  user_id % 3 = 0 AND i = user_id % 4 AS soloed
FROM (SELECT track_id, user_id FROM v_tracks UNION ALL SELECT DISTINCT 'a' || label, label FROM embeddings), range(4) t(i)""")
