"""Plans that must not depend on tables staying small."""

import pytest

from stave.plans.bindings import Tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", ["search_rows", "lyric_results", "tracks"])
def test_growing_tables_are_not_broadcast(spark, monkeypatch, table):
    stored = Tables.stored
    monkeypatch.setattr(Tables, "stored", lambda self, name, build, spread=False: build() if name == table else stored(self, name, build, spread))
    assert "Broadcast" not in plan(getattr(Tables(spark, SF), table))


def test_search_rows_are_parsed_once(spark):
    from stave.sources.search import scan_search_results

    rows = spark.createDataFrame([(1, "q", 0, "youtube", '{"id": "a", "title": "t", "channel": "c"}')], "query_id int, query string, search_index int, provider string, json string")
    found = scan_search_results(rows)
    assert found.count() == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_files_that_land_are_bounded_and_in_order(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from stave.plans import bindings

    monkeypatch.setattr(bindings, "LANDED_ROWS", 100)
    table = Tables(spark, str(tmp_path))
    rows = spark.range(2000).select(F.col("id"), (F.col("id") * 37 % 2000).alias("at"))
    landed = spark.read.parquet(table.landed("bounded", rows, "at")).withColumn("file", F.input_file_name()).withColumn("when", F.col("_metadata.file_modification_time"))
    files = landed.groupBy("file", "when").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).orderBy("when").collect()
    assert sum(f.n for f in files) == 2000 and max(f.n for f in files) <= 150
    assert all(a.high < b.low for a, b in zip(files, files[1:]))


def test_stored_tables_follow_their_size(spark, monkeypatch, tmp_path):
    """No fixed number of tasks: more rows are more files."""
    from stave.plans.bindings import Tables as T

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        files = [len(T(spark, str(tmp_path)).stored(f"spread{n}", lambda n=n: spark.range(n).selectExpr("id", "uuid() AS u"), spread=True).inputFiles()) for n in (100, 200_000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert files[0] == 1 and files[1] > 8


def test_import_lines_are_trimmed_once(spark):
    from stave.sources.imports import parse_import_text

    texts = spark.createDataFrame([("a", " x \nhttps://e.com/1,")], "batch_id string, text string")
    found = parse_import_text(texts, spark.createDataFrame([("/x",)], "path string"))
    assert sorted(r.input for r in found.collect()) == ["https://e.com/1", "x"]
    filters = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line]
    assert filters and not any("regexp_replace" in line for line in filters)


def test_lyric_lines_are_ordered_where_their_text_is(spark):
    """No line is shuffled; texts that share their track are still ordered together."""
    from stave.sources.lyrics import parse_lrc_rows

    rows = [("a", "[00:03.00]c\n[00:01.00][00:02.00]<00:01.00>x <00:01.50>y\nlast\n[ar:me]", 9000), ("b", "[00:02.00]two\n[00:04.00]four", 9000), ("b", "[00:01.00]one\n[00:03.00]three", 9000),
            (None, "[00:01.00]n", 9000), (None, "[00:00.50]m", 9000), ("e", "", 1), ("z", None, 1)]
    texts = spark.createDataFrame(rows, "track_id string, text string, duration_ms long")
    got = {(r.track_id, r.line_no): (r.text, r.start_ms, r.end_ms, [tuple(w) for w in r.words]) for r in parse_lrc_rows(texts).collect()}
    words = [("x ", 1000, 1500), ("y", 1500, None)]
    assert got == {
        ("a", 0): ("x y", 1000, 2000, words), ("a", 1): ("x y", 2000, 3000, words), ("a", 2): ("c", 3000, 9000, []), ("a", 3): ("last", None, None, []),
        ("b", 0): ("one", 1000, 2000, []), ("b", 1): ("two", 2000, 3000, []), ("b", 2): ("three", 3000, 4000, []), ("b", 3): ("four", 4000, 9000, []),
        (None, 0): ("m", 500, 1000, []), (None, 1): ("n", 1000, 9000, [])}
    assert "Exchange" not in plan(parse_lrc_rows(texts.where("track_id = 'a'")))


def test_lyric_words_stay_in_their_lines(spark):
    """Words are judged and found in the arrays of their lines, and texts of one track told together."""
    from stave.operators.lyrics import active_lyric_word
    from stave.operators.quality import check_lyrics
    from stave.sources.lyrics import lrc_validate, parse_lrc_rows

    texts = spark.createDataFrame([("a", "[00:01.00]<00:01.00>x <00:01.50>y <00:01.20>  <00:01.30>w\n[00:02.00]z")], "track_id string, text string")
    lines = parse_lrc_rows(texts)
    checked = check_lyrics(spark.createDataFrame([("a", "en", 0)], "track_id string, language string, offset_ms long"), lines)
    assert sorted((r.rule, r.n_bad) for r in checked.collect()) == [("word order", 1), ("word range", 1), ("word text", 1)]
    active = spark.createDataFrame([("a", 0, 1000, 0), ("a", 1, 1600, 0), ("a", 2, 900, 0), ("a", 3, 2100, 1)], "track_id string, query_id int, at_ms long, line_no long")
    assert sorted((r.query_id, r.word_no) for r in active_lyric_word(active, lines).collect()) == [(0, 0), (1, 1), (2, -1), (3, -1)]
    twice = spark.createDataFrame([("a", "[00:01.00]x"), ("a", "[00:99.00]y"), ("b", "ok")], "track_id string, text string")
    assert sorted((r.track_id, r.verdict, r.n_lines) for r in lrc_validate(twice).collect()) == [("a", "invalid timestamp", 2), ("a", "invalid timestamp", 2), ("b", "ok", 1)]


def test_python_works_on_slices(spark, monkeypatch):
    """A frame holds a bounded number of bytes, however many rows a batch has."""
    import pandas as pd

    from stave.operators import signal

    monkeypatch.setattr(signal, "SLICE_BYTES", 8_000)
    rows = spark.range(0, 1000, numPartitions=1).selectExpr("id", "array_repeat(double(id), 100) AS samples")
    sizes = signal.map_slices(rows, lambda b: pd.DataFrame({"n": [len(b)]}), "n bigint", multiple=2).collect()
    assert sum(r.n for r in sizes) == 1000 and max(r.n for r in sizes) <= 10


def test_energy_tasks_follow_the_rows(spark, monkeypatch):
    from stave.operators import telemetry

    monkeypatch.setattr(telemetry, "TASK_ROWS", 10)
    levels = spark.range(30).selectExpr("concat('t', id % 3) AS track_id", "id * 100 AS ts_ms", "0.5D AS left", "0.25D AS right")
    made = telemetry.energy_history(levels, levels.selectExpr("track_id", "ts_ms AS point_id", "ts_ms"), 1000)
    assert "hashpartitioning(track_id" in plan(made) and ", 9), REPARTITION_BY_NUM" in plan(made)
    assert {(r.max_left, r.avg_right) for r in made.collect()} == {(0.5, 0.25)}
