"""Stateful streams over several micro-batches: equal to their batch twins, after a restart and with late rows."""

import pandas as pd
import pytest

from stave.operators import telemetry as T
from stave.session import new_dir
from stave.streaming import rules as R
from stave.streaming import runner as N

LEVELS = "track_id string, event_id long, ts_ms long, left double, right double"
JOBS = "batch_id string, expected int, job_id string, state string, order_no long, ts_ms long"


def _arrive(spark, folder, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)


def _readings(low, high):
    return [("ab"[i % 2], i, 60_000 + i * 37, ((i * 7919) % 100) / 100, 0.0) for i in range(low, high)]


def test_meter_goes_on_after_a_restart_and_drops_late_rows(spark):
    folder, out = new_dir(spark, "levels"), new_dir(spark, "meter")
    for part in range(3):
        _arrive(spark, folder, _readings(part * 20, part * 20 + 20), LEVELS)
    made = R.meter(N.read_files(spark, folder, spark.read.parquet(folder).schema, 1))
    first = {r.event_id for r in N.run_append(made, "meter", out).collect()}
    assert first == set(range(60))
    # A reading older than its track's last one gives nothing and leaves the state as it is.
    _arrive(spark, folder, [("a", 900, 60_500, 1.0, 0.0)], LEVELS)
    _arrive(spark, folder, _readings(60, 80), LEVELS)
    got = {r.event_id: (round(r.level, 9), round(r.held_peak, 9)) for r in N.run_append(R.meter(N.read_files(spark, folder, spark.read.parquet(folder).schema, 1)), "meter", out).collect()}
    twin = T.meter_history(spark.createDataFrame(_readings(0, 80), LEVELS)).collect()
    assert got == {r.event_id: (round(r.level, 9), round(r.held_peak, 9)) for r in twin}
    assert spark.conf.get(N.PROVIDER, "") != N.ROCKS_DB


def test_state_leaves_after_its_time(spark):
    folder, out = new_dir(spark, "levels"), new_dir(spark, "meter")
    rows = [[("a", 1, 1_000, 0.9, 0.0)], [("b", 2, 500_000, 0.1, 0.0)], [("b", 3, 500_100, 0.1, 0.0)], [("a", 4, 500_200, 0.2, 0.0)]]
    for part in rows:
        _arrive(spark, folder, part, LEVELS)
    stream = N.read_files(spark, folder, spark.read.parquet(folder).schema, 1)
    got = {r.event_id: r.held_peak for r in N.run_append(R.meter(stream, delay="1 second", ttl_ms=60_000), "meter", out).collect()}
    # The peak of the first reading was forgotten with its state, rather than sinking from it.
    assert got[1] == 0.9 and got[4] == 0.2


def test_batches_settle_and_open_again(spark):
    folder, out = new_dir(spark, "jobs"), new_dir(spark, "summary")
    parts = [
        [("x", 2, "j1", "importing", 1, 1_000), ("y", 1, "k", "completed", 2, 1_100)],
        [("x", 2, "j2", "failed", 5, 2_000), ("x", 2, "j1", "completed", 4, 1_900)],
        [("x", 2, "j1", "importing", 3, 1_500)],
        [("y", 1, "k", "importing", 7, 3_000)],
        [("z", 3, "m", "completed", 8, 3_100)],
    ]
    want = [{"y": (1, 0)}, {"x": (1, 1), "y": (1, 0)}, {"x": (1, 1), "y": (1, 0)}, {"x": (1, 1)}, {"x": (1, 1)}]
    for part, expected in zip(parts, want):
        _arrive(spark, folder, part, JOBS)
        stream = R.job_summary(N.read_files(spark, folder, spark.read.parquet(folder).schema, 1))
        last = N.run_updates(stream, ["batch_id"], "summary", out)
        assert {r.batch_id: (r.completed, r.failed) for r in last.where("settled").collect()} == expected


@pytest.mark.parametrize("files", [5])
def test_eta_in_micro_batches(spark, files):
    kind = "job_id string, seq long, ts_ms long, profile string, duration_s double, stage string, completed long, total long"
    rows = [(f"j{i % 3}", i, 1_000 + i * 700, "fast", 240.0, T.STAGES[i // 30 * 2 % 8], (i % 30) if i % 5 else None, 30) for i in range(150)]
    folder = new_dir(spark, "progress")
    for part in range(files):
        _arrive(spark, folder, rows[part * 30: part * 30 + 30], kind)
    made = N.run_append(R.stem_eta(N.read_files(spark, folder, spark.read.parquet(folder).schema, 1)), "eta").toPandas()
    twin = T.stem_eta(spark.createDataFrame(rows, kind)).toPandas()
    both = [x.sort_values("seq", ignore_index=True).round(6) for x in (made, twin)]
    pd.testing.assert_frame_equal(*both, check_dtype=False)


def test_first_candidate_whatever_the_order(spark):
    folder = new_dir(spark, "candidates")
    kind = "batch_id string, seq long, kind string, input string"
    for part in ([("b", 5, "video", "https://youtu.be/X"), ("b", 9, "local", "/m/a.mp3")], [("b", 2, "video", "https://www.youtube.com/watch?v=X")], [("b", 7, "local", "/m/a.mp3")]):
        _arrive(spark, folder, part, kind)
    stream = R.first_candidates(N.read_files(spark, folder, spark.read.parquet(folder).schema, 1))
    got = {r.seq for r in N.run_updates(stream, ["batch_id", "candidate_key"], "first").collect()}
    assert got == {2, 7}
