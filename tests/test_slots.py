"""Stateful streams deal their keys to slots, so that calls and states do not grow with keys times micro-batches."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from stave.operators import telemetry as T
from stave.session import new_dir
from stave.streaming import rules as R
from stave.streaming import runner as N
from stave.streaming import stateful as ST
from tests.test_chains import _eta_in_steps
from tests.test_streams import JOBS, LEVELS, _arrive

PROGRESS = "job_id string, seq long, ts_ms long, profile string, duration_s double, stage string, completed long, total long"


class State:
    """What a stateful function asks of its group's state."""

    def __init__(self):
        self.value, self.mark, self.hasTimedOut, self.until = None, 0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.until = None

    def setTimeoutTimestamp(self, moment):
        assert moment > self.mark
        self.until = moment

    def getCurrentWatermarkMs(self):
        return self.mark


def _names(kind):
    return [c.split()[0] for c in kind.split(", ")]


def _told(run, state, rows, kind):
    return [r for made in run((0,), iter([pd.DataFrame(rows, columns=_names(kind))]), state) for r in made.itertuples(index=False)]


def test_eta_of_many_jobs_to_the_last_bit():
    rng, jobs, run, state = random.Random(11), {}, ST.eta(ST.DAY_MS), State()
    for j in range(40):
        at = 10_000 + j
        for i in range(rng.choice([1, 5, 70])):
            at += rng.randint(0, 9000)
            jobs.setdefault(f"j{j}", []).append((f"j{j}", i, at, "hq" if j % 2 else "fast", 61.5 + j, T.STAGES[min(7, (i + j) // 11)], i % 11 * 2 if rng.random() < 0.9 else None, 22 if rng.random() < 0.9 else None))
    wanted = {(job, seq): left for job, rows in jobs.items() for seq, left in _eta_in_steps(rows)}
    got, whole = {}, sum(jobs.values(), [])
    for low in range(0, 70, 13):
        part = [r for r in whole if low <= r[1] < low + 13]
        rng.shuffle(part)
        # One call tells of all jobs.
        got |= {(r.job_id, r.seq): r.remaining_s for r in _told(run, state, part, PROGRESS)}
    assert got.keys() == wanted.keys()
    assert [got[k] for k in wanted] == pytest.approx(list(wanted.values()), rel=1e-15)


def test_meter_of_many_tracks():
    rng, tracks = random.Random(4), {}
    for k in [*(f"t{i}" for i in range(9)), None]:
        at = 1_000
        for _ in range(rng.choice([1, 60])):
            at += rng.choice([0, 5, 90, 2500])
            tracks.setdefault(k, []).append((k, len(tracks.get(k, [])), at, rng.random() ** 3, 0.0))
    run, state, step, got = ST.meter("medium", "oneSecond", ST.DAY_MS), State(), T.meter_step("medium", 1000), {}
    for low in range(0, 60, 17):
        got |= {(r.track_id, r.event_id): (r.level, r.held_peak) for r in _told(run, state, [r for rows in tracks.values() for r in rows[low: low + 17]], LEVELS)}
    for k, rows in tracks.items():
        _, made = step(None, pd.DataFrame(rows, columns=_names(LEVELS)))
        for r in made.itertuples():
            assert np.allclose(got.pop((k, r.event_id)), (r.level, r.held_peak), atol=1e-12)
    assert not got


def test_keys_of_a_slot_leave_one_by_one():
    run, state = ST.meter("medium", "oneSecond", 60_000), State()
    row = lambda k, i, at, x: (k, i, at, x, 0.0)
    _told(run, state, [row("a", 1, 1_000, 0.9), row("b", 2, 50_000, 0.8), row("c", 3, 90_000, 0.7)], LEVELS)
    assert state.until == 61_000
    # a has no row in its time; b's comes late in its time, and one older than its last gives nothing.
    state.mark = 110_001
    assert [r.event_id for r in _told(run, state, [row("b", 4, 110_100, 0.1), row("c", 5, 89_000, 0.1)], LEVELS)] == [4]
    assert state.until == 150_000
    state.mark, state.hasTimedOut = 150_001, True
    assert not list(run((0,), iter([]), state)) and state.until == 170_100
    state.hasTimedOut = False
    again = {r.track_id: r.held_peak for r in _told(run, state, [row("a", 6, 160_000, 0.2), row("c", 7, 160_000, 0.3)], LEVELS)}
    assert again == {"a": 0.2, "c": 0.3}
    state.mark, state.hasTimedOut = 10**9, True
    assert not list(run((0,), iter([]), state)) and not state.exists


def test_batches_of_a_slot():
    run, state = ST.summarize(["order_no"], 60_000), State()
    told = lambda *rows: {r.batch_id: (r.settled, r.completed, r.failed) for r in _told(run, state, rows, JOBS)}
    assert told(("x", 2, "j", "completed", 5, 1_000), (None, 1, None, "failed", 1, 1_000), ("x", 2, "j", "importing", 4, 900), ("y", 1, "j", "queued", 6, 50_000)) == {
        "x": (False, 1, 0), None: (True, 0, 1), "y": (False, 0, 0)}
    # A state as old as the one known changes nothing; y is not told of.
    assert told(("x", 2, "j", "failed", 5, 1_000), ("x", 2, "k", "completed", 1, 900)) == {"x": (True, 2, 0)}
    state.mark = 70_000
    assert told(("y", 1, "j", "completed", 9, 70_100)) == {"y": (True, 1, 0)}
    assert told(("x", 2, "k", "completed", 10, 70_200)) == {"x": (False, 1, 0)}


def test_states_do_not_grow_with_keys(spark):
    rows = [(f"t{i % 700}", i, 60_000 + i, (i % 100) / 100, 0.0) for i in range(1400)]
    folder, out = new_dir(spark, "levels"), new_dir(spark, "meter")
    for part in (rows[:700], rows[700:]):
        _arrive(spark, folder, part, LEVELS)
    made = N.run_append(R.meter(N.read_files(spark, folder, spark.read.parquet(folder).schema, 1), slots=8), "meter", out)
    assert made.count() == 1400
    assert spark.read.format("statestore").load(f"{out}/checkpoint").count() == 8

def test_jobs_against_time_and_after_a_rest(spark, tmp_path):
    """Ids that run against time, and a batch that rests for longer than the rule's time to live."""
    import __spark_entry__ as entry

    day, rng, rows = 86_400, random.Random(2), []
    for user in range(40):
        moments = sorted(rng.uniform(0, 5 * day) if rng.random() < 0.6 else rng.uniform(25 * day, 30 * day) for _ in range(12))
        rows += [(user * 100 + 11 - i, datetime(2024, 1, 1) + timedelta(seconds=s), user, rng.choice(["view", "error", "purchase", "purchase"]), 1.0, None) for i, s in enumerate(moments)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    got, twin = ({tuple(r) for r in entry.queries()[n](spark, str(tmp_path)).select("batch_id", "completed", "failed").collect()} for n in ("stream_job_summary", "import_batch_summary"))
    assert got == twin and len(twin) > 3
