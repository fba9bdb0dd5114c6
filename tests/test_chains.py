"""Chains in blocks against one sequential walk, and energy windows against all pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stave.operators import chains as C
from stave.operators import telemetry as T


def _chain_rows():
    rng = random.Random(4)
    rows = []
    for key, n in (("hot", 400), ("cold", 2), (None, 5), ("b", 30)):
        for i in range(n):
            low = rng.uniform(-3, 1) if rng.random() < 0.5 else -C.FAR
            rows.append((key, i, rng.choice([0.0, 0.3, 1.0, 1.2]) if i % 7 else 1.0, rng.uniform(-1, 1), low, max(low, 0.0) + rng.random() * 3 if rng.random() < 0.5 else C.FAR))
    rng.shuffle(rows)
    return rows


def _walked(rows):
    out, state = {}, {}
    for key, i, a, b, low, high in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state[key] = min(high, max(low, a * state.get(key, 0.0) + b))
        out[key, i] = state[key]
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_chain(spark, tiny_blocks, wide):
    rows = _chain_rows()
    df = spark.createDataFrame(rows, "k string, i long, a double, b double, lo double, hi double").repartition(3)
    shift = F.array("b", 2 * F.col("b"), F.lit(0.25)) if wide else F.col("b")
    limits = {} if wide else {"low": F.col("lo"), "high": F.col("hi")}
    made = C.run_chain(df, ["k"], ["i"], "x", slope=F.col("a"), shift=shift, **limits)
    got = {(r.k, r.i): r.x for r in made.collect()}
    if not wide:
        want = _walked(rows)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    else:
        for j, shifts in enumerate((lambda b: b, lambda b: 2 * b, lambda b: 0.25)):
            want = _walked([(k, i, a, shifts(b), -C.FAR, C.FAR) for k, i, a, b, _, _ in rows])
            assert all(math.isclose(got[k][j], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_one_hot_key_is_walked_by_many_tasks(spark, monkeypatch):
    from stave.session import BLOCK_ROWS_CONF

    spark.conf.set(BLOCK_ROWS_CONF, "2000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("i"))
        made = C.run_chain(df, ["k"], ["i"], "x", slope=F.lit(1.0), shift=F.lit(1.0)).withColumn("p", F.spark_partition_id())
        per = made.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top")).collect()
        assert len(per) >= 5 and max(r.n for r in per) < 10_000 and max(r.top for r in per) == 20_000
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _levels(n=300, seed=1):
    rng, at, rows = random.Random(seed), 1_000, []
    for i in range(n):
        at += rng.choice([0, 5, 33, 90, 400, 2500])
        level = rng.random() ** 3 if i % 60 < 40 else 0.9 - (i % 60) / 70
        rows.append(("a" if i < n - 10 else "b", i, at, max(0.0, level), rng.random()))
    return rows


@pytest.mark.parametrize("response,hold", [("medium", "oneSecond"), ("slow", "threeSeconds"), ("fast", "off")])
def test_meter_in_blocks(spark, tiny_blocks, response, hold):
    response = "smooth" if response == "slow" else response
    rows = _levels()
    got = {r.event_id: (r.level, r.held_peak) for r in T.meter_history(spark.createDataFrame(rows, "track_id string, event_id long, ts_ms long, left double, right double").repartition(3), response, hold).collect()}
    frame = pd.DataFrame(rows, columns=["track_id", "event_id", "ts_ms", "left", "right"])
    step = T.meter_step(response, T.HOLD_MS[hold])
    for _, part in frame.groupby("track_id"):
        _, made = step(None, part.sort_values(["ts_ms", "event_id"]))
        for r in made.itertuples():
            assert np.allclose(got[r.event_id], (r.level, r.held_peak), atol=1e-9)


def test_eta_in_blocks(spark, tiny_blocks):
    rng, rows, at = random.Random(3), [], 10_000
    for job in ("x", "y", "z"):
        for i in range(120):
            at += rng.randint(0, 3000)
            stage = (T.STAGES + ["odd"])[min(8, i // 14)] if job != "z" else "separating" if i > 3 else "checkingCache"
            counted = rng.random() < 0.8
            rows.append((job, i, at, "hq" if job == "y" else "fast", 240.0, stage, i % 14 if counted else None, 14 if rng.random() < 0.9 else None))
    kind = "job_id string, seq long, ts_ms long, profile string, duration_s double, stage string, completed long, total long"
    got = {(r.job_id, r.seq): (r.remaining_s, r.shown_s) for r in T.stem_eta(spark.createDataFrame(rows, kind).repartition(3)).collect()}
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])
    for _, part in frame.groupby("job_id"):
        _, made = T.eta_rows(None, part.sort_values(["ts_ms", "seq"]))
        for r in made.itertuples():
            assert math.isclose(got[r.job_id, r.seq][0], r.remaining_s, abs_tol=1e-6) and got[r.job_id, r.seq][1] == r.shown_s, r


@pytest.mark.parametrize("window", [5_000, 15_000, 30_000, 700])
def test_energy_against_all_pairs(spark, window):
    rows = [(k, i, at, left, right) for k, i, at, left, right in _levels(200, 7)]
    levels = spark.createDataFrame(rows, "track_id string, event_id long, ts_ms long, left double, right double").repartition(3)
    rng = random.Random(2)
    points = [(rng.choice("abc"), i, rng.choice([rng.randrange(0, 160_000), rows[rng.randrange(200)][2]])) for i in range(150)]
    got = {r.point_id: r for r in T.energy_history(levels, spark.createDataFrame(points, "track_id string, point_id long, ts_ms long"), window).collect()}
    for track, p, at in points:
        mine = [(left, right) for k, _, t, left, right in rows if k == track and at - window <= t <= at]
        if not mine:
            assert p not in got
            continue
        r = got[p]
        assert (r.n, r.max_left, r.max_right) == (len(mine), max(x for x, _ in mine), max(y for _, y in mine))
        assert math.isclose(r.avg_left, sum(x for x, _ in mine) / len(mine), abs_tol=1e-9) and math.isclose(r.avg_right, sum(y for _, y in mine) / len(mine), abs_tol=1e-9)


def _eta_in_steps(rows):
    """Remaining seconds after each report of one job, report by report."""
    known, began, first, pace, left, seen = "checkingCache", rows[0][2], 0, None, None, rows[0][2]
    for _, seq, at, profile, length, stage, done, total in rows:
        current, later = T.stage_prior(profile, length, stage)
        left = 2.0 + T.stage_prior(profile, length, "checkingCache")[1] if left is None else left
        if stage != known:
            known, began, first, pace, left = stage, at, done or 0, None, current + later
        else:
            elapsed = max(0.0, (at - began) / 1000.0)
            if done is not None and total is not None and done > first and elapsed >= 0.5:
                pace = elapsed / (done - first) if pace is None else pace * 0.65 + elapsed / (done - first) * 0.35
            raw = (pace * max(0, total - done) if None not in (pace, done, total) else max(0.0, current - elapsed)) + later
            left = min(7200.0, max(0.0, raw if pace is None else max(0.0, left - (at - seen) / 1000.0) * 0.35 + raw * 0.65))
        seen = at
        yield seq, left


def test_eta_to_the_last_bit(spark):
    rng, jobs = random.Random(5), {}
    for j in range(12):
        at = 10_000
        for i in range(90):
            at += rng.randint(0, 9000)
            jobs.setdefault(f"j{j}", []).append((f"j{j}", i, at, "hq" if j % 2 else "fast", 61.52 + j, T.STAGES[min(7, i // 11)], i % 11 * 2, 22 if rng.random() < 0.9 else None))
    kind = "job_id string, seq long, ts_ms long, profile string, duration_s double, stage string, completed long, total long"
    got = {(r.job_id, r.seq): r.remaining_s for r in T.stem_eta(spark.createDataFrame(sum(jobs.values(), []), kind).repartition(3)).collect()}
    for job, rows in jobs.items():
        wanted = dict(_eta_in_steps(rows))
        assert {s: got[job, s] for s in wanted} == wanted
        state, made = None, []
        for i in range(0, len(rows), 25):
            state, part = T.eta_rows(state, pd.DataFrame(rows[i: i + 25], columns=[c.split()[0] for c in kind.split(", ")]))
            made += part["remaining_s"].tolist()
        assert made == list(wanted.values())
