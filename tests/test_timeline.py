"""Ordered primitives against plain Python, with keys cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from stave.operators import rhythm
from stave.operators.timeline import annotate, asof, keep_first, nearest, overlap_join


def rows(seed, n):
    rng = random.Random(seed)
    # one key holds a third of the rows
    return [("hot" if i % 3 == 0 else f"k{i % 7}", round(rng.uniform(0, 50), 2), i, rng.choice([None, 1.0, 2.0, 5.0])) for i in range(n)]


def expected(data):
    out, by = {}, {}
    for key, t, i, v in data:
        by.setdefault(key, []).append((t, i, v))
    for key, lane in by.items():
        lane.sort(key=lambda r: r[:2])
        total = 0
        for n, (t, i, v) in enumerate(lane):
            total += i
            seen = [x[2] for x in lane[: n + 1] if x[2] is not None]
            ahead = [x[2] for x in lane[n:] if x[2] is not None]
            earlier = [x[1] for x in lane[:n]]
            out[i] = (
                n, lane[n - 1][1] if n else None, lane[n + 1][1] if n + 1 < len(lane) else None, seen[-1] if seen else None,
                ahead[0] if ahead else None, total, max(earlier) if earlier else None)
    return out


def check(spark):
    data = rows(1, 200)
    df = spark.createDataFrame(data, "k string, t double, i bigint, v double")
    made = annotate(
        df, ["k"], ["t", "i"], ordinal="n", lag={"p": F.col("i")}, lead={"x": F.col("i")}, last={"l": F.col("v")},
        upcoming={"u": F.col("v")}, running={"r": F.col("i")}, peak={"m": F.col("i")})
    found = {r.i: (r.n, r.p, r.x, r.l, r.u, r.r, r.m) for r in made.collect()}
    assert found == expected(data)


def test_annotate_plain(spark):
    check(spark)


def test_annotate_blocks(spark, tiny_blocks):
    check(spark)


def test_annotate_one_instant(spark, tiny_blocks):
    df = spark.createDataFrame([("a", 1.0, i) for i in range(20)], "k string, t double, i bigint")
    assert sorted(r.n for r in annotate(df, ["k"], ["t", "i"], ordinal="n").collect()) == list(range(20))


@pytest.mark.parametrize("equal", ["before", "after"])
def test_asof_brute_force(spark, tiny_blocks, equal):
    rng = random.Random(2)
    anchors = [(rng.choice("ab"), float(rng.randint(0, 30)), i) for i in range(60)]
    points = [(rng.choice("abc"), float(rng.randint(-2, 32)), i) for i in range(80)]
    a = spark.createDataFrame(anchors, "k string, at double, ai bigint")
    p = spark.createDataFrame(points, "k string, pt double, pi bigint")
    found = asof(p, a, ["k"], F.col("pt"), F.col("at"), ["ai"], ties=["ai"], before="b", after="f", equal=equal).collect()
    assert len(found) == len(points)
    for r in found:
        back = [(t, i) for k, t, i in anchors if k == r.k and (t <= r.pt if equal == "before" else t < r.pt)]
        on = [(t, i) for k, t, i in anchors if k == r.k and (t > r.pt if equal == "before" else t >= r.pt)]
        assert (r.b and (r.b.t, r.b.ai)) == (max(back) if back else None)
        assert (r.f and (r.f.t, r.f.ai)) == (min(on) if on else None)


def test_nearest_ties(spark):
    a = spark.createDataFrame([("k", 1.0), ("k", 3.0)], "k string, at double")
    p = spark.createDataFrame([("k", 2.0)], "k string, pt double")
    assert nearest(p, a, ["k"], F.col("pt"), F.col("at")).first().hit.t == 1.0
    assert nearest(p, a, ["k"], F.col("pt"), F.col("at"), later_wins=True).first().hit.t == 3.0


def test_overlap_join_brute_force(spark):
    rng = random.Random(3)
    spans = [("k", i, s, s + rng.choice([0.5, 3.0, 40.0])) for i, s in enumerate(rng.uniform(0, 60) for _ in range(40))]
    wins = [("k", i, s, s + rng.choice([1.0, 20.0])) for i, s in enumerate(rng.uniform(0, 60) for _ in range(30))]
    left = spark.createDataFrame(spans, "k string, i bigint, s double, e double")
    right = spark.createDataFrame(wins, "k string, j bigint, ws double, we double")
    made = overlap_join(left, right, ["k"], (F.col("s"), F.col("e")), (F.col("ws"), F.col("we")), 5.0)
    found = sorted((r.i, r.j) for r in made.collect())
    assert found == sorted((i, j) for _, i, s, e in spans for _, j, ws, we in wins if s < we and ws < e)


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, seq int, v string")
    assert sorted((r.k, r.v) for r in keep_first(df, ["k"], ["seq"]).collect()) == [("a", "y"), ("b", "z")]


def test_blocks_are_even_in_spite_of_an_outlier(spark):
    from stave.operators.timeline import _with_blocks, hot_keys
    from stave.session import BLOCK_ROWS_CONF

    spark.conf.set(BLOCK_ROWS_CONF, "100")
    try:
        df = spark.createDataFrame([("k", float(i if i else 1e9)) for i in range(1000)] + [("cold", 1.0)], "k string, t double")
        blocks = _with_blocks(df, ["k"], "t", hot_keys(df, ["k"], "t")).groupBy("k", "_blk").count().collect()
    finally:
        spark.conf.unset(BLOCK_ROWS_CONF)
    assert all(r._blk is None for r in blocks if r.k == "cold")
    sizes = [r["count"] for r in blocks if r.k == "k"]
    assert len(sizes) >= 10 and max(sizes) <= 150


@pytest.mark.parametrize("limit", [3, 500])
def test_beat_lines_against_all_pairs(spark, tiny_blocks, limit):
    rng = random.Random(6)
    beats = [("a", i, round(i * 0.5 + rng.choice([0, 0, 0.1]), 3), i % 4 == 0) for i in range(120)] + [("a", 120, 10.0, True), ("b", 0, 1.0, False)]
    views = [(rng.choice("abc"), i, rng.choice([1.0, 1.4, 1.5, 3.0, 8.0]), rng.choice([0.0, 0.25, 0.5, 0.9]), rng.choice([0.0, 20.0, 60.0])) for i in range(60)]
    got = sorted(tuple(r) for r in rhythm.beat_lines(
        spark.createDataFrame(beats, "track_id string, beat_idx int, beat_s double, is_downbeat boolean"),
        spark.createDataFrame(views, "track_id string, viewport_id int, zoom double, start double, duration_s double"), limit).collect())
    want = []
    for track, view, zoom, start, length in views:
        if length <= 0 or (length / zoom > 30 and zoom < 1.5):
            continue
        low, high = start * length, (start + 1 / zoom) * length
        mine = sorted((s, i, d) for k, i, s, d in beats if k == track and low <= s <= high and (length / zoom <= 30 or d))
        mine = mine[:: max(1, -(-len(mine) // limit))]
        want += [(track, view, s, (s / length - start) * zoom * 100, d) for s, _, d in mine]
    assert got == sorted(want) and len(want) > 20
