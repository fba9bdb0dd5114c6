"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from stave.llm import hard_negatives as H

KIND = "vec_id long, embedding array<float>, label int, a_key int, id string"


def _brute(rows, anchors, positives=5, negatives=10):
    """By the contract, in whole numbers."""
    good = [(i, [math.floor(256 * float(x)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, al in good:
        if a is None or not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i is None, i or 0, y) for i, v, y in good if len(v) == len(av) and i != a]
        scored.sort()
        for s, n, p, _ in [x for x in scored if x[3] == al][:positives]:
            mine = [x for x in scored if x[3] != al and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, None if n else p, rank + 1, None if x[1] else x[2], -s, -x[0]) for rank, x in enumerate(mine)]
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def _got(df):
    return _sorted(df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_against_all_pairs(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
        rows = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
        want = _brute(rows, lambda i: i % 100 == 0)
        assert want and _got(H.op11_hard_negatives(spark, f"/root/testdata/{sf}")) == _sorted(want)


def test_odd_rows_and_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=3), 1)], int(rng.integers(3))) for i in range(180)]
    rows += [(200 + i, rows[0][1], i % 3) for i in range(30)] + [rows[10]] * 3 + [rows[4]] * 2
    rows += [(None, rows[0][1], 1), (None, rows[7][1], 0), (300, None, 1), (301, [1.0, None, 2.0], 1), (302, [1.0, float("nan"), 0.0], 1), (303, [float("inf"), 0.0, 0.0], 2),
             (304, [], 1), (308, [], 1), (309, [], 2), (312, [3.0, 4.0], 0), (313, [3.0, 4.0], 0), (314, [2.0, 2.0], 1), (316, [-1.0, -1.0, -1.0], None), (320, [0.0, 0.0, 0.0], 0)]
    want = _sorted(_brute(rows, lambda i: i % 4 == 0))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(3)
    assert _got(H.mine_negatives(df, F.col("vec_id") % 4 == 0)) == want
    monkeypatch.setattr(H, "ROW_BLOCK", 20)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 7)
    assert _got(H.mine_negatives(df, F.col("vec_id") % 4 == 0)) == want


def test_scores_are_exact():
    left = np.array([[2.0 ** 30, 3.0], [2.0 ** 40, 1.0], [1e300, 1.0]])
    right = np.array([[2.0 ** 30 + 1, 1.0], [5.0, 7.0], [-1e300, 0.0]])
    want = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y)), -(1 << 63)), (1 << 63) - 1) for y in right] for x in left]
    assert H.scores(left, right).tolist() == want
    assert H.scores(left[:1], right[:2]).tolist() == [x[:2] for x in want[:1]]


def test_empty_tables(spark):
    df = spark.createDataFrame([], KIND)
    assert H.mine_negatives(df, F.col("vec_id") % 4 == 0).count() == 0
    alone = spark.createDataFrame([(4, [1.0], 1, 1, "x")], KIND)
    assert H.mine_negatives(alone, F.col("vec_id") % 4 == 0).count() == 0
