"""DartMinHash: estimates, and classes against all pairs that share a shingle."""

import collections

import numpy as np

from stave.llm.dart_minhash import near_duplicate_classes, signatures

WHITE = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    left, weight = rng.integers(0, 1 << 63, 400).astype(np.uint64), rng.integers(1, 4, 400)
    for share in (0.9, 0.6, 0.3):
        same = rng.random(400) < share
        right = np.where(same, left, rng.integers(0, 1 << 63, 400).astype(np.uint64))
        row, value, w = np.repeat([0, 1], 400), np.concatenate([left, right]), np.concatenate([weight, weight]).astype(float)
        order = np.lexsort((value, row))
        found = signatures(row[order], value[order], w[order], 2, 2000)
        common = weight[same].sum()
        assert abs((found[0] == found[1]).mean() - common / (2 * weight.sum() - common)) < 0.04


def _shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(WHITE)
    w = [x for x in low.split(" ") if x]
    return collections.Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def _classes(rows, threshold=0.8):
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[t or ""].append(d)
    texts = list(ids)
    sets, parent = [_shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, j in {(i, j) for v in holders.values() for i in v for j in v if i < j}:
        common = sum((sets[i] & sets[j]).values())
        if common >= threshold * (sum(sets[i].values()) + sum(sets[j].values()) - common) - 1e-9:
            parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[root(i)] += ids[t]
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_classes(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(500, None), (501, ""), (502, " "), (503, "a b c"), (504, "A b  c"), (505, "a b c d"), (600, rows[5][1] + " x"), (601, "zz " * 900), (602, "zz " * 905), (600, rows[5][1] + " x")]
    words = rows[5][1].split()
    rows += [(700 + i, " ".join([*words[: 20 * i], "new", *words[20 * i:]])) for i in range(6)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = near_duplicate_classes(df).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in got:
        groups[r.class_id].append(str(r.doc_id))
    assert sorted(sorted(g) for g in groups.values()) == _classes(rows)
    assert all(min(map(int, g)) == c for c, g in groups.items())
    assert {r.doc_id for r in got if r.is_first} == set(groups)


def test_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id)) for r in near_duplicate_classes(df).collect()) == [("4", "None"), ("None", "None"), ("None", "None"), ("None", "None")]
    assert near_duplicate_classes(df.where("false")).count() == 0


def test_different_texts_without_an_id(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(100_000, size=60)) for _ in range(1500)]
    docs = spark.createDataFrame([(None, t + end) for t in texts for end in (" one", " two")], "doc_id long, text string")
    got = near_duplicate_classes(docs).collect()
    assert len(got) == 3000 and {r.n_texts for r in got} == {2} and sum(r.is_first for r in got) == 1500
