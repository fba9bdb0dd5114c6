"""Leaks: recall at the allowed distance, exactness of what is reported."""

import numpy as np
import pyarrow as pa

from stave.llm import decontaminate as D
from stave.llm.rolling import text_buffers


UPPER = {c: c - 32 for c in range(97, 123)}


def _edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        kind, place = rng.integers(3), rng.integers(len(words))
        if kind == 0:
            words[place] = f"zz{rng.integers(1000)}"
        elif kind == 1:
            words.insert(place, f"yy{rng.integers(1000)}")
        elif len(words) > 1:
            words.pop(place)
    return " ".join(words)


def test_recall_and_verbatim(spark):
    base = "/root/testdata/sf0.001"
    items = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    raw, bounds = text_buffers(pa.array([t for _, t in items]))
    words, at = D.folded_words(raw, bounds)
    most = D.Items(np.arange(len(items)), words, at, D.RATE).most
    rng, planted = np.random.default_rng(3), {}
    for turn in range(4):
        for i, (item, text) in enumerate(items):
            doc = 10_000 + turn * len(items) + i
            planted[doc] = (item, docs[i % len(docs)][1][:200].rpartition(" ")[0] + " " + _edited(rng, text.translate(UPPER), int(most[i])) + " " + docs[i % len(docs)][1][:100])
    table = spark.createDataFrame(docs + [(d, t) for d, (_, t) in planted.items()] + [(None, items[0][1]), (5_000, None), (5_001, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(table, spark.createDataFrame(items + [(None, "x y"), (9_999, None)], "item_id long, text string")).collect()}
    assert (None, items[0][0]) in got
    assert sum((d, item) in got for d, (item, _) in planted.items()) >= 0.99 * len(planted)
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= set(got)
    assert all(0 <= r.distance <= D.RATE * r.item_words for r in got.values())


def test_every_passage_of_long_items(spark):
    rng = np.random.default_rng(11)
    sizes = [1, 3, 7, 8, 15, 60, 100, 300, 600, 1000]
    items = [(i, " ".join(f"w{x}" for x in rng.integers(5000, size=n))) for i, n in enumerate(sizes)]
    docs = []
    for turn in range(12):
        for i, text in items:
            around = [" ".join(f"v{x}" for x in rng.integers(5000, size=30)) for _ in range(2)]
            docs.append((len(items) * turn + i, f"{around[0]} {_edited(rng, text, int(D.RATE * sizes[i]))} {around[1]}"))
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, d % len(items)) for d, _ in docs} <= got


def test_against_the_distance_to_every_stretch(spark):
    base = "/root/testdata/sf0.001"
    rng = np.random.default_rng(9)
    items = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").select("item_id", "text").limit(15).collect()]
    items += [(7_000 + n, " ".join(f"w{x}" for x in rng.integers(40, size=n))) for n in (1, 2, 9, 70, 130)]
    docs = [tuple(r) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()][:60]
    docs += [(20_000 + i, f"{docs[i % 9][1][:90]} {_edited(rng, t, int(k * D.RATE * len(t.split())))} {docs[i % 7][1][:60]}") for k in (0.5, 1, 1.3) for i, (_, t) in enumerate(items)]

    def words(text):
        return "".join(c.lower() if "A" <= c <= "Z" else " " if c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in text).split()

    want = set()
    for d, text in docs:
        mine = words(text)
        for i, t in items:
            row = [0] * (len(mine) + 1)
            for n, w in enumerate(words(t)):
                new = [n + 1]
                for j, x in enumerate(mine):
                    new.append(min(row[j] + (x != w), row[j + 1] + 1, new[j] + 1))
                row = new
            if min(row) <= D.RATE * len(words(t)):
                want.add((d, i, row.index(min(row)), min(row), len(words(t))))
    got = D.leaks(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(map(tuple, got.collect())) == want and len(want) > 30


def test_edit_distance_finds_the_best_stretch():
    text = np.array([9, 9, 1, 2, 4, 5, 9], np.uint64)
    assert D.edit_distance(np.array([1, 2, 3, 4, 5], np.uint64), text) == (1, 6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert D.leaks(none, items).count() == 0
    assert D.leaks(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.where("false")).count() == 0
