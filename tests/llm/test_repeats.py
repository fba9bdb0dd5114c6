"""Repeated passages against brute force over all windows."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stave.llm import repeats
from stave.llm.substring_dedup import cut_earlier_passages
from stave.llm.suffix_dedup import cut_repeated_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    odd = [(500, None), (501, ""), (None, docs[3][1]), (None, docs[3][1]), (7, docs[9][1]), (7, docs[7][1]), (502, "a" * 900), (503, "ab " * 400),
           (504, "a" * 450), (505, " \n "), (506, "x y " * 60), (507, "zz " * 30), (508, "é" * 300), (509, "x" + "é" * 300)]
    return docs + odd


def _sorted(x):
    return sorted(x, key=lambda r: tuple(map(str, r)))


def test_words_of_smaller_ids(spark, rows):
    def key(d):
        return float("-inf") if d is None else d

    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for p in range(len(w) - 12):
            k = tuple(w[p: p + 13])
            first[k] = min(first.get(k, key(d)), key(d))
    want = []
    for d, w in docs:
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p: p + 13])] < key(d):
                gone.update(range(p, p + 13))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _g int").repartition(3)
    got = cut_earlier_passages(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert _sorted(map(tuple, got.collect())) == _sorted(want)


def test_bytes_repeated_anywhere(spark, rows):
    docs = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[p: p + 400] for _, b in docs for p in range(len(b) - 399))
    want = []
    for d, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if count[b[p: p + 400]] > 1:
                gone[p: p + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cut_repeated_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert _sorted(map(tuple, got.collect())) == _sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert cut_repeated_bytes(df).count() == 0
    assert cut_earlier_passages(df).count() == 0


def test_different_texts_without_an_id(spark):
    rng = np.random.default_rng(4)
    passage = "".join(chr(97 + x) for x in rng.integers(26, size=450))
    starts = ["".join(chr(65 + x) for x in rng.integers(26, size=n)) for n in rng.integers(20, 380, size=2000)]
    texts = [f"{s}{passage}{s}" if i % 2 else s for i, s in enumerate(starts)]
    count, want = collections.Counter(t[p: p + 400] for t in texts for p in range(len(t) - 399)), collections.Counter()
    for t in texts:
        gone = {i for p in range(len(t) - 399) if count[t[p: p + 400]] > 1 for i in range(p, p + 400)}
        want["".join(c for i, c in enumerate(t) if i not in gone)] += 1
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert collections.Counter(bytes(r.kept).decode() for r in cut_repeated_bytes(docs).collect()) == want


def test_equal_rows_add_no_marks(spark, monkeypatch):
    """Marks of a text are bounded by the text, however many equal rows there are."""
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(10_000, size=150))
    sizes = []
    plain = repeats.step

    def watched(df, label):
        out = plain(df, label)
        if label == "marks":
            sizes.append(out.agg(F.max(F.size("_marks")).alias("n")).first().n)
        return out

    monkeypatch.setattr(repeats, "step", watched)
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = cut_repeated_bytes(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed, r["count"]) for r in got} == {(None, len(text), 20_000), (1, len(text), 1)}
    got = cut_earlier_passages(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {(r.doc_id, r.n_removed, r["count"]) for r in got} == {(None, 0, 20_000), (1, 150, 1)}
    assert max(sizes) <= len(text)
