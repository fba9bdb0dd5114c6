"""Language profiles on held-out rows; the pipeline against what its stages must do."""

import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as C
from stave.llm import hd_language as H
from stave.llm.queries import ORACLES, QUERIES
from stave.llm.rolling import text_buffers

BASE = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_held_out_accuracy(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text", "lang").collect()]
    odd = [(3000, None, "en"), (3001, "123 $$", "en"), (3002, "😀 1", None), (None, "the and of", "en"), (3003, "the that with", None)]
    spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in H.op9_hd_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (d is None or zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 for d, r in got.items())
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (3000, 3001, 3002))
    judged = [(d, lang) for d, _, lang in rows if got[d].held_out and got[d].lang_pred != "und"]
    assert len(judged) > 30 and sum(got[d].lang_pred == lang for d, lang in judged) >= 0.97 * len(judged)


def test_vectors_against_plain_sums():
    texts = ["Ab, cab!", "", "éa"]
    raw, bounds = text_buffers(pa.array(texts))
    row, gram, count, spelled = H.gram_counts(raw, bounds, 3)
    got = {(int(r), "".join(chr(c) if c else "_" for c in spelled[g])): int(n) for r, g, n in zip(row, gram, count)}
    assert got == {(0, "_ab"): 1, (0, "ab_"): 2, (0, "b_c"): 1, (0, "_ca"): 1, (0, "cab"): 1, (2, "_éa"): 1}
    vectors = H.gram_vectors(spelled, 64)
    letters = H.gram_vectors(np.unique(spelled)[:, None], 64)
    table = dict(zip(np.unique(spelled).tolist(), letters))
    for v, s in zip(vectors, spelled):
        assert np.array_equal(v, np.roll(table[s[0]], 2) * np.roll(table[s[1]], 1) * table[s[2]])


def test_texts_of_one_letter(spark):
    known = H.profiles(spark.read.parquet(f"{BASE}/documents.parquet"))
    texts = ["a", "the", "é", "5 b", "...", "", "b 5", "x", "12 e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in H.identify(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), known).collect()}
    assert all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in t)) for i, t in rows)
    assert all(got[i].score == 0 for i in (4, 5))


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert H.profiles(docs) == {} and H.identify(docs, {}).first().lang_pred == "und"


def test_stages(spark):
    source = spark.read.parquet(f"{BASE}/documents.parquet").select(*COLUMNS)
    item = spark.read.parquet(f"{BASE}/benchmark.parquet").first().text
    base = source.orderBy("doc_id").first()
    odd = [
        (900, None, "en", "s", None), (901, "123 ...", "en", "s", 7), (902, base.text, "en", "s", 1), (903, base.text + " end", None, None, 2), (904, "before it " * 9 + item + " after", "en", "s", 3),
        (905, "my password=hunter22 stays out of this text", "en", "s", 4), (906, "", "en", "s", 0), (905, "my password=hunter22 stays out of this text", "en", "s", 4),
    ]
    docs = source.unionByName(spark.createDataFrame(odd, source.schema))
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, BASE)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes, name
        docs = C.step(out, "test")
    kept = {r.doc_id: r for r in docs.collect()}
    assert len(kept) == docs.count()
    assert not {900, 901, 902, 903, 904, 906} & set(kept) and base.doc_id in kept
    assert kept[905].text == "my [secret] stays out of this text" and kept[905].n_chars == 34
    clean = source.join(spark.read.parquet(f"{BASE}/benchmark.parquet").select(F.col("text").alias("item")), F.expr("contains(text, item)"), "left_anti").dropDuplicates(["text"])
    assert len(kept) >= 0.9 * clean.count()
    last = C.STAGES[4][1](spark, docs, BASE).collect()
    assert len(last) == len(kept) and all(r.round_trip and r.n_ids == len(r.ids) for r in last)


def test_language_stage_rejects_what_is_in_no_language(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*COLUMNS)
    rng = np.random.default_rng(5)

    def words(alphabet, n):
        return " ".join("".join(alphabet[x] for x in rng.integers(len(alphabet), size=rng.integers(2, 9))) for _ in range(n))

    noise = [words(alphabet, n) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя") for n in (100, 300) for _ in range(50)]
    clean = [r.text for r in source.where("length(text) > 200").orderBy("doc_id").limit(300).collect()]
    short = [" ".join(t.split()[:n]) for t in clean for n in (1, 2, 4, 8, 16)]
    short = [t for t in short if any(c.isalpha() for c in t)]
    rows = [(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(noise)] + [(20_000 + i, t, None, "s", len(t)) for i, t in enumerate(short)]
    kept = {r.doc_id for r in C.language_id(spark, source.unionByName(spark.createDataFrame(rows, source.schema)), BASE).select("doc_id").collect()}
    assert sum(10_000 <= d < 20_000 for d in kept) <= 0.03 * len(noise)
    assert sum(d >= 20_000 for d in kept) >= 0.97 * len(short)
    assert sum(d < 10_000 for d in kept) >= 0.98 * source.count()


def test_leaks_of_one_id_are_told_apart(spark):
    item = spark.read.parquet(f"{BASE}/benchmark.parquet").first().text
    rows = [(d, f"{start} {x}", "en", "s", 1) for d in (None, 7) for start in ("one", "two") for x in (item, "is a clean text")]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    kept = C.decontaminate(spark, docs, BASE)
    assert kept.columns == COLUMNS and collections.Counter(map(tuple, kept.collect())) == collections.Counter(r for r in rows if item not in r[1])
    found = C.leaks(docs, spark.read.parquet(f"{BASE}/benchmark.parquet").limit(1))
    assert found.count() == 4 and found.where("doc_id IS NULL").count() == 2


def test_run_and_empty_table(spark, tmp_path):
    source = spark.read.parquet(f"{BASE}/documents.parquet")
    source.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{BASE}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert C.ORACLE_SQL is None and [n for n in QUERIES if n.startswith("op")] == sorted((n for n in QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and not ORACLES


def test_floors_come_from_every_learned_text(spark, monkeypatch):
    """Whatever number of rows was once thought enough, the least scores of all of them count."""
    import corpus_pipeline as P

    monkeypatch.setattr(P, "SAMPLE", 1, raising=False)
    docs = spark.createDataFrame([(i, "the cat sat on a mat and slept there", "en") for i in range(P.LEAST)], "doc_id long, text string, lang string")
    assert P.floors(docs, P.profiles(docs, dimensions=P.SIGNS))
