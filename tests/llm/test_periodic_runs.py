"""Periodic runs against a plain search over all starts and periods."""

import hashlib
import random
import re
import zlib

import pytest

from stave.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _runs(words, min_length=6, min_periods=4):
    """Maximal stretches of each period, without those of a multiple of a smaller period."""
    n, found = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[j] == words[j + d] for j in range(start, start + length - d)) for d in range(1, q))
            if length >= max(min_length, min_periods * q) and not smaller:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _planted(d, words):
    h = zlib.crc32(str(d).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def _texts():
    rng = random.Random(5)
    out = ["a " * 500, "a b " * 90 + "c", "x y a b a b a b a b c a b a b a b a b", "é\tü \n" * 9, "a", "", " \n ", None, "a a a a a", "a a a a a a", "a b a b a b a b", "a b c " * 3]
    for letters in (1, 2, 3):
        out += [" ".join(rng.choice("abc"[:letters]) for _ in range(rng.randint(1, 70))) for _ in range(60)]
    for _ in range(40):
        block = " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        inner = " ".join([" ".join([block] * rng.randint(3, 6)), rng.choice("abcd")])
        out.append(" ".join([inner] * rng.randint(1, 6)))
    return out


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (9, 3)])
def test_runs_against_all_periods(spark, least, periods):
    texts = _texts()
    df = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)], "doc_id long, text string, runs int").repartition(2)
    got = sorted(((r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in P.periodic_runs(df, least, periods).collect()), key=str)
    want = []
    for t in [*texts, texts[1]]:
        words = WORD.findall(t or "")
        runs = _runs(words, least, periods)
        want.append((len(words), tuple(runs), _collapsed(words, runs)))
    assert got == sorted(want, key=str)


def test_query(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = [(d, t) for d, t in docs if len(t or "") < 6000] + [(1000 + i, t) for i, t in enumerate(_texts())] + [(None, "a b " * 10), (1000, "a " * 500)]
    spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in P.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in docs:
        words = WORD.findall(t or "")
        words = words if d is None else _planted(d, words)
        runs = _runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((d, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(_collapsed(words, runs).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000)) + " " + "again and again " * 100_000
    got = P.periodic_runs(spark.createDataFrame([(1, long), (2, "z " * 600_000)], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[1].runs] == [(200_000, 300_000, 3)] and by[1].collapsed.endswith("w199999 again and again")
    assert [tuple(x) for x in by[2].runs] == [(0, 600_000, 1)] and by[2].collapsed == "z"


def test_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
