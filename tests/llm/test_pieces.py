"""Encoding against a plain dynamic programme, decoding as an exact round trip."""

import dataclasses
import math

import numpy as np
import pyarrow as pa
import pytest

from stave.llm import pieces as P
from stave.llm.rolling import text_buffers

TEXTS = ["", " ", "  a", "a  b   ", "\n\n x", "猫 優梦 😀", "é ñ Ω", "▁ a▁b", "a" * 3000, "x\ty", "<s> </s> <0x41>", "   ", "The quick brown fox's 12 jumps, überall"]


@pytest.fixture(scope="module")
def vocabulary():
    return P.load_pieces()


@pytest.fixture(scope="module")
def auto(vocabulary):
    return P.Automaton(vocabulary)


def _plain(text, vocabulary, unknown):
    names = {s: i for i, (s, p) in enumerate(zip(vocabulary.spelled, vocabulary.plain)) if p}
    text = "▁" + "".join({" ": "▁", "▁": "\0"}.get(c, c) for c in text) if text else ""
    best = [(0.0, 0, None)]
    for end in range(1, len(text) + 1):
        top = (-math.inf, 0, None)
        for n in range(min(16, end), 0, -1):
            i = names.get(text[end - n: end])
            if i is None and n > 1:
                continue
            score = best[end - n][0] + (unknown if i is None else vocabulary.scores[i])
            if score > top[0]:
                top = (score, n, i)
        best.append(top)
    out, end = [], len(text)
    while end:
        _, n, i = best[end]
        out += [i] if i is not None else [vocabulary.bytes_at[b] for b in reversed((text[end - 1] if text[end - 1] != "\0" else "▁").encode())]
        end -= n
    return out[::-1]


def test_best_paths(spark, vocabulary, auto):
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:40]
    raw, bounds = text_buffers(pa.array(texts))
    ids, at = P.encode_slice(auto, raw, bounds)
    for i, text in enumerate(texts):
        assert ids[at[i]: at[i + 1]].tolist() == _plain(text, vocabulary, auto.unknown), text[:50]


def test_round_trip_and_clashing_columns(spark, vocabulary):
    rows = [(i, t, "kept") for i, t in enumerate([*TEXTS, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = P.decode(P.encode(docs, vocabulary, ids_col="pieces"), vocabulary, ids_col="pieces")
    got = {r.doc_id: r for r in both.collect()}
    assert len(got) == len(rows)
    assert all(got[i].decoded == (t or "") and got[i].ids == "kept" for i, t, _ in rows)
    assert P.encode(docs.where("false"), vocabulary).count() == 0


def test_automata_of_similar_vocabularies(vocabulary):
    turned = [*vocabulary.spelled]
    turned[1000], turned[1001] = turned[1001], turned[1000]
    other = dataclasses.replace(vocabulary, spelled=tuple(turned))
    mine, again = P.automaton(vocabulary), P.automaton(dataclasses.replace(vocabulary))
    assert mine is again and P.automaton(other) is not mine
    raw, bounds = text_buffers(pa.array([turned[1000].replace("▁", " ").strip()]))
    assert P.encode_slice(P.automaton(other), raw, bounds)[0].tolist() == _plain(turned[1000].replace("▁", " ").strip(), other, P.automaton(other).unknown)


def test_lone_bytes_decode_to_a_replacement(spark, vocabulary):
    df = spark.createDataFrame([(1, [vocabulary.bytes_at[0xE9]]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in P.decode(df, vocabulary).collect()} == {1: "�", 2: ""}


def test_long_word_is_linear(auto):
    raw, bounds = text_buffers(pa.array(["ab" * 20000]))
    ids, at = P.encode_slice(auto, raw, bounds)
    assert at[-1] == len(ids) > 0 and ids.dtype == np.int32
