"""Near-duplicates by DartMinHash: weighted signatures from hashed darts, banded, then verified.

Each element throws darts into the plane (weight, rank): a Poisson number for each
dyadic cell, all from hashes, so equal elements throw equal darts everywhere. A document
catches the darts of its elements below their weights and below a rank that lets about
``k log k`` through; the earliest dart of each coordinate is its signature there, and
two documents agree in a coordinate with probability equal to their weighted Jaccard
similarity. Bands of the signature select candidates; candidates are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.graph import components
from stave.llm.repeats import NULL_ID, keyed
from stave.llm.rolling import Rolling, documents, mix, word_bounds, word_hashes
from stave.llm.steps import step

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Bands of more texts are compared in blocks of so many texts.
LISTED, BLOCK = 64, 256
_BASE_RANK = 0.5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(raw: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, multiplicity) of the word shingles of each row, ordered by row and hash; a shorter row has one of all its words."""
    low = _LOWER[raw]
    starts, ends, at = word_bounds(low, bounds)
    rolling = Rolling(word_hashes(low, starts, ends), "word")
    count = np.diff(at)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + at[row]
    value = rolling.stretch(first, np.minimum(first + words, at[row + 1]))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    lead = np.flatnonzero(new)
    return row[lead], value[lead], np.diff(np.append(lead, len(row)))


def _poisson_steps(area: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson count, to invert uniform numbers with."""
    most = int(area + 12 * math.sqrt(area) + 24)
    counts = np.arange(most)
    logs = counts * math.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))])
    return np.cumsum(np.exp(logs))


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate: an array (rows, k) of 64-bit values; a row without elements stays at the greatest value."""
    full = np.iinfo(np.uint64).max
    best = np.full(rows * k, full, np.uint64)
    total = np.bincount(row, weight, rows)
    todo = total > 0
    theta = np.where(todo, k * (math.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    steps: dict[float, np.ndarray] = {}
    while todo.any():
        use = todo[row]
        r, v, w = row[use], value[use], weight[use]
        limit = theta[r]
        weight_level, weight_from, weight_size = 0, 0.0, 1.0
        while True:
            heavy = np.flatnonzero(w > weight_from) if weight_level else np.arange(len(w))
            if not len(heavy):
                break
            rank_level, rank_from, rank_size = 0, 0.0, _BASE_RANK
            while True:
                near = heavy[limit[heavy] > rank_from]
                if not len(near):
                    break
                area = weight_size * rank_size
                if area not in steps:
                    steps[area] = _poisson_steps(area)
                cell = mix(v[near] + _GOLDEN * np.uint64(1 + weight_level * 64 + rank_level))
                darts = np.searchsorted(steps[area], (cell >> np.uint64(11)).astype(np.float64) * 2.0 ** -53, "right")
                who = np.repeat(near, darts)
                turn = np.arange(len(who)) - np.repeat(np.cumsum(darts) - darts, darts)
                dart = mix(np.repeat(cell, darts) + _GOLDEN * (turn.astype(np.uint64) + np.uint64(1)))
                rank = rank_from + rank_size * (dart >> np.uint64(32)).astype(np.float64) * 2.0 ** -32
                caught = rank < limit[who]
                if weight_level or np.any(w[near] < 1):
                    height = weight_from + weight_size * (mix(dart ^ _GOLDEN) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
                    caught &= height < w[who]
                who, dart, rank = who[caught], dart[caught], rank[caught]
                slot = r[who] * k + (((dart & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
                stamp = (np.minimum(rank * 2.0 ** 16, 2.0 ** 32 - 1).astype(np.uint64) << np.uint64(32)) | (mix(dart) >> np.uint64(32))
                np.minimum.at(best, slot, stamp)
                rank_level, rank_from, rank_size = rank_level + 1, rank_from + rank_size, max(rank_size, rank_from + rank_size)
            weight_level, weight_from, weight_size = weight_level + 1, weight_from + weight_size, max(weight_size, weight_from + weight_size)
        todo &= (best.reshape(rows, k) == full).any(axis=1)
        theta = np.where(todo, theta * 2, theta)
    return best.reshape(rows, k)


def _bands(shingle: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for a, b, raw, bounds in documents(batch, "_text"):
                row, value, weight = shingles(raw, bounds, shingle)
                size = np.bincount(row, weight, b - a).astype(np.int64)
                sig = signatures(row, value, weight.astype(np.float64), b - a, bands * rows)
                keys = mix((mix(sig) * salt).reshape(b - a, bands, rows).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                flat = pa.array(keys.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(a, b - a) for n in ("_d", "_t", "_k", "_x")] + [pa.array(size), lists], ["_d", "_t", "_k", "_x", "_n", "_bands"])

    return run


def _sets(shingle: int) -> Callable:
    """Each text's elements, repeats told apart by their number, as sorted 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, bounds in documents(batch, "_text"):
                row, value, weight = shingles(raw, bounds, shingle)
                turn = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                who = np.repeat(row, weight)
                each = mix(np.repeat(value, weight) + _GOLDEN * turn.astype(np.uint64))
                each = each[np.lexsort((each, who))]
                edges = (np.searchsorted(who, np.arange(b - a + 1)) * 8).astype(np.int64)
                blob = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(each)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_d").slice(a, b - a), batch.column("_t").slice(a, b - a), blob], ["_d", "_t", "_set"])

    return run


def _similar(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("_left"), batch.column("_right")
            ok = np.zeros(len(left), bool)
            for i in range(len(left)):
                ok[i] = _linked(*(np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right)), threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _linked(left: np.ndarray, right: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets are similar enough."""
    place = np.searchsorted(right, left)
    place[place == len(right)] = 0
    common = int(np.count_nonzero(right[place] == left)) if len(right) else 0
    return common >= threshold * (len(left) + len(right) - common) - 1e-9


def _in_blocks(divided: DataFrame, texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between the minor components of large bands and the rest of their bands.

    Both sides are dealt into blocks by a hash, and each pair of blocks is one group of
    bounded size. A pair that meets in several bands is compared in the first of them.
    """
    rows = divided.select("band", "_i", "node", "root", "_all", (F.col("root") != F.col("top.root")).alias("minor"), F.col("top._m").alias("_major"))
    rows = rows.join(texts.select("node", "_bands"), "node").join(sets, "node")
    blocks, minors = F.ceil(F.col("_all") / BLOCK).cast("int"), F.ceil((F.col("_all") - F.col("_major")) / BLOCK).cast("int")
    part = F.xxhash64("node")
    keep = ["band", "_i", "node", "root", "_bands", "_set"]
    left = rows.where("minor").withColumns({"p": F.pmod(part, minors).cast("int"), "q": F.explode(F.sequence(F.lit(0), blocks - 1))}).select(*keep, "p", "q")
    right = rows.withColumns({"q": F.pmod(part, blocks).cast("int"), "p": F.explode(F.sequence(F.lit(0), minors - 1))})
    right = right.select(*(F.col(c).alias(f"other{c}") for c in (*keep, "p", "q")))

    def compare(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(other):
            bands, sizes = np.stack(other["other_bands"]), np.array([len(x) for x in other["other_set"]])
            others, roots = [np.frombuffer(x, np.uint64) for x in other["other_set"]], [(r["_d"], r["_t"]) for r in other["otherroot"]]
            roots = np.array(roots, np.int64)
            for band, node, root, own, blob in zip(mine["_i"], mine["node"], mine["root"], mine["_bands"], mine["_set"]):
                near = np.minimum(sizes, len(blob)) >= threshold * np.maximum(sizes, len(blob)) - 1e-9
                near &= (roots != [root["_d"], root["_t"]]).any(axis=1)
                near &= (bands == np.asarray(own)).argmax(axis=1) == band
                for j in np.flatnonzero(near):
                    if _linked(np.frombuffer(blob, np.uint64), others[j], threshold):
                        out.append((node, other["othernode"].iloc[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    pairs = left.groupBy("band", "p", "q").cogroup(right.groupBy("otherband", "otherp", "otherq"))
    return pairs.applyInPandas(compare, "a struct<_d:bigint,_t:bigint>, b struct<_d:bigint,_t:bigint>")


def near_duplicate_classes(docs: DataFrame, threshold: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                           id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """One row per input row: id, ``class_id`` (the least id of its class), ``is_first``, ``n_texts`` (different texts in the class).

    A class is a connected component of the links between texts whose weighted Jaccard
    similarity of word shingles (lower-case ASCII, weights: multiplicities) is at least
    ``threshold``. Equal texts are one text before anything is compared. With 24 bands of
    5 coordinates, a pair at 0.8 meets in some band with probability 0.9999.

    Pairs are made in steps that keep hot bands linear: every text with the first of its
    bands, then with one text of the largest component met in each band still divided,
    and last all remaining pairs across components of one band: listed where the band
    is small, else compared block by block, which moves each text once for every block
    of others instead of once for every other. Texts without a word
    (null, empty, blanks) are classes of equal texts. Repeated rows share a class, of
    which one row is first. A null id comes first and gives a null class id. Other
    columns are ignored. With ``tag_col`` the hash ``xxhash64`` of the text is added.
    """
    base = keyed(docs, id_col, text_col)
    signed = step(base.withColumns({"_k": F.unhex(F.md5("_text")), "_x": F.xxhash64("_text")}).mapInArrow(
        _bands(shingle, bands, rows), "_d long, _t long, _k binary, _x long, _n long, _bands array<long>"), "darts")
    texts = signed.groupBy("_k").agg(F.min(F.struct("_d", "_t", "_n", "_bands")).alias("s"))
    texts = step(texts.select("_k", F.struct("s._d", "s._t").alias("node"), "s._n", "s._bands"), "texts")
    met = texts.where("_n > 0").select("node", "_n", F.posexplode("_bands").alias("_i", "_h"))
    heads = met.groupBy("_i", "_h").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    met = step(met.join(heads.drop("_m"), ["_i", "_h"]).select(F.xxhash64("_i", "_h").alias("band"), "_i", "node", "_n", "head"), "met")
    members = met.select("node", "_n").distinct()
    wanted = members.select(F.col("node._d").alias("_d"), F.col("node._t").alias("_t"))
    sets = base.join(wanted.hint("shuffle_hash"), ["_d", "_t"], "left_semi")
    sets = step(sets.mapInArrow(_sets(shingle), "_d long, _t long, _set binary").groupBy("_d", "_t").agg(F.first("_set").alias("_set"))
                  .select(F.struct("_d", "_t").alias("node"), "_set"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("_set").alias("_left")), "a").join(sets.select(F.col("node").alias("b"), F.col("_set").alias("_right")), "b")
        return both.select("a", "b", "_left", "_right").mapInArrow(_similar(threshold), "a struct<_d:bigint,_t:bigint>, b struct<_d:bigint,_t:bigint>")

    def sized(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.least("x", "y") >= threshold * F.greatest("x", "y") - 1e-9).select("a", "b").distinct()

    size = members.select(F.col("node").alias("b"), F.col("_n").alias("y"))
    first = met.where("node <> head").groupBy(F.col("node").alias("a"), F.col("_n").alias("x")).agg(F.min("head").alias("b"))
    links = step(verified(sized(first.join(size, "b"))), "links")
    for last in (False, True):
        roots = components(links)
        placed = met.join(roots, "node", "left").select("band", "_i", "node", "_n", F.coalesce("root", "node").alias("root"))
        groups = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct("node", "_n")).alias("pick"))
        major = groups.groupBy("band").agg(F.max(F.struct("_m", "root", "pick")).alias("top"), F.count(F.lit(1)).alias("_groups"), F.sum("_m").alias("_all")).where("_groups > 1")
        divided = step(placed.join(major.select("band", "top", "_all"), "band"), "divided")
        minor = divided.where(F.col("root") != F.col("top.root"))
        if last:
            few = F.col("_all") <= LISTED
            mine = minor.where(few).select("band", F.col("node").alias("a"), F.col("_n").alias("x"), F.col("root").alias("ra"))
            other = divided.where(few).select("band", F.col("node").alias("b"), F.col("_n").alias("y"), F.col("root").alias("rb"))
            near = F.least("x", "y") >= threshold * F.greatest("x", "y") - 1e-9
            pairs = mine.join(other, "band").where((F.col("ra") != F.col("rb")) & near)
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "x", "y")
            found = verified(sized(pairs)).unionByName(_in_blocks(divided.where(~few), texts, sets, threshold))
        else:
            found = verified(sized(minor.select(F.col("node").alias("a"), F.col("_n").alias("x"), F.col("top.pick.node").alias("b"), F.col("top.pick._n").alias("y"))))
        links = step(links.unionByName(found), "links")
    roots = components(links)
    named = texts.join(roots, "node", "left").select("_k", F.coalesce("root", "node").alias("root"))
    counts = named.groupBy("root").agg(F.count(F.lit(1)).alias("n_texts"))
    named = named.join(counts, "root")
    rows_named = signed.select("_d", "_t", "_k", "_x").join(named, "_k")
    least = F.col("root._d")
    tag = [F.col("_x").alias(tag_col)] if tag_col else []
    out = rows_named.select(
        F.when(F.col("_d") != NULL_ID, F.col("_d")).alias(id_col), F.when(least != NULL_ID, least).alias("class_id"),
        ((F.col("_d") == least) & (F.col("_t") == F.col("root._t"))).alias("is_first"), "n_texts", *tag)
    return out


def op2_dart_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
