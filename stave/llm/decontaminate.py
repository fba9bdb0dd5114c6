"""Benchmark decontamination: passages of documents within a small edit distance of an item.

The CGK embedding walks over a word sequence: at each step it writes the current word and
moves on only if a hash of (step, word) says so. Sequences with few edits fall into step
again soon after each edit, so edit distance becomes Hamming distance between the walks.
Sampling a few steps of a walk is a locality-sensitive hash, and several walks reach a
target recall. What they find is verified by exact edit distance.

Walks over many words drift apart, so long items are cut into pieces. One piece of an item
has no more than its share of the edits; wherever its walks meet those of a document, the
whole item is compared there. How many walks a length of piece needs is found by trial
edits at the allowed rate. Walks start only where a document shares an intact run of words
with a piece: k edits leave at least one of k + 1 stretches as it is, so nothing is lost by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.repeats import NULL_ID
from stave.llm.rolling import Rolling, documents, mix, text_buffers, word_bounds, word_hashes

RATE = 0.15
#: Words of a piece at most, sampled steps of a walk, the recall asked of a piece's walks, and their number at most.
PIECE, SAMPLES, RECALL, MOST_WALKS = 48, 3, 0.9999, 128
BLOCK_BYTES = 16 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _FOLD[_c] = 0x20


def folded_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, ASCII letters in lower case and punctuation read as blanks, and their bounds."""
    raw = _FOLD[raw]
    starts, ends, at = word_bounds(raw, bounds)
    return word_hashes(raw, starts, ends), at


def walk_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, walk: int) -> np.ndarray:
    """A hash of the sampled steps of one CGK walk over ``length`` words from each start; past the end it writes blanks."""
    steps = 2 * length
    sampled = set(np.random.default_rng([walk, length]).choice(steps, min(SAMPLES, steps), replace=False).tolist())
    padded = np.append(words, np.uint64(0))
    turns = [mix(padded ^ np.uint64(0x9E3779B97F4A7C15 * (walk * 64 + i + 1) % (1 << 64))) for i in range(max(sampled) // 64 + 1)]
    place, key = start.copy(), np.zeros(len(start), np.uint64)
    for j in range(max(sampled) + 1):
        here = np.where(place < end, place, len(words))
        if j in sampled:
            key = mix(key + padded[here] + np.uint64(j + 1))
        place = place + ((turns[j // 64][here] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return key


@cache
def walks_needed(length: int, size: int, edits: int, trials: int = 300) -> int:
    """Walks over ``length`` words that find pieces of ``size`` words with so many edits as often as asked, by trial.

    Each trial edits a piece of random words in random places; a walk finds it if it agrees
    from any start that the edits can shift the piece to.
    """
    rng = np.random.default_rng([length, size, edits])
    pieces, texts = [], []
    for _ in range(trials):
        words = rng.integers(1, 1 << 62, size).tolist()
        pieces.append(words)
        edited = list(words)
        for _ in range(edits):
            kind, place = rng.integers(3), int(rng.integers(max(len(edited), 1)))
            if kind == 0 and edited:
                edited[place] = int(rng.integers(1, 1 << 62))
            elif kind == 1:
                edited.insert(place, int(rng.integers(1, 1 << 62)))
            elif edited:
                edited.pop(place)
        around = rng.integers(1, 1 << 62, edits + 2 * size).tolist()
        texts.append(around[:edits] + edited + around[edits: 2 * size + edits - len(edited)])
    pieces, texts = np.array(pieces, np.uint64), np.array(texts, np.uint64)
    starts = (np.arange(trials)[:, None] * texts.shape[1] + np.arange(2 * edits + 1)).reshape(-1)
    ends = np.repeat((np.arange(trials) + 1) * texts.shape[1], 2 * edits + 1)
    own = np.arange(trials) * size
    missed = np.ones(trials)
    hits = np.zeros(trials)
    for walk in range(MOST_WALKS):
        key = walk_keys(pieces.reshape(-1), own, own + size, length, walk)
        hits += (walk_keys(texts.reshape(-1), starts, ends, length, walk).reshape(trials, -1) == key[:, None]).any(axis=1)
    # Half a hit more keeps a piece that no walk has found yet from counting as hopeless.
    share = (hits + 0.5) / (MOST_WALKS + 1)
    for walks in range(1, MOST_WALKS):
        missed *= 1 - share
        if missed.mean() <= 1 - RECALL:
            return walks
    return MOST_WALKS


@dataclass
class Items:
    """A block of benchmark items: ids and word hashes, and for each length class of their pieces the runs to look up and the walk keys."""

    ids: np.ndarray
    words: np.ndarray
    at: np.ndarray
    rate: float

    def __post_init__(self):
        n = np.diff(self.at)
        self.most = np.floor(self.rate * n).astype(np.int64)
        cuts = -(-n // PIECE)
        self.item = np.repeat(np.arange(len(n)), cuts)
        turn = np.arange(len(self.item)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        many = cuts[self.item]
        self.offset = turn * n[self.item] // np.maximum(many, 1)
        size = (turn + 1) * n[self.item] // np.maximum(many, 1) - self.offset
        self.start = self.at[self.item] + self.offset
        self.slack = np.floor(self.rate * size).astype(np.int64)
        rolling = Rolling(self.words, "word")
        runs = np.maximum(1, -(-(size - self.slack) // (self.slack + 1)))
        # A class holds the pieces of 2**(c/2) words or more; its walks cover that many words.
        level = np.floor(2 * np.log2(np.maximum(size, 1)) + 1e-9).astype(int)
        self.classes: list[tuple[int, list, list]] = []
        for c in sorted(set(level.tolist())):
            members = np.flatnonzero(level == c)
            length = int(math.ceil(2 ** (c / 2) - 1e-9))
            seeds = []
            for run in sorted(set(runs[members].tolist())):
                some = members[runs[members] == run]
                places = size[some] - run + 1
                owner = np.repeat(some, places)
                offset = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
                grams = rolling.stretch(self.start[owner] + offset, self.start[owner] + offset + run)
                order = np.argsort(grams, kind="stable")
                sieve = np.zeros(1 << 16, bool)
                sieve[(grams & np.uint64(0xFFFF)).astype(np.int64)] = True
                seeds.append((run, sieve, grams[order], owner[order], offset[order]))
            walks = max(walks_needed(length, int(m), int(np.floor(self.rate * m))) for m in np.unique(size[members]))
            keys = []
            for walk in range(walks):
                key = walk_keys(self.words, self.start[members], self.start[members] + size[members], length, walk)
                order = np.argsort(key, kind="stable")
                keys.append((key[order], members[order]))
            self.classes.append((length, seeds, keys))


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least number of word edits between the item and any stretch of the text, and the end of that stretch."""
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    end = int(np.argmin(row))
    return int(row[end]), end


def _many(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each first to below each last, and which pair each is of."""
    count = last - first
    which = np.repeat(np.arange(len(first)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count - first, count), which


def _scan(items: Items) -> Callable:
    def starts(words: np.ndarray, at: np.ndarray, rolling: Rolling, seeds: list) -> tuple[np.ndarray, np.ndarray]:
        """Where a piece may start, as far as edits can shift it against an intact run, and the documents of these places."""
        edge = np.zeros(len(words) + 1, np.int64)
        for run, sieve, grams, owner, offset in seeds:
            there = rolling.grams(run)
            hit = np.flatnonzero(sieve[(there & np.uint64(0xFFFF)).astype(np.int64)])
            doc = np.searchsorted(at, hit, "right") - 1
            inside = hit + run <= at[doc + 1]
            hit, doc = hit[inside], doc[inside]
            seed, which = _many(np.searchsorted(grams, there[hit]), np.searchsorted(grams, there[hit], "right"))
            about, head, slack = hit[which] - offset[seed], at[doc[which]], items.slack[owner[seed]]
            np.add.at(edge, np.maximum(about - slack, head), 1)
            np.add.at(edge, np.maximum(about + slack, head) + 1, -1)
        start = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        return start, np.searchsorted(at, start, "right") - 1

    def met(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(item, document, start of the item there if nothing were shifted) wherever a walk of a piece agrees."""
        rolling, out = Rolling(words, "word"), [np.zeros((0, 3), np.int64)]
        for length, seeds, keys in items.classes:
            start, doc = starts(words, at, rolling, seeds)
            if not len(start):
                continue
            # The walks only see the words they can reach.
            reach = np.zeros(len(words) + 1, np.int64)
            np.add.at(reach, start, 1)
            np.add.at(reach, np.minimum(start + 2 * length + 1, at[doc + 1]), -1)
            seen = np.cumsum(reach)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(seen)])
            near, begin, stop = words[seen], upto[start], upto[at[doc + 1]]
            for walk, (known, piece) in enumerate(keys):
                key = walk_keys(near, begin, stop, length, walk)
                place, which = _many(np.searchsorted(known, key), np.searchsorted(known, key, "right"))
                out.append(np.unique(np.stack([items.item[piece[place]], doc[which], start[which] - items.offset[piece[place]]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def found(words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        pairs = met(words, at)
        out, i = [], 0
        while i < len(pairs):
            item, d, lead = pairs[i]
            size, most, j = int(items.at[item + 1] - items.at[item]), int(items.most[item]), i + 1
            while j < len(pairs) and pairs[j, 0] == item and pairs[j, 1] == d and pairs[j, 2] - pairs[j - 1, 2] <= size:
                j += 1
            low, high = max(int(lead) - 2 * most - 1, int(at[d])), min(int(pairs[j - 1, 2]) + size + 3 * most + 2, int(at[d + 1]))
            wanted, text = items.words[items.at[item]: items.at[item + 1]], words[low:high]
            if np.count_nonzero(np.isin(wanted, text)) >= size - most:
                distance, end = edit_distance(wanted, text)
                if distance <= most:
                    out.append((int(d), int(item), low + end - int(at[d]), distance, size))
            i = j
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, bounds in documents(batch, "_text"):
                rows = found(*folded_words(raw, bounds))
                if rows:
                    doc, item, end, distance, size = (np.array(x, np.int64) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(n).slice(a, b - a).take(pa.array(doc)) for n in ("_d", "_x")), pa.array(items.ids[item]), pa.array(end), pa.array(distance), pa.array(size)],
                        ["_d", "_x", "item_id", "end_word", "distance", "item_words"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """(id, item_id, end_word, distance, item_words): each document that holds a passage within the distance of an item.

    The distance counts inserted, dropped and replaced words; allowed are ``rate`` times the
    item's words. Of several passages of one item in a document the nearest is told, then
    the first; documents of one id (or without one) and different texts are told apart. Words are compared in lower case (ASCII) and without punctuation. Null,
    empty or blank texts and items match nothing; repeated rows repeat their leaks, once
    for each id and text; a null document id is kept, items without an id are left out. With
    ``tag_col`` the hash ``xxhash64`` of the text (null: empty) is added. The number of
    walks is chosen for a recall of 0.9999 at the allowed distance on random edits, for
    items of any length (tested from 1 to 1,000 words); what is reported is exact.

    The items are the stated query set: they go to all tasks in blocks of 16 MB of text,
    one pass over the documents for each block.
    """
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_d"), F.xxhash64(text).alias("_x"), text.alias("_text"))
    kind = "_d long, _x long, item_id long, end_word long, distance long, item_words long"
    out = None
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "_text"), F.lit(blocks)) == block).collect()
        raw, bounds = text_buffers(pa.array([r["_text"] for r in part], pa.string()))
        words, at = folded_words(raw, bounds)
        hits = texts.mapInArrow(_scan(Items(np.array([r["item_id"] for r in part], np.int64), words, at, rate)), kind)
        out = hits if out is None else out.unionByName(hits)
    best = out.groupBy("_d", "_x", "item_id").agg(F.min(F.struct("distance", "end_word", "item_words")).alias("m"))
    tag = [F.col("_x").alias(tag_col)] if tag_col else []
    return best.select(F.when(F.col("_d") != NULL_ID, F.col("_d")).alias(id_col), *tag, "item_id", "m.end_word", "m.distance", "m.item_words")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
