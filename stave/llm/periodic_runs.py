"""Periodic runs of words, found by joining suffix classes in order of decreasing common prefix.

The suffixes of a text are ordered by prefix doubling, and neighbours in that order are
joined with their longest common prefix (LCP) as weight. Kruskal's algorithm takes these
from the longest down: at each LCP the classes are the sets of positions whose suffixes
share that many words. When two classes unite, positions that become neighbours *in the
text* at a distance within the LCP repeat with that distance as period, and the pair at
the start of a maximal run becomes such a neighbour exactly once, at its own LCP. Its
distance is then the smallest period, since a smaller one would put a position of the
same class in between.

A document is worked on alone: documents are rows, texts of one megabyte together are
ordered in one numpy pass, and a longer text is a pass of its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.llm.repeats import joined_words
from stave.llm.rolling import Rolling, documents, word_bounds, word_hashes

MIN_LENGTH, MIN_PERIODS = 6, 4


def suffix_order(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of all rows' suffixes, row by row and in order within each, by prefix doubling.

    Only places that still share a rank are sorted again, so texts with short common
    prefixes are done after a few rounds.
    """
    n = len(values)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][row]
    order = np.lexsort((values, row))
    new = np.append(True, (row[order[1:]] != row[order[:-1]]) | (values[order[1:]] != values[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.sort(order[~(new & np.append(new[1:], True))])
    length = 1
    while len(tied):
        behind = tied + length
        inside = behind < end[tied]
        next_rank = np.where(inside, rank[np.where(inside, behind, 0)] + 1, 0)
        key = rank[tied] * np.int64(n + 1) + next_rank
        turn = np.argsort(key, kind="stable")
        key, tied = key[turn], tied[turn]
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, key[1:] // (n + 1) != key[:-1] // (n + 1))
        lead = np.maximum.accumulate(np.where(group, np.arange(len(key)), 0))
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[tied] = rank[tied] + first - lead
        tied = tied[~(new & np.append(new[1:], True))]
        length *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def common_prefixes(rolling: Rolling, left: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of equal values from each pair of places on, before ``end`` of their row."""
    room = end - np.maximum(left, right)
    got, size = np.zeros(len(left), np.int64), 1
    while len(left) and size <= int(room.max()):
        size *= 2
    while size:
        fits = np.flatnonzero(got + size <= room)
        a, b = left[fits] + got[fits], right[fits] + got[fits]
        same = rolling.stretch(a, a + size) == rolling.stretch(b, b + size)
        got[fits[same]] += size
        size //= 2
    return got


def united(left: list[int], right: list[int], lcp: list[int], ratio: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, LCP) of places that become neighbours at ``ratio`` times their distance within the LCP.

    ``left`` and ``right`` are to be united in the order given. The smaller class is put
    into the larger, each of which is an ordered list of places.
    """
    parent: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for a, b, length in zip(left, right, lcp):
        a, b = root(a), root(b)
        big, small = held.get(a) or [a], held.get(b) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        held.pop(b, None)
        held[a] = big
        gaps = [bisect_left(big, p) for p in small]
        # Of the places that come into one gap the first meets the left bound, the last the right one.
        for i, (p, gap) in enumerate(zip(small, gaps)):
            if gap and (i == 0 or gaps[i - 1] != gap) and (p - big[gap - 1]) * ratio <= length:
                yield big[gap - 1], p - big[gap - 1], length
            if gap < len(big) and (i + 1 == len(gaps) or gaps[i + 1] != gap) and (big[gap] - p) * ratio <= length:
                yield p, big[gap] - p, length
        if len(small) == 1:
            big.insert(gaps[0], small[0])
        else:
            big.extend(small)
            big.sort()


def runs_of(values: np.ndarray, at: np.ndarray, min_length: int, min_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs of all rows, by start, then period; starts count over all rows."""
    none = np.zeros(0, np.int64)
    if len(values) < min_length:
        return none, none, none
    order = suffix_order(values, at)
    row = np.searchsorted(at, order, "right") - 1
    pairs = np.flatnonzero(row[1:] == row[:-1])
    # A run of n words and period q starts two suffixes with n - q words in common, so shorter LCPs tell of no run.
    least = min(max(min_length, min_periods * q) - q for q in range(1, min_length + 1))
    left, right = order[:-1][pairs], order[1:][pairs]
    end = at[1:][row[1:][pairs]]
    rolling = Rolling(values, "word")
    far = np.maximum(left, right) + least <= end
    left, right, end = left[far], right[far], end[far]
    near = rolling.stretch(left, left + least) == rolling.stretch(right, right + least)
    left, right, end = left[near], right[near], end[near]
    lcp = common_prefixes(rolling, left, right, end)
    turn = np.argsort(-lcp, kind="stable")
    seeds = np.array(list(united(left[turn].tolist(), right[turn].tolist(), lcp[turn].tolist(), min_periods - 1)), np.int64).reshape(-1, 3)
    start, period, length = seeds[:, 0], seeds[:, 1], seeds[:, 1] + seeds[:, 2]
    heads = np.isin(start, at[:-1])
    ok = (length >= min_length) & (heads | (values[start - 1] != values[start + period - 1]))
    start, length, period = start[ok], length[ok], period[ok]
    turn = np.lexsort((period, start))
    return start[turn], length[turn], period[turn]


def _found(min_length: int, min_periods: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, bounds in documents(batch, "_text"):
                starts, ends, at = word_bounds(raw, bounds)
                start, length, period = runs_of(word_hashes(raw, starts, ends), at, min_length, min_periods)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                left, kept_bounds = joined_words(raw, starts, ends, at, np.cumsum(edge)[:-1] == 0)
                kept = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(kept_bounds), pa.py_buffer(left)]).cast(pa.string())
                cut = np.searchsorted(start, at)
                row = np.repeat(np.arange(b - a), np.diff(cut))
                runs = pa.StructArray.from_arrays([pa.array(start - at[row]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), runs), kept],
                    ["_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``runs`` and ``collapsed``.

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` with smallest period q
    (words q apart are equal) of at least ``min_length`` words and ``min_periods`` (two or
    more) times q, that cannot be extended with that period. ``runs`` lists (start, length,
    period) by start, then period, in words of the row from 0; ``collapsed`` are the words
    without those that some run holds after its first q, joined by one space.

    Null, empty and blank texts have no words and no runs and collapse to the empty string.
    Rows are worked on one by one, so repeated rows and ids repeat their results and a null
    id is kept; an empty table gives no rows, other columns are ignored. A text is worked on
    whole, however long, by one task: about 150 bytes of memory a word. Words are compared
    by 64-bit hashes.
    """
    if min_periods < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = f"_id {dict(rows.dtypes)['_id']}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(_found(min_length, min_periods), kind).withColumnRenamed("_id", id_col)


def _with_planted_periods(text: Column, doc_id: Column) -> Column:
    """The contract's input: in one text of ten, all words from one on repeat the first few of them."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.floor((n - a) / (3 + g % 8)) + 1
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    many = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(F.slice(many, F.lit(1), n.cast("int")), " ")).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = periodic_runs(docs.select("doc_id", _with_planted_periods(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))), "\n")
    best = out.withColumn("best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
