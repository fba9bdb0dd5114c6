"""Find the windows of a fixed length that recur in a corpus, without listing every window.

Each window of ``span`` items (bytes or words) is represented by the least hash among
the ``gram``-item stretches inside it. Equal windows agree on that gram, so only
*runs* of windows that share one gram are shuffled, about two per ``span - gram`` items:

1. Grams seen once are dropped (counts with map-side combine, then a semi join).
2. Runs that are equal as a whole are *variants* of one gram, counted by hash. A run
   whose variant already settles the question is marked without looking inside.
3. Where one gram has several variants left, a unit may first cut their runs into
   segments, which are judged in the same way.
4. Only what is left is compared window by window, from short prefixes to the whole
   span: prefixes seen once are dropped at each length.

A key in a third of all rows stays linear: counts combine before the shuffle, and the
joins back put one row per key on one side, so the adaptive skew join may split the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.llm.rolling import Rolling, anchored_runs, byte_rolling, documents, mix, word_bounds, word_hashes
from stave.llm.steps import discard, step

NULL_ID = -(1 << 63)
_RUN = "_g long, _d long, _t long, _p long, _v long"
# A run's place in one long: 31 bits of the first window, 9 each of the number of windows and
# of the gram's distance from the first. Its text is known by id and hash beside it.
_COUNT_BITS, _FIRST_BITS = 9, 31


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``words`` or bytes, its span, gram, and the prefix lengths compared.

    With a ``segment``, runs still undecided are cut into segments of so many windows first.
    """

    words: bool
    span: int
    gram: int
    lengths: tuple[int, ...]
    segment: int = 0

    def __post_init__(self):
        if not 0 <= self.span - self.gram < 1 << _COUNT_BITS:
            raise ValueError(f"a window has at most {(1 << _COUNT_BITS) - 1} items more than a gram")

    def items(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[Rolling, np.ndarray]:
        """Rolling hashes over the items and the item bounds of the rows."""
        if not self.words:
            return byte_rolling(raw), bounds
        starts, ends, at = word_bounds(raw, bounds)
        return Rolling(word_hashes(raw, starts, ends), "word"), at

    @property
    def width(self) -> int:
        return self.span - self.gram + 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_d, _t, _text): the id (a null is less than all others), the text's 64-bit hash, the text (null: empty).

    Of ten million different texts under one id, or without one, two share a hash with a chance of 3 in a million.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(text).alias("_t"),
        text.alias("_text"),
    )


def _packed(first: np.ndarray, count: np.ndarray, back: np.ndarray) -> np.ndarray:
    return (first << (2 * _COUNT_BITS)) | (count << _COUNT_BITS) | back


def _runs(unit: Unit, full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("_d").to_numpy(), batch.column("_t").to_numpy()
            for a, b, raw, bounds in documents(batch, "_text"):
                rolling, at = unit.items(raw, bounds)
                grams = rolling.grams(unit.gram)
                row, first, count, place = anchored_runs(grams, unit.width, at, unit.span)
                if not len(row):
                    continue
                gram = grams[place].view(np.int64)
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids[a:b][row])], ["_g", "_d"])
                    continue
                whole = rolling.stretch(first, first + count - 1 + unit.span).view(np.int64)
                packed = _packed(first - at[row], count, place - first)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids[a:b][row]), pa.array(tags[a:b][row]), pa.array(packed), pa.array(whole)], ["_g", "_d", "_t", "_p", "_v"])

    return run


def _unpacked(df: DataFrame) -> DataFrame:
    def bits(low: int, width: int) -> Column:
        return F.shiftright("_p", low).bitwiseAND((1 << width) - 1)

    return df.withColumns({
        "_first": bits(2 * _COUNT_BITS, _FIRST_BITS),
        "_count": bits(_COUNT_BITS, _COUNT_BITS).cast("int"),
        "_back": bits(0, _COUNT_BITS).cast("int"),
    })


def _listed(asked: DataFrame) -> DataFrame:
    """The asked runs of each text; a set, so equal rows add nothing, and not longer than the text."""
    return _unpacked(asked).groupBy("_d", "_t").agg(F.collect_set(F.struct("_g", "_first", "_count", "_back")).alias("_asked"))


def _segments(unit: Unit) -> Callable:
    """Asked runs cut by the distance of their windows from the gram.

    All windows of one segment hold its core, the stretch common to the whole distance
    range, so windows can be equal only in segments with equal cores: these are the new grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("_d").to_numpy(), batch.column("_t").to_numpy()
            rows, asked = batch.column("_asked").offsets.to_numpy(), batch.column("_asked").values
            gram, first, count, back = (asked.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("_g", "_first", "_count", "_back"))
            for a, b, raw, bounds in documents(batch, "_text"):
                rolling, at = unit.items(raw, bounds)
                mine = slice(rows[a], rows[b])
                who = np.repeat(np.arange(a, b), np.diff(rows[a: b + 1]))
                low = (back[mine] - count[mine] + 1) // unit.segment
                parts = back[mine] // unit.segment - low + 1
                turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
                which = np.repeat(np.arange(len(who)), parts)
                if not len(which):
                    continue
                who, g, far, n, lead = who[which], gram[mine][which], back[mine][which], count[mine][which], first[mine][which]
                number = low[which] + turn
                most = np.minimum(far, (number + 1) * unit.segment - 1)
                least = np.maximum(far - n + 1, number * unit.segment)
                place = lead + far + at[who - a]
                wide = np.minimum((number + 1) * unit.segment - 1, unit.span - unit.gram)
                core = rolling.stretch(place - number * unit.segment, place + unit.span - wide)
                key = mix(core + mix(g.view(np.uint64) + number.astype(np.uint64))).view(np.int64)
                start, many = lead + far - most, most - least + 1
                whole = rolling.stretch(start + at[who - a], start + at[who - a] + many - 1 + unit.span).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[who]), pa.array(tags[who]), pa.array(_packed(start, many, most)), pa.array(whole)], ["_g", "_d", "_t", "_p", "_v"])

    return run


def _prefixes(unit: Unit) -> Callable:
    """Of each asked window the hashes of its first items, for each of the unit's lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("_d").to_numpy(), batch.column("_t").to_numpy()
            asked = batch.column("_asked")
            rows, fields = asked.offsets.to_numpy(), asked.values
            gram, first, count = (fields.field(n).to_numpy(zero_copy_only=False) for n in ("_g", "_first", "_count"))
            for a, b, raw, bounds in documents(batch, "_text"):
                rolling, at = unit.items(raw, bounds)
                lo, hi = rows[a], rows[b]
                if hi == lo:
                    continue
                owner = np.repeat(np.arange(a, b), np.diff(rows[a: b + 1]))
                size = count[lo:hi]
                offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                place = np.repeat(first[lo:hi], size) + offset
                who = np.repeat(owner, size)
                start = place + at[who - a]
                values = [pa.array(rolling.stretch(start, start + n).view(np.int64)) for n in unit.lengths]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(gram[lo:hi], size)), pa.array(ids[who]), pa.array(tags[who]), pa.array(place), *values],
                    ["_g", "_d", "_t", "_first", *(f"_h{n}" for n in unit.lengths)])

    return run


def _marked(unit: Unit) -> Callable:
    """What is left of each text when every item covered by a marked window goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("_marks")
            offsets, fields = marks.offsets.to_numpy(), marks.values
            first, count = (fields.field(n).to_numpy(zero_copy_only=False) for n in ("_first", "_count"))
            for a, b, raw, bounds in documents(batch, "_text"):
                if unit.words:
                    starts, ends, at = word_bounds(raw, bounds)
                else:
                    at = bounds
                base = np.repeat(at[:-1], np.diff(offsets[a: b + 1]))
                lo, hi = offsets[a], offsets[b]
                edge = np.zeros(at[-1] + 1, np.int64)
                np.add.at(edge, base + first[lo:hi], 1)
                np.add.at(edge, base + first[lo:hi] + count[lo:hi] - 1 + unit.span, -1)
                gone = np.cumsum(edge)[:-1] > 0
                upto = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = at[:-1][np.diff(at) > 0]
                begins[heads] = gone[heads]
                spans = np.concatenate([[0], np.cumsum(begins)])
                if unit.words:
                    left, kept_bounds = joined_words(raw, starts, ends, at, ~gone)
                    kept = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(kept_bounds), pa.py_buffer(left)])
                else:
                    left, kept_bounds = raw[~gone], bounds - upto[bounds]
                    kept = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(kept_bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(left))])
                kept = kept.cast(pa.string() if unit.words else pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_d").slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), pa.array(np.diff(upto[at])), pa.array(np.diff(spans[at])), kept],
                    ["_d", "n_items", "n_removed", "n_spans", "kept"])

    return run


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by one space: bytes and row bounds."""
    words = np.flatnonzero(keep)
    row = np.searchsorted(at, words, "right") - 1
    size = ends[words] - starts[words] + 1
    if len(words):
        last = np.append(row[1:] != row[:-1], True)
        size = size - last
    out = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    index = np.arange(out[-1]) + np.repeat(starts[words] - out[:-1], size)
    left = raw[np.minimum(index, max(len(raw) - 1, 0))] if len(words) else np.zeros(0, np.uint8)
    if len(words):
        left[(out[1:] - 1)[~last]] = 0x20
    return np.ascontiguousarray(left), out[np.searchsorted(row, np.arange(len(at)))].astype(np.int64)


def remove_repeats(docs: DataFrame, unit: Unit, id_col: str, text_col: str, earlier_only: bool) -> DataFrame:
    """(id, n_items, n_removed, n_spans, kept) of each row.

    Removed is each item covered by a window that also starts elsewhere (``earlier_only``
    false), or in a row with a smaller id. Windows are judged on the input.
    """
    texts = keyed(docs, id_col, text_col)
    kinds = "".join(f", _h{n} long" for n in unit.lengths)

    def of_texts(asked: DataFrame, work: Callable, schema: str) -> DataFrame:
        return texts.join(_listed(asked).hint("shuffle_hash"), ["_d", "_t"]).mapInArrow(work, schema)

    marks: list[DataFrame] = []

    def settled_and(runs: DataFrame, work: Callable, schema: str, label: str) -> DataFrame:
        """Keep the marks of settled runs, look closer at the asked ones, and free what they came from."""
        variants, settled, asked = _judged(runs, earlier_only)
        marks.append(step(_unpacked(settled).select("_d", "_t", "_first", "_count"), "settled"))
        closer = step(of_texts(asked, work, schema), label)
        discard(runs, variants)
        return closer

    runs = step(_shared_runs(texts, unit, earlier_only), "runs")
    if unit.segment:
        runs = settled_and(runs, _segments(unit), _RUN, "segments")
    listed = settled_and(runs, _prefixes(unit), f"_g long, _d long, _t long, _first long{kinds}", "windows")
    windows = listed
    for length in unit.lengths:
        windows = _recurring(windows, f"_h{length}", earlier_only)
    found = reduce(DataFrame.unionByName, marks).unionByName(windows.where("_goes").select("_d", "_t", "_first", F.lit(1).alias("_count")))
    # A set: equal rows bring the same marks, which must not add up.
    last = step(found.groupBy("_d", "_t").agg(F.collect_set(F.struct("_first", "_count")).alias("_marks")), "marks")
    discard(*marks, listed)
    empty = F.array().cast("array<struct<_first:bigint,_count:int>>")
    both = texts.join(last.hint("shuffle_hash"), ["_d", "_t"], "left").withColumn("_marks", F.coalesce("_marks", empty))
    done = both.select("_d", "_text", "_marks").mapInArrow(_marked(unit), f"_d long, n_items long, n_removed long, n_spans long, kept {'string' if unit.words else 'binary'}")
    return done.select(F.when(F.col("_d") != NULL_ID, F.col("_d")).alias(id_col), "n_items", "n_removed", "n_spans", "kept")


def _shared_runs(texts: DataFrame, unit: Unit, earlier_only: bool) -> DataFrame:
    """The runs of windows whose gram occurs again (under another id, for ``earlier_only``)."""
    seen = F.min("_d") < F.max("_d") if earlier_only else F.count(F.lit(1)) > 1
    again = texts.mapInArrow(_runs(unit, False), "_g long, _d long").groupBy("_g").agg(seen.alias("_again")).where("_again").select("_g")
    return texts.mapInArrow(_runs(unit, True), _RUN).join(_apart(again), "_g", "left_semi")


def _apart(df: DataFrame) -> DataFrame:
    """The rows with ``_g`` as an expression, which hides how an aggregate has dealt them out.

    A join behind then gets an exchange of its own, whose skewed partitions may be split.
    """
    return df.withColumn("_g", F.bitwise_not(F.bitwise_not("_g")))


def _judged(runs: DataFrame, earlier_only: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written variants of runs, and the settled and the asked ones of the runs."""
    variants = step(runs.groupBy("_g", "_v").agg(F.min(F.struct("_d", "_t", "_p")).alias("_one"), F.count(F.lit(1)).alias("_n")), "variants")
    return variants, *(_settled_earlier if earlier_only else _settled_any)(runs, variants)


def _settled_any(runs: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs equal to another run; one run of each variant, where a gram has several variants."""
    repeated = variants.where("_n > 1").select("_g", "_v")
    settled = runs.join(repeated, ["_g", "_v"], "left_semi").select("_d", "_t", "_p")
    several = variants.groupBy("_g").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_g")
    asked = variants.join(_apart(several), "_g", "left_semi").select("_g", "_one._d", "_one._t", "_one._p")
    return settled, asked


def _settled_earlier(runs: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs equal to one of a smaller id; the others, where a gram has them under several ids."""
    least = variants.select("_g", "_v", F.col("_one._d").alias("_least"))
    both = runs.join(least, ["_g", "_v"])
    several = least.groupBy("_g").agg(F.min("_least").alias("_a"), F.max("_least").alias("_b")).where("_a < _b").select("_g")
    first = both.where("_least = _d").select(F.col("_g"), "_d", "_t", "_p").join(_apart(several), "_g", "left_semi")
    return both.where("_least < _d").select("_d", "_t", "_p"), first


def _recurring(windows: DataFrame, prefix: str, earlier_only: bool) -> DataFrame:
    """The windows whose prefix recurs; ``_goes`` tells whether that condemns them."""
    per = windows.groupBy("_g", prefix).agg(F.min("_d").alias("_least"), F.max("_d").alias("_most"), F.count(F.lit(1)).alias("_n"))
    per = per.where("_least < _most" if earlier_only else "_n > 1").select("_g", prefix, "_least")
    goes = F.col("_least") < F.col("_d") if earlier_only else F.lit(True)
    return windows.drop("_goes").join(_apart(per), ["_g", prefix]).withColumn("_goes", goes).drop("_least", prefix)
