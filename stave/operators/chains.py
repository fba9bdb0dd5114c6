"""Chains of clipped linear maps over ordered rows, in parallel within one key.

A row says how a value goes on: x -> min(high, max(low, slope * x + shift)). Such maps
compose to a map of the same form, so a key's rows need not be walked by one task: a key
above ``spark.stave.blockRows`` rows is cut into blocks, each block is folded into one map,
the few block maps of a key carry its value from block to block, and all blocks are then
walked at once from their start values. Without such a key the chain is one pass.

Composed maps differ from a walk row by row in the last bits. Where a result is cut to whole
numbers these bits can show, so a chain may be walked in ``steps``: all keys of a batch at once,
each row by its own map. Such a map may take ``drop`` from x first, to 0 at least.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stave.operators.timeline import PROBE, _with_blocks, hot_keys

FAR = 1e300


def scan_maps(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Composes maps x -> min(high, max(low, a x + b)) with all before them in the array (a >= 0).

    Such maps are closed under composition, so n of them take log2(n) vectorised rounds
    and blocks of them can be folded apart. A constant map (a = 0) forgets what came before.
    """
    a, b, low, high = (np.array(x, np.float64) for x in (a, b, low, high))
    reach = 1
    while reach < len(a):
        later, before = (a[reach:], b[reach:], low[reach:], high[reach:]), (a[:-reach], b[:-reach], low[:-reach], high[:-reach])
        edges = [np.clip(later[0] * x + later[1], later[2], later[3]) for x in before[2:]]
        a[reach:], b[reach:] = later[0] * before[0], later[0] * before[1] + later[1]
        low[reach:], high[reach:] = edges
        reach *= 2
    return a, b, low, high


def run_maps(start, a, b, low, high) -> np.ndarray:
    """Values after each map, from ``start``."""
    a, b, low, high = scan_maps(a, b, low, high)
    return np.clip(a * start + b, low, high)


def step_maps(first, starts, a, b, low, high, drop) -> np.ndarray:
    """Values after each map min(high, max(low, a * max(0, x - drop) + b)), or a x + b where ``drop`` is None.

    Stretches of rows begin at ``starts`` from the values ``first``; they are walked side by side, row by row.
    """
    sizes = np.diff(np.append(starts, len(b)))
    longest = np.argsort(-sizes, kind="stable")
    value, heads, sizes = np.array(first, np.float64)[longest], starts[longest], sizes[longest]
    out = np.empty(len(b))
    for i in range(sizes[0]):
        n = np.searchsorted(-sizes, -i, "left")
        rows = heads[:n] + i
        x = value[:n] if drop is None else np.maximum(0.0, value[:n] - drop[rows])
        out[rows] = value[:n] = np.minimum(high[rows], np.maximum(low[rows], a[rows] * x + b[rows]))
    return out


def _table(column: pa.Array, width: int | None) -> np.ndarray:
    """A column of numbers, or of lists of ``width`` numbers, as an array of rows."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    values = column.to_numpy(zero_copy_only=False).astype(np.float64)
    return values if width is None else np.repeat(values[:, None], width, axis=1)


def _maps(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Slopes, shifts and limits of a batch; a list of shifts is as many chains side by side."""
    shift = _table(batch.column("_shift"), None)
    width = shift.shape[1] if shift.ndim == 2 else None
    return [_table(batch.column("_slope"), width), shift, *(_table(batch.column(n), width) for n in ("_low", "_high"))]


def group_starts(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """The first row of each stretch of equal keys of a sorted batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in by:
        codes = pc.fill_null(batch.column(name).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _key(batch: pa.RecordBatch, by: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in by)


def _fold(by: list[str]) -> Callable:
    """One composed map per block of rows, as (blocks' keys, slope, shift, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, schema = None, None, None

        def made() -> pa.RecordBatch:
            values = [pa.array([v], schema.field(n).type) for n, v in zip(by, key)]
            return pa.RecordBatch.from_arrays(values + [pa.array([np.atleast_1d(x[0]).tolist()], pa.list_(pa.float64())) for x in held], [*by, "_a", "_b", "_lo", "_hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            schema, maps, starts = batch.schema, _maps(batch), group_starts(batch, by)
            for low, high in zip(starts, np.append(starts[1:], batch.num_rows)):
                part = [x[low:high] for x in maps]
                if held is not None and _key(batch, by, low) == key:
                    part = [np.concatenate([h, x]) for h, x in zip(held, part)]
                elif held is not None:
                    yield made()
                key, held = _key(batch, by, low), [x[-1:] for x in scan_maps(*part)]
        if held is not None:
            yield made()

    return run


def _carried(keys: list[str]) -> Callable:
    """The value each block of one key starts from; a key has at most as many blocks as cuts."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_blk")
        value, starts = None, []
        for a, b, low, high in zip(blocks["_a"], blocks["_b"], blocks["_lo"], blocks["_hi"]):
            value = np.zeros(len(b)) if value is None else value
            starts.append(value)
            value = np.clip(np.asarray(a) * value + np.asarray(b), low, high)
        return blocks[[*keys, "_blk"]].assign(_start=starts)

    return run


def _walk(by: list[str], name: str, wide: bool, steps: bool, drops: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            slope, shift, low, high = (x.copy() for x in _maps(batch))
            starts = group_starts(batch, by)
            begin = batch.column("_start").take(pa.array(starts))
            first = np.zeros((len(starts), *shift.shape[1:]))
            known = np.flatnonzero(begin.is_valid().to_numpy(zero_copy_only=False))
            if len(known):
                values = begin.drop_null().flatten().to_numpy(zero_copy_only=False)
                first[known] = values.reshape(len(known), *shift.shape[1:])
            if _key(batch, by, 0) == key:
                first[0] = state
            if steps:
                made = step_maps(first, starts, slope, shift, low, high, _table(batch.column("_drop"), None) if drops else None)
            else:
                # The first map of a key gets its start value, and so forgets what stands before it in the batch.
                shift[starts] = np.clip(slope[starts] * first + shift[starts], low[starts], high[starts])
                slope[starts] = 0.0
                made = run_maps(0.0, slope, shift, low, high)
            key, state = _key(batch, by, batch.num_rows - 1), made[-1]
            value = pa.array(made) if not wide else pa.FixedSizeListArray.from_arrays(pa.array(made.reshape(-1)), made.shape[1]).cast(pa.list_(pa.float64()))
            kept = [i for i, n in enumerate(batch.schema.names) if n not in ("_slope", "_shift", "_low", "_high", "_drop", "_start", "_blk")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [value], [batch.schema.names[i] for i in kept] + [name])

    return run


def run_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, slope: Column, shift: Column, low: Column | float = -FAR, high: Column | float = FAR,
              hot: DataFrame | None | object = PROBE, steps: bool = False, drop: Column | None = None) -> DataFrame:
    """Add ``name``: the value after each row's map in ``order``, from 0 before the first row of a key.

    ``shift`` may be an array, of one length within the table: as many values, of one slope and limits.
    A slope is 0 or more and no part of a map is null. ``order`` is a total order whose
    first column is numeric; ``hot`` the answer of an earlier ``hot_keys`` over the same rows.
    ``steps`` walks row by row, as the maps are written (no arrays; only blocks of hot keys start
    from composed maps); ``drop`` is then taken from the value first, to 0 at least.
    """
    keys, order = list(keys), list(order)
    if hot is PROBE:
        hot = hot_keys(df, keys, order[0])
    wide = isinstance(df.select(shift.alias("s")).schema["s"].dataType, T.ArrayType)
    double = "array<double>" if wide else "double"
    limits = [x if isinstance(x, Column) else F.lit(x) for x in (low, high)]
    maps = {"_slope": slope.cast("double"), "_shift": shift.cast(double), "_low": limits[0].cast("double"), "_high": limits[1].cast("double")}
    composed = maps
    if drop is not None:
        # slope * max(0, x - drop) + shift = max(shift, slope * x + shift - slope * drop)
        composed = {**maps, "_shift": maps["_shift"] - maps["_slope"] * drop, "_low": F.greatest(maps["_low"], F.least(maps["_shift"], maps["_high"]))}
        maps = {**maps, "_drop": drop.cast("double")}
    rows = df.withColumns(maps)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()) if wide else T.DoubleType())])
    none = F.lit(None).cast("array<double>")
    if hot is None:
        rows, by = rows.withColumns({"_start": none}), keys
    else:
        by = [*keys, "_blk"]
        rows = _with_blocks(rows, keys, order[0], hot)
        cut = rows.where("_blk IS NOT NULL").select(*by, *[n for n in order if n not in by], *[c.alias(n) for n, c in composed.items()])
        kinds = ", ".join(f"`{n}` {t}" for n, t in cut.select(*by).dtypes)
        folded = cut.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(_fold(by), f"{kinds}, _a array<double>, _b array<double>, _lo array<double>, _hi array<double>")
        starts = folded.groupBy(*keys).applyInPandas(_carried(keys), f"{kinds}, _start array<double>")
        rows = rows.join(starts, by, "left").select(*rows.columns, "_start")
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(_walk(by, name, wide, steps, drop is not None), schema)
