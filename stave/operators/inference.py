"""User models over chunks: batched calls and weighted overlap-add."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.operators.signal import _array, decoded_stats, map_slices

_factories: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}
_loaded: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def register_model(name: str, factory: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> None:
    """Register a factory of a model: [n, channels, frames] -> [n, outputs, channels, frames]."""
    _factories[name] = factory


def identity_model() -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x[:, None]


register_model("identity", identity_model)


def _model(name: str, factory):
    """The model of this worker process, loaded on first use."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def batch_infer(chunks: DataFrame, model: str, batch: int = 2) -> DataFrame:
    """Apply a model to chunk rows (any keys, ``chunk``: array per channel).

    Adds ``outputs`` and ``error``. A failing batch is tried row by row, so one
    bad chunk does not lose the others' results.
    """
    factory = _factories[model]
    keys = [n for n in chunks.columns if n != "chunk"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "chunk")

    def shaped(rows) -> np.ndarray:
        return np.stack([np.stack([_array(c) for c in row]) for row in rows])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        outputs, errors = [], []
        for low in range(0, len(b), batch):
            rows = list(b["chunk"].iloc[low : low + batch])
            for part in [rows] if len(rows) == 1 else [rows, *[[r] for r in rows]]:
                try:
                    made = _model(model, factory)(shaped(part))
                    results = [([[np.asarray(c) for c in out] for out in one], None) for one in made]
                except Exception as failure:  # noqa: BLE001
                    if len(part) > 1:
                        continue
                    results = [(None, f"{type(failure).__name__}: {failure}")]
                outputs.extend(r[0] for r in results)
                errors.extend(r[1] for r in results)
                if len(part) == len(rows):
                    break
        return b[keys].assign(outputs=pd.Series(outputs, index=b.index, dtype=object), error=pd.Series(errors, index=b.index, dtype=object))

    return map_slices(chunks, run, f"{schema}, outputs array<array<array<double>>>, error string", multiple=batch)


def fade_window(size: int, fade: int) -> np.ndarray:
    window = np.ones(size)
    if fade:
        window[:fade], window[-fade:] = np.linspace(0.0, 1.0, fade), np.linspace(1.0, 0.0, fade)
    return window


def overlap_add(blocks: DataFrame, model: str, chunk: int, overlaps: int = 4, batch: int = 2, block_frames: int = 65_536) -> DataFrame:
    """Run a model over overlapping chunks and join its outputs by weighted average.

    Chunks step by ``chunk / overlaps`` over the signal, reflected at both ends
    when it is long enough; weights fade linearly over a tenth of a chunk, except
    at the outer ends, which is settled per batch of chunks. Every chunk is a row
    that gathers only its own blocks, and every output block sums the few chunks
    over it. A block under a chunk that failed has null samples and the reasons in
    ``error``; where all its chunks failed, stem and channel are null too.
    """
    step = chunk // overlaps
    border, fade = chunk - step, chunk // 10
    stats = decoded_stats(blocks).select("track_id", "frames")
    padded = (F.col("frames") > 2 * border) & F.lit(border > 0)
    total = F.col("frames") + F.when(padded, 2 * border).otherwise(0)
    planned = stats.select(
        "track_id", "frames", F.when(padded, border).otherwise(0).alias("pad"), total.alias("total"), F.ceil(total / step).alias("n_chunks")
    ).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
    # source span of a chunk; reflection folds indexes outside the signal back in
    low, high = F.col("chunk_no") * step - F.col("pad"), F.least(F.col("chunk_no") * step + chunk, F.col("total")) - 1 - F.col("pad")
    top = F.col("frames") - 1
    reach_low = F.greatest(F.lit(0), F.least(F.when(low < 0, F.lit(0)).otherwise(low), F.when(high > top, 2 * top - high).otherwise(low)))
    reach_high = F.least(top, F.greatest(F.when(low < 0, -low).otherwise(high), high))
    spread = planned.withColumn(
        "block_no", F.explode(F.sequence(F.floor(F.least(reach_low, top) / block_frames), F.floor(reach_high / block_frames))))
    met = spread.join(blocks.select("track_id", "channel", "block_no", "first_frame", "samples"), ["track_id", "block_no"])
    keys = ["track_id", "chunk_no", "n_chunks", "frames", "pad", "total"]
    per_channel = met.groupBy(*keys, "channel").agg(
        F.min("first_frame").alias("origin"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_frame", "samples"))), lambda s: s["samples"])).alias("x"))
    gathered = per_channel.groupBy(*keys).agg(
        F.min("origin").alias("origin"), F.transform(F.array_sort(F.collect_list(F.struct("channel", "x"))), lambda s: s["x"]).alias("x"))

    def cut(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in b.itertuples():
            first = row.chunk_no * step
            index = np.arange(first, min(first + chunk, row.total)) - row.pad
            index = np.abs(index)
            index = np.where(index > row.frames - 1, 2 * (row.frames - 1) - index, index) - row.origin
            parts = []
            for channel in row.x:
                part = _array(channel)[index]
                missing = chunk - len(part)
                if missing:
                    mode = "reflect" if len(part) > chunk // 2 else "constant"
                    part = np.pad(part, (0, missing), mode=mode)
                parts.append(part)
            out.append(parts)
        return b[["track_id", "chunk_no", "n_chunks", "frames", "pad", "total"]].assign(chunk=out)

    shape = "track_id string, chunk_no bigint, n_chunks bigint, frames bigint, pad bigint, total bigint, chunk array<array<double>>"
    inferred = batch_infer(map_slices(gathered, cut, shape), model, batch)

    def weigh(b: pd.DataFrame) -> pd.DataFrame:
        base = fade_window(chunk, fade)
        out = []
        for row in b.itertuples():
            window = base.copy()
            last_of_batch = min((row.chunk_no // batch + 1) * batch, row.n_chunks) - 1
            if last_of_batch == 0:
                window[:fade] = 1.0
            elif last_of_batch == row.n_chunks - 1:
                window[len(window) - fade :] = 1.0
            first = row.chunk_no * step - row.pad
            length = min(chunk, row.total - row.chunk_no * step)
            low, high = max(0, first), min(row.frames, first + length)
            for block in range(low // block_frames, -(-high // block_frames) if high > low else low // block_frames):
                if row.outputs is None:
                    out.append((row.track_id, None, None, block, None, None, None, row.error))
                    continue
                a, z = max(low, block * block_frames), min(high, (block + 1) * block_frames)
                w = window[a - first : z - first]
                for number, output in enumerate(row.outputs):
                    for channel, y in enumerate(output):
                        out.append((row.track_id, number, channel, block, a - block * block_frames, _array(y)[a - first : z - first] * w, w, None))
        made = pd.DataFrame(out, columns=["track_id", "stem", "channel", "block_no", "at", "y", "w", "error"])
        return made.astype({"stem": "Int32", "channel": "Int32", "at": "Int64"})

    parts = map_slices(
        inferred.select("track_id", "chunk_no", "n_chunks", "frames", "pad", "total", "outputs", "error"), weigh, "track_id string, stem int, channel int, block_no bigint, at bigint, y array<double>, w array<double>, error string")
    failed = parts.where("error IS NOT NULL").groupBy("track_id", "block_no").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))
    parts = parts.where("error IS NULL")
    # at most overlaps + 1 chunks lie over an output block of a chunk's length or less, plus those starting inside it
    grouped = parts.groupBy("track_id", "stem", "channel", "block_no").agg(F.collect_list(F.struct("at", "y", "w")).alias("p"))

    def join(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pieces in b["p"]:
            size = max(int(p["at"]) + len(p["y"]) for p in pieces)
            y, w = np.zeros(size), np.zeros(size)
            for p in pieces:
                at, n = int(p["at"]), len(p["y"])
                y[at : at + n] += _array(p["y"])
                w[at : at + n] += _array(p["w"])
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append(np.nan_to_num(y / w, nan=0.0))
        return b[["track_id", "stem", "channel", "block_no"]].assign(samples=out)

    joined = map_slices(grouped, join, "track_id string, stem int, channel int, block_no bigint, samples array<double>")
    told = joined.join(failed, ["track_id", "block_no"], "full")
    return told.select("track_id", "stem", "channel", "block_no", F.when(F.col("error").isNull(), F.col("samples")).alias("samples"), "error")
