"""Signal reductions over sample blocks.

A track is many rows (track_id, channel, block_no, first_frame, sample_rate,
samples), so a long one spreads over tasks. Blocks that were read with their track's
``frames`` and ``channels`` and with the samples ``left`` and ``right`` of them, as files
are (``sources.wav``), are worked on where they are. For others, what an operator needs from
neighbouring blocks travels as a small edge by equi-join on block_no. NumPy works
inside one block, and only reduced rows are grouped per track.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from stave.functions.scalars import stem_gains
from stave.functions.vocabulary import MAX_PEAK_BUCKETS

BLOCK = ["track_id", "channel", "block_no"]


def decoded_stats(blocks: DataFrame) -> DataFrame:
    """Frames, channels, rate and duration per track."""
    if "frames" in blocks.columns:
        stats = blocks.groupBy("track_id").agg(F.max("frames").alias("frames"), F.max("channels").cast("bigint").alias("channels"), F.max("sample_rate").alias("sample_rate"))
    else:
        per_channel = blocks.groupBy("track_id", "channel").agg(F.sum(F.size("samples")).alias("_n"), F.max("sample_rate").alias("sample_rate"))
        stats = per_channel.groupBy("track_id").agg(F.max("_n").alias("frames"), F.count(F.lit(1)).alias("channels"), F.max("sample_rate").alias("sample_rate"))
    return stats.withColumn("duration_s", F.col("frames") / F.col("sample_rate"))


def _sized(blocks: DataFrame) -> DataFrame:
    """Blocks with the ``frames`` and ``channels`` of their track."""
    return blocks if "frames" in blocks.columns else blocks.join(decoded_stats(blocks).select("track_id", "frames", "channels"), "track_id")


def waveform_peaks(blocks: DataFrame, buckets: int = MAX_PEAK_BUCKETS) -> DataFrame:
    """Lowest and highest sample per bucket over all channels; NaN samples are ignored."""
    cut = _sized(blocks).withColumns({"_per": F.greatest(F.lit(1), F.ceil(F.col("frames") / F.lit(buckets))), "_n": F.size("samples")}).where("_n > 0")
    first, last = F.floor(F.col("first_frame") / F.col("_per")), F.floor((F.col("first_frame") + F.col("_n") - 1) / F.col("_per"))
    parts = cut.select("track_id", "first_frame", "samples", "_per", "_n", F.explode(F.sequence(first, last)).alias("bucket"))
    low = F.greatest(F.lit(0), F.col("bucket") * F.col("_per") - F.col("first_frame"))
    high = F.least(F.col("_n"), (F.col("bucket") + 1) * F.col("_per") - F.col("first_frame"))
    piece = F.filter(F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")), lambda x: ~F.isnan(x))
    reduced = parts.select("track_id", "bucket", piece.alias("_p")).select(
        "track_id", "bucket", F.array_min("_p").alias("_lo"), F.array_max("_p").alias("_hi"))
    return reduced.groupBy("track_id", "bucket").agg(
        F.least(F.lit(1.0).cast("float"), F.min("_lo")).alias("min"), F.greatest(F.lit(-1.0).cast("float"), F.max("_hi")).alias("max"))


def peak_pyramid(peaks: DataFrame, levels: int = 4, factor: int = 4) -> DataFrame:
    """Coarser levels of a peak table, each made from the one before."""
    level = peaks.select("track_id", F.lit(0).alias("level"), "bucket", "min", "max")
    out = level
    for number in range(1, levels):
        level = level.groupBy("track_id", F.floor(F.col("bucket") / factor).alias("bucket")).agg(
            F.min("min").alias("min"), F.max("max").alias("max")).select("track_id", F.lit(number).alias("level"), "bucket", "min", "max")
        out = out.unionByName(level)
    return out


def visible_peaks(peaks: DataFrame, zoom: float, start: float, maximum: int) -> DataFrame:
    """Peaks of the visible part of each track, reduced to at most ``maximum`` groups."""
    counts = peaks.groupBy("track_id").agg(F.count(F.lit(1)).alias("_n"))
    first = F.floor(F.lit(start) * F.col("_n"))
    shown = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(zoom)))
    spans = counts.select("track_id", first.alias("_f"), F.least("_n", first + shown).alias("_e")).withColumn(
        "_g", F.greatest(F.lit(1), F.ceil((F.col("_e") - F.col("_f")) / F.lit(maximum))))
    inside = peaks.join(spans, "track_id").where((F.col("bucket") >= F.col("_f")) & (F.col("bucket") < F.col("_e")))
    return inside.groupBy("track_id", F.floor((F.col("bucket") - F.col("_f")) / F.col("_g")).alias("group_no")).agg(
        F.min("min").alias("min"), F.max("max").alias("max"))


def _with_edges(blocks: DataFrame, before: int, after: int) -> DataFrame:
    """Attach the neighbours' nearest samples: ``_left`` and ``_right`` (null or empty at the ends)."""
    if "left" in blocks.columns:
        tail = F.slice("left", F.greatest(F.lit(1), F.size("left") - before + 1), F.lit(before))
        return blocks.withColumns({"_left": tail, "_right": F.slice("right", 1, after)}).drop("left", "right")
    out = blocks
    if before:
        tail = F.slice("samples", F.greatest(F.lit(1), F.size("samples") - before + 1), F.lit(before))
        out = out.join(blocks.select("track_id", "channel", (F.col("block_no") + 1).alias("block_no"), tail.alias("_left")), BLOCK, "left")
    if after:
        out = out.join(
            blocks.select("track_id", "channel", (F.col("block_no") - 1).alias("block_no"), F.slice("samples", 1, after).alias("_right")), BLOCK, "left")
    return out


#: Bytes of rows that Python works on at a time.
SLICE_BYTES = 2 << 20


def map_slices(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, multiple: int = 1) -> DataFrame:
    """``run`` over frames of some ``SLICE_BYTES``, of ``multiple`` rows or whole multiples, so that arrays become Python objects by the slice, not by the batch."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes) // multiple) * multiple
            for low in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pandas(run(batch.slice(low, rows).to_pandas()), schema=kind, preserve_index=False)

    return df.mapInArrow(sliced, schema)


def _array(value) -> np.ndarray:
    return np.zeros(0) if value is None else np.asarray(value, dtype=np.float64)


def _cubic_peak(samples: np.ndarray, left: np.ndarray, right: np.ndarray, channel: int) -> float:
    best = np.abs(samples).max(initial=0.0)
    x = np.concatenate([left, samples, right])
    if channel > 1 or len(x) < 4:
        return best
    p0, p1, p2, p3 = x[:-3], x[1:-2], x[2:-1], x[3:]
    for t in (0.25, 0.5, 0.75):
        value = 0.5 * (
            2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t
        )
        best = max(best, np.abs(value).max(initial=0.0))
    return best


def true_peak(blocks: DataFrame) -> DataFrame:
    """Largest magnitude of samples and of the cubic through four of them at quarter steps (channels 1 and 2)."""
    edged = _with_edges(blocks.select(*BLOCK, "samples", *(n for n in ("left", "right") if n in blocks.columns)), 1, 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            peaks = [
                _cubic_peak(_array(s), _array(left), _array(right), c)
                for s, left, right, c in zip(b["samples"], b["_left"], b["_right"], b["channel"])
            ]
            yield pd.DataFrame({"track_id": b["track_id"], "peak": peaks})

    found = edged.select("track_id", "channel", "samples", "_left", "_right").mapInPandas(run, "track_id string, peak double")
    return found.groupBy("track_id").agg(F.max("peak").alias("true_peak"))


# Loudness filters, gates and units.
SHELF = (1681.974450955533, 0.7071752369554196, 3.999843853973347, 0.4996667741545416)
HIGH_PASS = (38.13547087602444, 0.5003270373238773)
ABSOLUTE_GATE = -70.0
LUFS_OFFSET = -0.691


def k_filters(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Numerators and denominators of the high shelf and the high pass."""
    frequency, q, gain, share = SHELF
    top = 10.0 ** (gain / 20.0)
    bottom = top**share
    k = np.tan(np.pi * frequency / rate)
    norm = 1.0 + k / q + k * k
    shelf = (
        np.array([top + bottom * k / q + k * k, 2.0 * (k * k - top), top - bottom * k / q + k * k]) / norm,
        np.array([1.0, 2.0 * (k * k - 1.0) / norm, (1.0 - k / q + k * k) / norm]),
    )
    frequency, q = HIGH_PASS
    k = np.tan(np.pi * frequency / rate)
    norm = 1.0 + k / q + k * k
    high = (np.array([1.0, -2.0, 1.0]) / norm, np.array([1.0, 2.0 * (k * k - 1.0) / norm, (1.0 - k / q + k * k) / norm]))
    return [shelf, high]


def impulse_response(rate: int, length: int) -> np.ndarray:
    """Response of both filters to a unit impulse."""
    signal = np.zeros(length)
    signal[0] = 1.0
    for b, a in k_filters(rate):
        out = np.zeros(length)
        for n in range(length):
            value = b[0] * signal[n]
            if n > 0:
                value += b[1] * signal[n - 1] - a[1] * out[n - 1]
            if n > 1:
                value += b[2] * signal[n - 2] - a[2] * out[n - 2]
            out[n] = value
        signal = out
    return signal


def _with_history(blocks: DataFrame, seconds: float, block_frames: int) -> DataFrame:
    """Attach the preceding samples of up to so many seconds, at its own rate, to each block as ``history``.

    Blocks read with as many samples to their left, at least, have them already. Of others
    a block sends its tail to as many followers as the halo reaches; each block
    gathers its own few tails, never its track.
    """
    if "left" in blocks.columns:
        return blocks.withColumnRenamed("left", "history")
    halo, step = F.floor(F.col("sample_rate") * seconds).cast("int"), F.col("_j")
    reach = F.ceil(halo / block_frames).cast("int")
    # of a block j places back only the part within the halo is sent
    wanted = F.greatest(F.lit(0), F.least(F.size("samples"), halo - (step - 1) * F.lit(block_frames)))
    tails = (
        blocks.where(reach > 0).select(*BLOCK, "samples", "sample_rate", F.explode(F.sequence(F.lit(1), reach)).alias("_j"))
        .select("track_id", "channel", (F.col("block_no") + step).alias("block_no"), "_j",
                F.slice("samples", F.greatest(F.lit(1), F.size("samples") - wanted + 1), wanted.cast("int")).alias("_tail"))
    )
    gathered = tails.groupBy(*BLOCK).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-step).alias("o"), "_tail"))), lambda s: s["_tail"])).alias("history"))
    return blocks.join(gathered, BLOCK, "left")


class _Weighting:
    """K-weighting of one block with its history, by fast convolution with the impulse response."""

    def __init__(self, halo_s: float):
        self.halo_s, self.known = halo_s, {}

    def __call__(self, samples, history, rate: int) -> np.ndarray:
        halo = int(rate * self.halo_s)
        own = _array(samples)
        x = np.concatenate([_array(history)[-halo:], own])
        if rate not in self.known:
            self.known[rate] = impulse_response(rate, halo + 1)
        response = self.known[rate]
        size = 1 << int(len(x) + len(response) - 1).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(response, size), size)[: len(x)]
        return y[len(x) - len(own):]


HALO_S = 0.2


def k_weight(blocks: DataFrame, block_frames: int) -> DataFrame:
    """Blocks of the first two channels after K-weighting, each at its own rate."""
    prepared = _with_history(blocks.where("channel < 2"), HALO_S, block_frames)

    weigh = _Weighting(HALO_S)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = [weigh(s, h, int(r)) for s, h, r in zip(b["samples"], b["history"], b["sample_rate"])]
        return b[["track_id", "channel", "block_no", "first_frame", "sample_rate"]].assign(samples=out)

    return map_slices(
        prepared.select(*BLOCK, "first_frame", "sample_rate", "samples", "history"), run, "track_id string, channel int, block_no bigint, first_frame bigint, sample_rate int, samples array<double>")


def _window(rate):
    """Items of a 400 ms window and of its 100 ms hop."""
    return max(1, rate * 400 // 1000), max(1, rate * 100 // 1000)


def block_energies(blocks: DataFrame, block_frames: int, weighted: bool = True) -> DataFrame:
    """Mean square of 400 ms windows every 100 ms, channels summed; one partial window for a shorter clip.

    Each block is weighted and reduced to its share of the windows it touches in
    one pass, at its own sample rate, so only window sums leave the task.
    """
    source = blocks.where("channel < 2")
    prepared = _with_history(source, HALO_S, block_frames) if weighted else source.withColumn("history", F.lit(None).cast("array<float>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weigh = _Weighting(HALO_S)
        for b in batches:
            names, windows, sums = [], [], []
            for track, first, rate, samples, history in zip(b["track_id"], b["first_frame"], b["sample_rate"], b["samples"], b["history"]):
                window, hop = _window(int(rate))
                y = weigh(samples, history, int(rate)) if weighted else _array(samples)
                total = np.concatenate([[0.0], np.cumsum(y * y)])
                low = max(0, (first - window) // hop + 1)
                for w in range(low, (first + len(y) - 1) // hop + 1):
                    start, end = max(0, w * hop - first), min(len(y), w * hop + window - first)
                    if end > start:
                        names.append(track)
                        windows.append(w)
                        sums.append(total[end] - total[start])
            yield pd.DataFrame({"track_id": names, "window_no": np.asarray(windows, dtype="int64"), "s": np.asarray(sums, dtype="float64")})

    parts = prepared.select("track_id", "first_frame", "sample_rate", "samples", "history").mapInPandas(run, "track_id string, window_no bigint, s double")
    sums = parts.groupBy("track_id", "window_no").agg(F.sum("s").alias("s"))
    window, hop = (F.greatest(F.lit(1), F.floor(F.col("sample_rate") * ms / 1000)) for ms in (400, 100))
    frames = decoded_stats(blocks).select("track_id", "frames", window.alias("_window"), hop.alias("_hop"))
    whole = F.col("window_no") * F.col("_hop") + F.col("_window") <= F.col("frames")
    lone = (F.col("frames") < F.col("_window")) & (F.col("window_no") == 0)
    return sums.join(frames, "track_id").where(whole | lone).select(
        "track_id", "window_no", (F.col("s") / F.when(whole, F.col("_window")).otherwise(F.col("frames"))).alias("energy"))


def _lufs(energy: Column) -> Column:
    return F.lit(LUFS_OFFSET) + F.lit(10.0) * F.log10(F.greatest(energy, F.lit(2.2250738585072014e-308)))


def _energy(lufs: Column) -> Column:
    return F.pow(F.lit(10.0), (lufs - F.lit(LUFS_OFFSET)) / 10.0)


def gated_loudness(energies: DataFrame) -> DataFrame:
    """Integrated loudness with absolute and relative gate; minus infinity for silence."""
    loud = energies.where(F.col("energy") >= _energy(F.lit(ABSOLUTE_GATE)))
    gates = loud.groupBy("track_id").agg(F.avg("energy").alias("_u")).select("track_id", _energy(_lufs(F.col("_u")) - 10.0).alias("_gate"))
    gated = loud.join(gates, "track_id").where(F.col("energy") >= F.col("_gate")).groupBy("track_id").agg(F.avg("energy").alias("_g"))
    return energies.select("track_id").distinct().join(gated, "track_id", "left").select(
        "track_id", F.when(F.col("_g").isNull(), F.lit(float("-inf"))).otherwise(_lufs(F.col("_g"))).alias("lufs"))


def ensemble_mean(members: DataFrame) -> DataFrame:
    """Mean class probability over ensemble members (track_id, member, frame, probs)."""
    return members.select("track_id", "frame", F.posexplode("probs").alias("class", "_p")).groupBy("track_id", "frame", "class").agg(F.avg("_p").alias("p"))


def _sum_arrays(arrays: Column) -> Column:
    """Element-wise sum of a short list of equally long arrays."""
    return F.aggregate(
        F.slice(arrays, F.lit(2), F.size(arrays)), F.transform(F.get(arrays, F.lit(0)), lambda x: x.cast("double")),
        lambda acc, a: F.zip_with(acc, a, lambda p, q: p + q.cast("double")))


def mixdown_mono(blocks: DataFrame) -> DataFrame:
    """Mean over channels, block by block."""
    lists = blocks.groupBy("track_id", "block_no").agg(
        F.min("first_frame").alias("first_frame"), F.max("sample_rate").alias("sample_rate"),
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "samples"))), lambda s: s["samples"]).alias("_c"))
    summed = lists.withColumn("_s", _sum_arrays(F.col("_c"))).withColumn("_k", F.size("_c"))
    return summed.select("track_id", F.lit(0).alias("channel"), "block_no", "first_frame", "sample_rate", F.transform("_s", lambda x: x / F.col("_k")).alias("samples"))


def mix_stats(mono: DataFrame) -> DataFrame:
    """Mean and population deviation of a mono mix, for normalising before inference."""
    add = lambda acc, x: acc + x
    sums = mono.select(
        "track_id", F.size("samples").alias("_n"), F.aggregate("samples", F.lit(0.0), add).alias("_s"),
        F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x * x).alias("_q"))
    total = sums.groupBy("track_id").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"), F.sum("_q").alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    return total.select("track_id", mean.alias("mean"), (spread + 1e-8).alias("std"))


def normalized_mix(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    return blocks.join(stats, "track_id").withColumn(
        "samples", F.transform("samples", lambda x: (x - F.col("mean")) / F.col("std"))).drop("mean", "std")


# -- stems -------------------------------------------------------------------


def stem_channel_gains(mix: DataFrame) -> DataFrame:
    """Left and right gain of each stem, with mute and solo applied per track."""
    solo = mix.groupBy("track_id").agg(F.max("soloed").alias("_any"))
    silent = F.col("muted") | (F.col("_any") & ~F.col("soloed"))
    left, right = stem_gains(F.col("gain"), F.col("pan"), silent)
    return mix.join(solo, "track_id").select("track_id", "stem", left.alias("gain_left"), right.alias("gain_right"))


def stem_mix(stems: DataFrame, gains: DataFrame) -> DataFrame:
    """Stereo mix of mono stem blocks (track_id, stem, block_no, samples); stems with no gain are skipped."""
    sides = F.explode(F.array(
        F.struct(F.lit(0).alias("channel"), F.col("gain_left").alias("g")), F.struct(F.lit(1).alias("channel"), F.col("gain_right").alias("g"))))
    scaled = stems.join(gains, ["track_id", "stem"]).select("track_id", "stem", "block_no", "samples", sides.alias("o")).where("o.g > 0").select(
        "track_id", "stem", "block_no", F.col("o.channel").alias("channel"), F.transform("samples", lambda x: x.cast("double") * F.col("o.g")).alias("_v"))
    # a block has one row per stem, four at most
    lists = scaled.groupBy("track_id", "block_no", "channel").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("stem", "_v"))), lambda s: s["_v"]).alias("_l"))
    return lists.select("track_id", "block_no", "channel", _sum_arrays(F.col("_l")).alias("samples"))


def stem_peaks(stems: DataFrame, gains: DataFrame) -> DataFrame:
    """Largest magnitude each audible stem reaches after its gains, per block."""
    loudest = F.greatest("gain_left", "gain_right")
    return stems.join(gains, ["track_id", "stem"]).where(loudest > 0).groupBy("track_id", "stem", "block_no").agg(
        F.max(F.greatest(F.array_max("samples"), -F.array_min("samples")) * loudest).alias("peak"))


def align_stem(blocks: DataFrame, target_rate: int, target_frames: Column) -> DataFrame:
    """Linear resampling to a rate and length, as two channels.

    ``target_frames`` may use the track's ``frames``. Each source block makes the
    output frames that start within it, borrowing one sample from the next block.
    """
    edged = _sized(_with_edges(blocks, 0, 1)).withColumn("target", target_frames.cast("bigint")).withColumnRenamed("_right", "edge")
    doubled = edged.withColumn("out_channel", F.explode(
        F.when(F.col("channels") == 1, F.array(F.lit(0), F.lit(1))).when(F.col("channel") < 2, F.array(F.col("channel"))).otherwise(F.array().cast("array<int>"))))
    columns = ["track_id", "out_channel", "block_no", "first_frame", "sample_rate", "samples", "edge", "frames", "target"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples():
                own, edge = _array(row.samples), _array(row.edge)
                ratio = row.sample_rate / target_rate
                final = row.first_frame + len(own) >= row.frames
                low = int(np.ceil(row.first_frame / ratio - 1e-9))
                high = row.target if final else int(np.ceil((row.first_frame + len(own)) / ratio - 1e-9))
                t = np.arange(low, min(high, row.target))
                at = t * ratio
                first = np.minimum(np.floor(at).astype(np.int64), row.frames - 1)
                # a frame on the border can round into the neighbour; the neighbour owns it
                keep = (first >= row.first_frame) & (first < row.first_frame + len(own))
                if final:
                    keep = first >= row.first_frame
                t, at, first = t[keep], at[keep], first[keep]
                if len(t) == 0:
                    continue
                x = np.concatenate([own, edge if len(edge) else own[-1:]])
                second = np.minimum(first + 1, row.frames - 1)
                a, c = x[first - row.first_frame], x[second - row.first_frame]
                out.append((row.track_id, row.out_channel, row.block_no, int(t[0]), target_rate, a + (c - a) * (at - first)))
            yield pd.DataFrame(out, columns=["track_id", "channel", "block_no", "first_frame", "sample_rate", "samples"])

    return doubled.select(*columns).mapInPandas(
        run, "track_id string, channel int, block_no bigint, first_frame bigint, sample_rate int, samples array<double>")
