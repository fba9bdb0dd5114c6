"""WAV files as fixed-size sample blocks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, sample_rate int, channels int, code int, width int, data_offset bigint, frames bigint, reason string"
BLOCKS = "path string, channel int, block_no bigint, first_frame bigint, sample_rate int, samples array<float>, frames bigint, channels int, left array<float>, right array<float>"


def _header(path: str) -> tuple:
    """Walk the RIFF chunks; only a few bytes of the file are read."""
    from stave.sources.files import open_range, size_of

    none = (path, None, None, None, None, None, None)
    total = size_of(path)
    with open_range(path) as handle:
        start = handle.read(12)
        if len(start) < 12 or start[:4] != b"RIFF" or start[8:12] != b"WAVE":
            return (*none, "not a WAV file")
        at, form = 12, None
        while at + 8 <= total:
            handle.seek(at)
            name, size = struct.unpack("<4sI", handle.read(8))
            if name == b"fmt ":
                form = struct.unpack("<HHIIHH", handle.read(16))
            elif name == b"data" and form:
                code, channels, rate, _, align, bits = form
                if (code, bits) not in ((1, 16), (3, 32)):
                    return (*none, "unsupported encoding")
                if channels == 0 or rate == 0:
                    return (*none, "invalid format")
                frames = min(size, total - at - 8) // align
                if frames == 0:
                    return (*none, "empty stream")
                return path, rate, channels, code, bits // 8, at + 8, frames, None
            at += 8 + size + size % 2
    return (*none, "no audio data")


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in HEADER.split(", ")]
    for batch in batches:
        yield pd.DataFrame([_header(p) for p in batch["path"]], columns=names).astype(object)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from stave.sources.files import open_range

    names = [part.split()[0] for part in BLOCKS.split(", ")]
    for batch in batches:
        out = []
        for row in batch.itertuples():
            step = row.channels * row.width
            low, high = max(0, row.first_frame - row.before), min(row.frames, row.first_frame + row.count + row.after)
            with open_range(row.path) as handle:
                handle.seek(row.data_offset + low * step)
                raw = handle.read(int(high - low) * step)
            if row.code == 1:
                values = np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32768)
            else:
                values = np.frombuffer(raw, "<f4")
            begin = row.first_frame - low
            left, own, right = np.split(values.reshape(-1, row.channels), [begin, begin + row.count])
            for channel in range(row.channels):
                out.append((row.path, channel, row.block_no, row.first_frame, row.sample_rate, own[:, channel], row.frames, row.channels, left[:, channel], right[:, channel]))
        yield pd.DataFrame(out, columns=names)


def wav_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Format, duration and the reason a file is set aside, from the headers alone."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    headers = listing.select("path").mapInPandas(_headers, HEADER)
    return headers.withColumn("duration_s", F.col("frames") / F.col("sample_rate"))


def scan_wav_blocks(metadata: DataFrame, block_frames: int = 65_536, partitions: int | None = None, before_s: float = 0.0, after: int = 0) -> DataFrame:
    """Blocks of each channel, with the file's ``frames`` and ``channels``. Every block is its own row before it is read, so a long file spreads over tasks.

    ``left`` holds the samples of up to ``before_s`` seconds before a block and ``right`` those of
    ``after`` frames behind it. They are read with the block, as one byte range, so what looks
    over a block's borders needs no exchange of samples.
    """
    good = metadata.where("reason IS NULL")
    last = F.floor((F.col("frames") - 1) / block_frames)
    ranges = good.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        "first_frame", F.col("block_no") * block_frames
    ).withColumn("count", F.least(F.lit(block_frames).cast("bigint"), F.col("frames") - F.col("first_frame")))
    ranges = ranges.withColumns({"before": F.floor(F.col("sample_rate") * before_s).cast("bigint"), "after": F.lit(after).cast("bigint")})
    spread = ranges.repartition(partitions, "path", "block_no") if partitions else ranges.repartition("path", "block_no")
    return spread.mapInPandas(_read, BLOCKS)
