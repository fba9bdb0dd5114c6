"""Signal operators against plain NumPy, and independence of the block size."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stave.operators import fingerprints as FP
from stave.operators import inference as NN
from stave.operators import signal as G
from stave.operators import spectrum as SP
from stave.sources import wav as WV

SCHEMA = "track_id string, channel int, block_no bigint, first_frame bigint, sample_rate int, samples array<float>"


def blocks(spark, channels, rate, size):
    rows = [
        ("t", c, n, n * size, rate, [float(v) for v in x[n * size : (n + 1) * size]])
        for c, x in enumerate(channels) for n in range(-(-len(x) // size))
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def joined(df, name="samples"):
    return np.concatenate([r[name] for r in df.orderBy("block_no").collect()])


def sine(n, rate, hz=1000.0):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate).astype(np.float32)


def sequential(x, rate):
    for b, a in G.k_filters(rate):
        y = np.zeros(len(x))
        for n in range(len(x)):
            y[n] = b[0] * x[n] + (b[1] * x[n - 1] - a[1] * y[n - 1] if n > 0 else 0) + (b[2] * x[n - 2] - a[2] * y[n - 2] if n > 1 else 0)
        x = y
    return x


@pytest.mark.parametrize("size", [500, 4096])
def test_k_weight_blocks(spark, size):
    x = np.random.default_rng(1).uniform(-1, 1, 12_000)
    made = joined(G.k_weight(blocks(spark, [x], 8000, size), size))
    assert np.abs(made - sequential(np.float32(x).astype(float), 8000)).max() < 1e-9


@pytest.mark.parametrize("size", [1000, 48_000])
def test_loudness_and_peak(spark, size):
    x = sine(48_000, 48_000)
    b = blocks(spark, [x, x], 48_000, size)
    lufs = G.gated_loudness(G.block_energies(b, size)).first().lufs
    assert -1 < lufs < 0.2
    assert 0.99 < G.true_peak(b).first().true_peak < 1.01
    silent = blocks(spark, [np.zeros(8000)], 8000, 1000)
    assert G.gated_loudness(G.block_energies(silent, 1000)).first().lufs == float("-inf")
    short = blocks(spark, [sine(2000, 8000)], 8000, 700)
    assert G.block_energies(short, 700).count() == 1


@pytest.mark.parametrize("size", [64, 1000])
def test_peaks(spark, size):
    x = np.random.default_rng(2).uniform(-1, 1, 5000).astype(np.float32)
    made = {r.bucket: (r.min, r.max) for r in G.waveform_peaks(blocks(spark, [x], 8000, size), 100).collect()}
    assert made == {n: (min(1.0, float(x[n * 50 : n * 50 + 50].min())), max(-1.0, float(x[n * 50 : n * 50 + 50].max()))) for n in range(100)}
    four = spark.createDataFrame([("t", 0, -.2, .4), ("t", 1, -.8, .1), ("t", 2, -.4, .9), ("t", 3, -.1, .2)], "track_id string, bucket bigint, min double, max double")
    assert sorted((r.min, r.max) for r in G.visible_peaks(four, 1.0, 0.0, 2).collect()) == [(-.8, .4), (-.4, .9)]


@pytest.mark.parametrize("size", [512, 6000])
def test_spectrum(spark, size):
    b = blocks(spark, [sine(12_000, 48_000)], 48_000, size)
    at = spark.createDataFrame([("t", 0, 6000), ("t", 1, 0), ("t", 2, 11_999)], "track_id string, frame_no bigint, position bigint")
    made = {r.frame_no: r.bands for r in SP.band_spectrum(SP.hann_frames(b, at, size)).collect()}
    assert all(len(v) == 64 for v in made.values()) and max(made[0]) > 0.7


def test_stems(spark):
    stems = spark.createDataFrame([("t", 0, 0, [.8, .4]), ("t", 1, 0, [.3, .6])], "track_id string, stem int, block_no bigint, samples array<float>")
    mix = spark.createDataFrame([("t", 0, 1.0, .5, False, False), ("t", 1, 1.0, 0.0, True, False)], "track_id string, stem int, gain double, pan double, muted boolean, soloed boolean")
    made = {r.channel: np.round(r.samples, 6).tolist() for r in G.stem_mix(stems, G.stem_channel_gains(mix)).collect()}
    assert made == {0: [.4, .2], 1: [.8, .4]}


@pytest.mark.parametrize("size", [1, 3])
def test_align(spark, size):
    made = G.align_stem(blocks(spark, [[0, 1, 0]], 3, size), 6, F.lit(6))
    for channel in (0, 1):
        assert joined(made.where(F.col("channel") == channel)).tolist() == [0, .5, 1, .5, 0, 0]


@pytest.mark.parametrize("length, batch, size", [(5000, 2, 256), (5000, 1, 1000), (300, 2, 256), (90, 2, 256)])
def test_overlap_add_identity(spark, length, batch, size):
    x = np.random.default_rng(3).uniform(-1, 1, length)
    made = joined(NN.overlap_add(blocks(spark, [x], 8000, size), "identity", 400, 4, batch, size))
    # frame 0 has weight 0 where neither padding nor the first-batch rule covers it
    start = 1 if length <= 600 and batch > 1 and length > 100 else 0
    assert np.abs(made[start:] - np.float32(x)[start:]).max() < 1e-9


def test_failing_model(spark):
    def factory():
        def model(x):
            if (x[:, :, 0] < 0).any():
                raise ValueError("negative")
            return x[:, None]
        return model

    NN.register_model("picky", factory)
    rows = spark.createDataFrame([(i, [[float(v), 1.0]]) for i, v in enumerate([1, -1, 2])], "i int, chunk array<array<double>>").coalesce(1)
    assert [(r.i, r.outputs is None, r.error is None) for r in NN.batch_infer(rows, "picky", 3).orderBy("i").collect()] == [(0, False, True), (1, True, False), (2, False, True)]


def brute(prints):
    pairs = set()
    for a in prints:
        for b in prints:
            if a[1:2] + a[:1] >= b[1:2] + b[:1]:
                continue
            da, db = a[3], b[3]
            if da is not None and db is not None and abs(da - db) > max(2.0, .01 * min(da, db)):
                continue
            x, y = np.array(a[4]), np.array(b[4])
            for offset in range(-len(y), len(x)):
                low, high = max(0, offset), min(len(x), len(y) + offset)
                agree = sum(int(x[i]) >> 20 == int(y[i - offset]) >> 20 for i in range(low, high))
                if agree < 2:
                    continue
                need = FP.required_items(min(len(x), len(y)))
                wrong = [bin(int(x[i]) ^ int(y[i - offset])).count("1") for i in range(low, high)]
                if any(sum(wrong[i:j]) <= 5 * (j - i) for i in range(len(wrong)) for j in range(i + need, len(wrong) + 1)):
                    pairs.add((a[0], b[0]))
                    break
    return pairs


def test_fingerprints_brute_force(spark):
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 32, 60) for _ in range(4)]
    rows = [(f"t{i}", i, 2, 45.0 + i % 2, [int(v) for v in x]) for i, x in enumerate(base)]
    noisy = lambda x, bits: [int(v) ^ sum(1 << int(k) for k in rng.choice(20, bits, replace=False)) for v in x]
    rows += [("near", 10, 2, 45.1, noisy(base[0], 4)), ("far", 11, 2, 45.1, noisy(base[1], 9)), ("late", 12, 2, 60.0, [int(v) for v in base[2]]),
             ("cut", 13, 2, None, [int(v) for v in base[2][9:]]), ("copy", 14, 2, 46.0, [int(v) for v in base[3]]), ("old", 15, 1, 45.0, [int(v) for v in base[0]])]
    df = spark.createDataFrame(rows, "track_id string, position bigint, version int, duration_s double, values array<bigint>")
    first = FP.representatives(df)
    kept = {r.track_id for r in first.collect()}
    assert {(r.a, r.b) for r in FP.fingerprint_matches(first).collect()} == brute([r for r in rows if r[0] in kept])
    found = {r.track_id: r.duplicate_of for r in FP.fingerprint_duplicates(df).collect()}
    assert found["near"] == "t0" and found["copy"] == "t3" and found["cut"] == "t2"
    assert not {"far", "late", "old", "t0"} & set(found)


def test_wav(spark, tmp_path):
    import struct

    x = (np.arange(2500) % 100 - 50).astype("<i2") * 300
    body = np.stack([x, -x], axis=1).astype("<i2").tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(body))
    (tmp_path / "a.wav").write_bytes(head + body)
    (tmp_path / "b.wav").write_bytes(b"nonsense")
    (tmp_path / "c.wav").write_bytes(head[:-4] + struct.pack("<I", 0))
    meta = WV.wav_metadata(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in meta.collect()} == {"a.wav": None, "b.wav": "not a WAV file", "c.wav": "empty stream"}
    made = WV.scan_wav_blocks(meta, 1000)
    assert made.count() == 6
    assert np.array_equal(joined(made.where("channel = 1")), (-x).astype(np.float32) / np.float32(32768))


def test_mixed_rates_are_measured_alike(spark):
    low, high = blocks(spark, [sine(8000, 8000)], 8000, 1000), blocks(spark, [sine(48_000, 48_000)], 48_000, 1000).withColumn("track_id", F.lit("u"))
    alone = {r.track_id: r.lufs for b in (low, high) for r in G.gated_loudness(G.block_energies(b, 1000)).collect()}
    together = {r.track_id: r.lufs for r in G.gated_loudness(G.block_energies(low.unionByName(high), 1000)).collect()}
    assert together == pytest.approx(alone) and set(together) == {"t", "u"}


def test_a_failing_model_loses_no_block(spark):
    def factory():
        def model(batch):
            if np.abs(batch).max() > 1:
                raise ValueError("too loud")
            return batch[:, None]

        return model

    NN.register_model("shy", factory)
    x = np.full(1000, 0.5)
    x[700:] = 2.0
    rows = {r.block_no: r for r in NN.overlap_add(blocks(spark, [x], 8000, 100), "shy", chunk=200, overlaps=2, batch=1, block_frames=100).collect()}
    assert sorted(rows) == list(range(10))
    assert all((r.samples is None) == (r.error is not None) for r in rows.values())
    assert rows[0].samples == pytest.approx([0.5] * 100) and rows[9].error == "ValueError: too loud" and rows[9].stem is None


def test_oversized_files_are_reported(spark, tmp_path):
    from stave.sources.imports import read_import_texts

    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.md").write_text("x" * (1 << 20) + "y")
    (tmp_path / "c.bin").write_text("no")
    made = {r.batch_id.rpartition("/")[2]: (r.text, r.error) for r in read_import_texts(spark, str(tmp_path)).collect()}
    assert made == {"a.txt": ("one\ntwo", None), "b.md": (None, "larger than 1 MiB")}


def _wav_bytes(channels, rate):
    body = np.stack(channels, axis=1).astype("<f4").tobytes()
    n = len(channels)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, n, rate, rate * n * 4, n * 4, 32) + b"data" + struct.pack("<I", len(body)) + body


def _exchanged(df):
    """The columns that exchanges of a plan move."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_blocks_read_with_their_borders(spark, tmp_path):
    rng = np.random.default_rng(9)
    made = {"a": (8000, [rng.uniform(-1, 1, 5001), rng.uniform(-1, 1, 5001)]), "b": (4000, [rng.uniform(-1, 1, 3000)]), "c": (4000, [rng.uniform(-1, 1, 7)])}
    for name, (rate, channels) in made.items():
        (tmp_path / f"{name}.wav").write_bytes(_wav_bytes([x.astype(np.float32) for x in channels], rate))
    rows = WV.scan_wav_blocks(WV.wav_metadata(spark, str(tmp_path)), block_frames=300, before_s=G.HALO_S, after=2)
    rows = rows.withColumn("track_id", F.regexp_extract("path", r"([^/]*)\.wav$", 1)).drop("path")
    plain = rows.drop("left", "right", "frames", "channels")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for work, keys in (
            (lambda b: G.waveform_peaks(b, 100), ["track_id", "bucket"]), (G.true_peak, ["track_id"]), (lambda b: G.block_energies(b, 300), ["track_id", "window_no"]),
            (lambda b: G.k_weight(b, 300), ["track_id", "channel", "block_no"]), (lambda b: G.align_stem(b, 6000, F.col("frames")), ["track_id", "channel", "block_no"]),
        ):
            own, joined_rows = work(rows), work(plain)
            values = [n for n in own.columns if n not in keys]
            got, want = ({tuple(r[k] for k in keys): [r[n] for n in values] for r in x.collect()} for x in (own, joined_rows))
            assert got.keys() == want.keys() and len(got)
            for k in want:
                assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got[k], want[k])), (keys, k)
            # The only rows exchanged before a reduction are ranges to read.
            joins = own._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in _exchanged(own) if "samples" in line]
            assert not moved and ("SortMergeJoin" not in joins or keys == ["track_id", "window_no"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
