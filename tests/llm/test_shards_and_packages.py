"""Hilbert shards, and WARC records in ZIP packages."""

import collections
import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stave.llm import zip_warc as Z
from stave.llm.hilbert_shards import hilbert_index, hilbert_shards, op1_hilbert_shards

AXES = ["lang", "source", "n_chars", "doc_id"]


@pytest.mark.parametrize("sides", [2, 3])
def test_curve_visits_neighbours(spark, sides):
    names = [f"x{i}" for i in range(sides)]
    grid = spark.range(8 ** sides).selectExpr(*(f"(id div {8 ** i}) % 8 as {n}" for i, n in enumerate(names)))
    places = sorted(tuple(r) for r in hilbert_index(grid, names, 3, "h").select("h", *names).collect())
    assert [p[0] for p in places] == list(range(8 ** sides))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:])) == 1 for p, q in zip(places, places[1:]))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (5, "x", "src0", "en", 1), (5, "x", "src0", "en", 1), (6, "", "src0", "xx", 0)], docs.schema)
    rows = hilbert_shards(docs.unionByName(odd), AXES, law=law).collect()
    assert len(rows) == docs.count() + 4 and {r.law for r in rows} == {law} and all(r.grown_shard is None for r in rows)
    shards, sizes = collections.defaultdict(list), collections.Counter()
    for r in rows:
        shards[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(shards) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    if law == "rows":
        assert len(shards) == 24 and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    else:
        assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_shard_query(spark):
    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = op1_hilbert_shards(spark, base).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t) + 8, zlib.crc32(t)) for d, t in texts.items()}
    empty = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    assert hilbert_shards(empty, AXES).count() == 0


def test_packages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "MEMBER_BYTES", 1 << 16)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(10001, "u", None), (10002, "u", ""), (10003, "u é\r\nx", "é" * 60), (10004, None, "é" * 60), (10005, "u", "short"), (10006, "u", "short"), (None, "u", "é" * 60), (10003, "u", "é" * 60)]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, n string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Z.op8_zip_warc(spark, str(tmp_path)).collect())
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    want = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        head = first.get(data)
        again = head is not None and head != page
        want[page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", head if again else None] += 1
    assert got == want


def test_reading_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    pages = [(i, "u", rng.bytes(60_000).hex()) for i in range(40)]
    monkeypatch.setattr(Z, "PACKAGE_BYTES", 500_000)
    monkeypatch.setattr(Z, "RANGE_BYTES", 100_000)
    monkeypatch.setattr(Z, "TASK_BYTES", 250_000)
    monkeypatch.setattr(Z, "BATCH_BYTES", 200_000)
    packages = Z.write_packages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/warc")
    got = Z.read_packages(packages, f"file://{tmp_path}/warc")
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect()} == {i: h for i, _, h in pages}
    spread = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) >= 8 and max(r["count"] for r in spread) <= 10
    assert Z.read_packages(packages.limit(0), f"file://{tmp_path}/warc").count() == 0


def test_empty_table_of_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert Z.op8_zip_warc(spark, str(tmp_path)).count() == 0


def test_members_one_by_one():
    parts = [b"a" * 200_000, b"", b"bc"]
    assert list(Z.unpacked(b"".join(gzip.compress(p) for p in parts))) == parts and list(Z.unpacked(b"plain")) == [b"plain"]
    with pytest.raises(ValueError):
        list(Z.unpacked(gzip.compress(b"x" * 99)[:-3]))


def test_directory_of_ordinary_and_zip64_archives():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        out.comment = b"a comment"
        with out.open("a.warc", "w", force_zip64=True) as member:
            member.write(b"first")
        out.writestr("b.warc", b"second")
        out.writestr("c.warc", b"packed" * 99, zipfile.ZIP_DEFLATED)
    found = Z.central_directory(data)
    assert [(n, data.getvalue()[s: s + k]) for n, s, k in found] == [("a.warc", b"first"), ("b.warc", b"second")]
    # the same directory told by ZIP64 fields alone
    name, body = b"d.warc", b"far away"
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    tail = b"PK\6\7" + struct.pack("<IQI", 0, len(local) + len(entry), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + entry + end64 + tail
    assert [(n, whole[s: s + k]) for n, s, k in Z.central_directory(io.BytesIO(whole))] == [("d.warc", body)]
    with pytest.raises(ValueError):
        Z.central_directory(io.BytesIO(b"nothing"))
