"""WARC records in ZIP packages: a writer, and a reader that fetches records by byte range.

A package holds WARC files and their index as stored members; each record is compressed on
its own, as is usual in WARC files, so a range of records can be read alone. The reader finds the central
directory (ZIP64 included) from the end of the file, locates the members, reads the index,
and then reads only the byte ranges of the records; nothing is extracted. Ranges are rows,
so a large package is read by many tasks. Packages lie in any store that Arrow's file
systems open by URI.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stave.llm.steps import step
from stave.session import new_dir

REVISIT_BYTES = 100
PACKAGE_BYTES = 256 << 20
MEMBER_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Packed bytes that one task reads, and unpacked ones that it hands on at a time; packages whose indexes one task reads.
TASK_BYTES, BATCH_BYTES, TASK_INDEXES, MOST_TASKS = 8 << 20, 16 << 20, 4, 50_000
# Fixed values of the formats.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_END, _END64, _LOCATE64, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder, also by the scheme names of Hadoop."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _record(kind: str, page: int | None, url: str, payload: bytes, size: int, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"]
    body = http + (payload if kind == "response" else b"")
    return gzip.compress("\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n", 6, mtime=0)


class _Packages:
    """Writes records to members of packages, and starts anew at the size limits."""

    def __init__(self, folder: str):
        self.store, self.folder = open_store(folder)
        self.written: list[tuple[str, int]] = []
        self.package = self.member = None

    def add(self, record: bytes) -> None:
        if self.package is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.zip"
            self.stream = self.store.open_output_stream(self.path)
            self.package, self.index, self.size = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED), [], 0
        if self.member is None:
            self.name, self.at = f"archive/data-{len(self.package.namelist()):05d}.warc.gz", 0
            self.member = self.package.open(self.name, "w", force_zip64=True)
        self.member.write(record)
        self.index.append((self.name, self.at, len(record)))
        self.at += len(record)
        self.size += len(record)
        if self.at >= MEMBER_BYTES:
            self.member.close()
            self.member = None
        if self.size >= PACKAGE_BYTES:
            self.close()

    def close(self) -> None:
        if self.package is None:
            return
        if self.member is not None:
            self.member.close()
        with self.package.open("indexes/index.jsonl", "w", force_zip64=True) as out:
            for entry in self.index:
                out.write((json.dumps(entry) + "\n").encode())
        self.package.close()
        self.stream.close()
        self.written.append((self.path, len(self.index)))
        self.package = self.member = None


def _writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Packages(folder)
        for batch in batches:
            for row in batch.to_pylist():
                kind = "response" if row["refers_to"] is None else "revisit"
                out.add(_record(kind, row["page_id"], row["url"], row["payload"], row["n"], row["digest"], row["refers_to"]))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out.written], pa.string()), pa.array([n for _, n in out.written], pa.int64())], ["path", "records"])

    return run


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row to packages in ``folder``; returns (path, records) of the packages.

    The payload is the text in UTF-8 (null: empty). Of rows with equal payloads of at
    least 100 bytes, that of the smallest id is a response and the others revisit it; a
    null id revisits unless all its equals are null too. Repeated rows are repeated
    records, and those of the smallest id are all responses; an empty table gives no package. A task that is run again
    writes new packages; only those of the returned table count.
    """
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    first = rows.where(F.col("n") >= REVISIT_BYTES).groupBy(F.col("digest").alias("_same")).agg(F.min("page_id").alias("first"))
    both = rows.join(first, (F.col("digest") == F.col("_same")) & (F.col("n") >= REVISIT_BYTES), "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    both = both.select("page_id", "url", F.when(~revisits, F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "n", "digest", F.when(revisits, F.col("first")).alias("refers_to"))
    return step(both.mapInArrow(_writer(folder), "path string, records long"), "packages")


def central_directory(file) -> list[tuple[str, int, int]]:
    """(name, start, bytes) of the stored members of an open package, from its central or ZIP64 directory."""
    file.seek(0, 2)
    size = file.tell()
    tail_at = max(0, size - 22 - 65535 - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20: end - 16] == _LOCATE64:
        (far,) = struct.unpack_from("<Q", tail, end - 12)
        file.seek(far)
        wide = file.read(56)
        if wide[:4] != _END64:
            raise ValueError("no ZIP64 directory end")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    file.seek(start)
    listing, at, members = file.read(length), 0, []
    for _ in range(count):
        if listing[at: at + 4] != _ENTRY:
            raise ValueError("a broken central directory")
        method = struct.unpack_from("<H", listing, at + 10)[0]
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", listing, at + 20)
        local = struct.unpack_from("<I", listing, at + 42)[0]
        name = listing[at + 46: at + 46 + names].decode()
        extra, stop = at + 46 + names, at + 46 + names + extras
        while extra + 4 <= stop:
            tag, many = struct.unpack_from("<HH", listing, extra)
            if tag == 1:
                # Only fields that are full in the entry are in the ZIP64 field, in this order.
                field = extra + 4
                if plain == 0xFFFFFFFF:
                    plain, field = struct.unpack_from("<Q", listing, field)[0], field + 8
                if packed == 0xFFFFFFFF:
                    packed, field = struct.unpack_from("<Q", listing, field)[0], field + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", listing, field)[0]
            extra += 4 + many
        at = stop + notes
        file.seek(local)
        head = file.read(30)
        if method == 0 and head[:4] == _LOCAL:
            n, x = struct.unpack_from("<HH", head, 26)
            members.append((name, local + 30 + n + x, packed))
    return members


def _ranges(scheme: str) -> Callable:
    """Byte ranges of whole records, from the packages' indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(scheme)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                starts, sizes = [], []
                with store.open_input_file(path) as file:
                    members = central_directory(file)
                    place = {name: start for name, start, _ in members}
                    for name, start, size in members:
                        if not name.startswith("indexes/"):
                            continue
                        file.seek(start)
                        for line in file.read(size).decode().splitlines():
                            member, at, n = json.loads(line)
                            at += place[member]
                            if starts and starts[-1] + sizes[-1] == at and sizes[-1] + n <= RANGE_BYTES:
                                sizes[-1] += n
                            else:
                                starts.append(at)
                                sizes.append(n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "start", "size"])

    return run


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each WARC record."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should start")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        yield head, data[stop + 4: stop + 4 + n]
        at = stop + 4 + n + 4


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def unpacked(data: bytes) -> Iterator[bytes]:
    """The members of a range of gzip members one by one, or the range itself if it isn't packed."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(data):
            part = view[at: at + 65536]
            parts.append(member.decompress(part))
            at += len(part)
        if not member.eof:
            raise ValueError("a record is cut off")
        at -= len(member.unused_data)
        yield b"".join(parts)


_READ = ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())


def _read(path: str, head: dict[str, str], block: bytes) -> tuple:
    """The columns of a record; a response's payload must be that of its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    response = head["warc-type"] == "response"
    digest = hashlib.sha256(payload).hexdigest() if response else head["warc-payload-digest"].removeprefix("sha256:")
    if response and head["warc-payload-digest"] != f"sha256:{digest}":
        raise ValueError(f"a payload in {path} is not that of its digest")
    return _page(head["warc-record-id"]), head["warc-target-uri"], int(told["content-length"]), digest, head["warc-type"], _page(head.get("warc-refers-to")), payload if response else None


def _reader(scheme: str) -> Callable:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), _READ)], [n for n, _ in _READ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(scheme)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(row["path"]) as file:
                    file.seek(row["start"])
                    data = file.read(row["size"])
                out, held = [], 0
                for member in unpacked(data):
                    for head, block in parse_records(member):
                        out.append(_read(row["path"], head, block))
                        held += len(block)
                        if held >= BATCH_BYTES:
                            yield batch_of(out)
                            out, held = [], 0
                if out:
                    yield batch_of(out)

    return run


def read_packages(packages: DataFrame, folder: str) -> DataFrame:
    """One row per record of the packages (column ``path``) of a folder: id, url, payload size and digest, type, ``refers_to`` and payload (null for revisits).

    Each record is a row, so repeated records repeat; an empty table of packages gives no
    rows, and a package that is broken or whose payload does not fit its digest is an error.
    Ranges of 4 MB are dealt evenly over tasks of about 8 MB, and unpacked record by record.
    """
    # Rows are few and short here, so tasks are dealt by what they will read, not by the rows' size.
    many = packages.count()
    dealt = packages.select("path").repartition(min(MOST_TASKS, max(1, -(-many // TASK_INDEXES))))
    ranges = step(dealt.mapInArrow(_ranges(folder), "path string, start long, size long"), "ranges")
    total = ranges.agg(F.sum("size")).first()[0] or 0
    kind = ", ".join(f"{n} {'long' if pa.types.is_integer(t) else 'binary' if pa.types.is_binary(t) else 'string'}" for n, t in _READ)
    return ranges.repartition(min(MOST_TASKS, max(1, -(-total // TASK_BYTES)))).mapInArrow(_reader(folder), kind)


def shared_uri(spark: SparkSession, label: str) -> str:
    return new_dir(spark, label)


def op8_zip_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_uri(spark, "warc")
    packages = write_packages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_packages(packages, folder).drop("url", "payload")
