"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some whole records,
then two skippable frames: the record index (identifier hash -> frame, offset
inside the frame, length) and, last, the seek table of the public seekable
format. Any Zstandard tool reads a bundle as one stream; a reader with the
footer decompresses only the frame it needs.

Records with equal payloads are written once: the smallest page is a response,
the others revisit it.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm.binary_files import read_files, write_files
from topicspark.llm.common import same, shared_path, small_batches, written

#: Bytes of records in a frame and of frames in a bundle; a larger record has a frame, a larger frame a bundle of its own.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 16 << 20
LEVEL, MIN_REVISIT, DATE = 3, 100, "2024-01-01T00:00:00Z"
# Fixed values of the seekable Zstandard format and of WARC 1.1.
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, struct.pack("<I", 0x8F92EAB1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ENTRY = np.dtype([("id", "<u8"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str) -> str | None:
    return urn[len("<urn:x-page:"):-1] or None


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """A WARC record: a response with the payload, or a revisit with its HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at byte {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} is cut off")
    return head, data[start:stop], stop + 4


class Bundle:
    """Collects records; ``close`` gives the file's bytes but for the last four, the magic number."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.frames, self.sizes, self.index, self.open, self.filled, self.bytes = [], [], [], [], 0, 0

    def add(self, rid: str, rec: bytes) -> None:
        self.index.append((xxhash.xxh64_intdigest(rid), len(self.frames), self.filled, len(rec)))
        self.open.append(rec)
        self.filled += len(rec)
        if self.filled >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), self.filled))
        self.bytes += len(packed)
        self.open, self.filled = [], 0

    def close(self) -> bytes:
        if self.open:
            self._frame()
        index = np.sort(np.array(self.index, _ENTRY), order=["id", "frame", "offset"]).tobytes()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IB", len(self.sizes), 0)
        return b"".join([*self.frames, struct.pack("<II", INDEX_FRAME, len(index)), index, struct.pack("<II", SEEK_FRAME, len(table) + 4), table])


class BundleReader:
    """Random access to a bundle's records."""

    def __init__(self, data: bytes):
        if data[-4:] != SEEK_MAGIC:
            raise ValueError("no seek table")
        count, flags = struct.unpack("<IB", data[-9:-4])
        width = 12 if flags & 0x80 else 8
        start = len(data) - 9 - count * width
        sizes = np.frombuffer(data, "<u4", count * width // 4, start).reshape(count, width // 4).astype(np.int64)
        self.data, self.ends, self.unpacked = data, np.concatenate([[0], np.cumsum(sizes[:, 0])]), sizes[:, 1]
        at = int(self.ends[-1])
        magic, size = struct.unpack("<II", data[at:at + 8])
        if magic != INDEX_FRAME or at + 8 + size + 8 != start:
            raise ValueError("no record index")
        self.index = np.frombuffer(data, _ENTRY, size // _ENTRY.itemsize, at + 8)
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        out = self.unpacker.decompress(self.data[self.ends[i]:self.ends[i + 1]])
        if len(out) != self.unpacked[i]:
            raise ValueError(f"frame {i} has another size than the seek table says")
        return out

    def find(self, rid: str) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records of that identifier: one frame each is decompressed."""
        key = np.uint64(xxhash.xxh64_intdigest(rid))
        for e in self.index[np.searchsorted(self.index["id"], key):np.searchsorted(self.index["id"], key, side="right")]:
            head, block, _ = parse(self.frame(int(e["frame"])), int(e["offset"]))
            if head["WARC-Record-ID"] == rid:
                yield head, block

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.unpacked)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, block, at = parse(data, at)
                yield head, block


def _bundles(batches):
    out = Bundle()
    for b in batches:
        for page, url, html, digest, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
            out.add(record_id(page), record(page, url, html.encode(), digest, first))
            if out.bytes >= BUNDLE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], ["bundle"])
                out = Bundle()
    if out.index:
        yield pa.RecordBatch.from_arrays([pa.array([out.close()], pa.binary())], ["bundle"])


def write_bundles(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write ``pages`` <page_id, url, html> as bundles under ``path``.

    Equal payloads (html in UTF-8, null: empty) of at least ``min_revisit``
    bytes have one response, the smallest page_id; rows that repeat it stay
    responses, as does a null page_id that has no other page to revisit. A null
    url leaves the header out. An empty table writes no bundle.
    """
    small_batches(pages.sparkSession)
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    # only identifiers and digests are grouped, so a payload that a third of all pages share moves no text
    keys = written(base.select("page_id", "digest", F.octet_length("html").alias("size")), "digests")
    first = keys.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    revisits = (keys.join(first, "digest").where(~same("page_id", "first") & F.col("first").isNotNull())
                .groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
                .withColumnsRenamed({"page_id": "_page", "digest": "_digest"}))
    records = base.join(revisits, same("page_id", "_page") & (F.col("digest") == F.col("_digest")), "left")
    records = records.select("page_id", "url", "html", "digest", "refers_to").sortWithinPartitions("page_id")
    write_files(records.mapInArrow(_bundles, "bundle binary"), "bundle", SEEK_MAGIC, path)


def _entries(id_type: pa.DataType):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch(rows):
        cols = list(zip(*rows))
        ids = [pa.array(cols[i], pa.string()).cast(id_type) for i in (0, 4)]
        return pa.RecordBatch.from_arrays([ids[0], pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), ids[1]], names)

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = []
                for head, block in BundleReader(content.as_py()).records():
                    end = block.index(b"\r\n\r\n") + 4
                    http = dict(x.split(": ", 1) for x in block[:end - 4].decode().split("\r\n")[1:])
                    size, digest, payload = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), block[end:]
                    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{head['WARC-Record-ID']}: its payload isn't the one written")
                    rows.append((_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                    if len(rows) >= 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)
    return run


def read_bundles(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """<page_id, payload_bytes, payload_digest, record_type, refers_to> of all
    records under ``path``; responses' payloads are checked against their digests."""
    arrow = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    return read_files(spark, path).mapInArrow(
        _entries(arrow), f"page_id {id_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {id_type}")


def _lookup(rids: list[str]):
    def run(batches):
        for b in batches:
            for content in b.column("content"):
                reader = BundleReader(content.as_py())
                for rid in rids:
                    found = [(rid, h["WARC-Type"], block) for h, block in reader.find(rid)]
                    if found:
                        r, t, p = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(t), pa.array(p, pa.binary())], ["record_id", "record_type", "block"])
    return run


def find_records(spark: SparkSession, path: str, page_ids: list) -> DataFrame:
    """<record_id, record_type, block> of some pages: one frame is decompressed for each record found."""
    return read_files(spark, path).mapInArrow(_lookup([record_id(p) for p in page_ids]), "record_id string, record_type string, block binary")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as bundles (under ``path``, or a new path in the shared
    folder) and read them back: one row per page."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_bundles(pages, path)
    id_type = pages.schema["page_id"].dataType.simpleString()
    return read_bundles(spark, path, id_type)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, min(page_id) AS first_id FROM p WHERE strlen(t) >= 100 GROUP BY t)
SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, sha256(p.t) AS payload_digest,
       CASE WHEN g.first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first_id <> page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (t)
"""
