"""Document fingerprints: quartile digests of hashed byte triplets.

Of each window of five bytes of a text (four zero bytes stand before it), the
triplets that hold its last byte are hashed into 256 buckets and counted. A
bucket's code tells in which quarter of all buckets its count lies; a digest is
the length on a logarithmic scale, the proportions of the quartiles, and the
codes. Two digests differ by the steps between their codes, lengths and
proportions, up to a bound, so likeness lies between 0 and 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import row_slices, small_batches, utf8, written

BUCKETS = 256
#: Distances of a triplet's earlier bytes from the last byte of its window.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Difference at which two texts are not alike at all: what independent codes differ by on average, as steps count 0, 1, 2 and 6.
BOUND = 416
_STEPS = np.array([0, 1, 2, 6], np.int64)
_LENGTH_BASE = 1.1
_LONGEST_STEP = 24
#: Texts and bytes counted at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20


def _count(data: np.ndarray, out: np.ndarray) -> None:
    """Add the triplets of ``data`` (four bytes before the first window's last) to the buckets ``out``."""
    last = data[4:].astype(np.uint32)
    for salt, (i, j) in enumerate(TRIPLETS, 1):
        x = last << np.uint32(16)
        x |= data[4 - i:len(data) - i].astype(np.uint32) << np.uint32(8)
        x |= data[4 - j:len(data) - j]
        x ^= np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x >>= np.uint32(24)
        out += np.bincount(x, minlength=BUCKETS)


def counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Triplets per bucket (texts x buckets) of texts that lie one after the other in ``data``."""
    out = np.zeros((len(bounds) - 1, BUCKETS), np.int64)
    for k, (s, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        for at in range(s, e, SLICE_BYTES):
            end = min(e, at + SLICE_BYTES)
            before = data[max(s, at - 4):at]
            _count(np.concatenate([np.zeros(4 - len(before), np.uint8), before, data[at:end]]), out[k])
    return out


def digests(texts: list[str]) -> list[str]:
    """The fingerprint of each whole text: two hexadecimal digits for the
    length, two for the quartiles' proportions, 128 for the codes."""
    data, bounds = utf8(pa.array(texts, pa.large_string()))
    found = counts(data, bounds)
    q = np.partition(found, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1), axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (found[:, :, None] > q[:, None, :]).sum(axis=2, dtype=np.uint8).reshape(len(texts), -1, 4)
    body = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    size = np.minimum(255, np.log1p(np.diff(bounds)) / np.log(_LENGTH_BASE)).astype(np.uint8)
    share = q[:, :2] * 15 // np.maximum(1, q[:, 2:])
    head = np.stack([size, (share[:, 0] << 4 | share[:, 1]).astype(np.uint8)], axis=1)
    return [row.tobytes().hex() for row in np.concatenate([head, body], axis=1)]


def differences(a: list[str], b: list[str]) -> np.ndarray:
    """How far the fingerprints of each pair lie apart, at most ``BOUND``."""
    x, y = (np.frombuffer(bytes.fromhex("".join(f)), np.uint8).reshape(len(f), -1).astype(np.int64) for f in (a, b))
    total = np.minimum(_LONGEST_STEP, np.abs(x[:, 0] - y[:, 0]))
    for shift in (0, 4):
        total += np.abs((x[:, 1] >> shift & 15) - (y[:, 1] >> shift & 15))
    for shift in (0, 2, 4, 6):
        total += _STEPS[np.abs((x[:, 2:] >> shift & 3) - (y[:, 2:] >> shift & 3))].sum(axis=1)
    return np.minimum(total, BOUND)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal fingerprints, 0 for those that differ by ``BOUND``."""
    return 1 - differences(a, b) / BOUND


def fingerprint(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """<doc_id, column> for each row of ``docs`` <doc_id, text>, null text as empty."""
    def run(batches):
        for part in row_slices(batches, SLICE_ROWS):
            found = digests([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", column])

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {column} string")


def like(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null where either is."""
    @F.pandas_udf("double")
    def run(x, y):
        both = x.notna() & y.notna()
        out = x.map(lambda _: None).astype("float64")
        if both.any():
            out[both] = likeness(x[both].tolist(), y[both].tolist())
        return out

    return run(a, b)


# --- documents, edited towards the next one --------------------------------------

_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_OWN = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by the beginning of ``after``."""
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def _results(ids: list, texts: list[str], prints: list[str], next_texts: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, a) for t, a in zip(texts, next_texts)]
    own = digests(changed)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array(prints), pa.array(own),
            pa.array(likeness(prints, own)), pa.array(likeness(prints, next_prints))]


def _ordered(batches):
    """Rows in order, each with the one after it. A task's first and last rows
    come with their texts as well: the last one's next row is another task's."""
    part_id = TaskContext.get().partitionId()

    def edge(kind: int, row: tuple) -> pa.RecordBatch:
        doc_id, text, own = row
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), none[0], none[1], pa.array([own]), none[2], none[3], none[4],
                                           pa.array([part_id], pa.int32()), pa.array([kind], pa.int32()), pa.array([text])], [*_NAMES, "part", "edge", "text"])

    held = None
    for part in row_slices(batches, SLICE_ROWS):
        texts = [t or "" for t in part.column("text").to_pylist()]
        rows = list(zip(part.column("doc_id").to_pylist(), texts, digests(texts)))
        if held is None:
            yield edge(0, rows[0])
        else:
            rows.insert(0, held)
        held = rows[-1]
        if len(rows) > 1:
            ids, texts, prints = zip(*rows)
            n = len(rows) - 1
            yield pa.RecordBatch.from_arrays([*_results(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]),
                                              pa.array([part_id] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], [*_NAMES, "part", "edge", "text"])
    if held is not None:
        yield edge(1, held)


def _closed(batches):
    for part in row_slices(batches, SLICE_ROWS):
        yield pa.RecordBatch.from_arrays(_results(*(part.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"))), _NAMES)


def compare_edits(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` <doc_id bigint, text>: doc_id, n_chars (code
    points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars / 3 code points, rounded down, replaced
    by the first as many (or all) of the next document, by descending doc_id;
    the first document follows the last. ``near_edited`` is the likeness of a
    text's fingerprint to its edited text's, ``near_next`` to the next
    document's. Null text counts as empty; an empty text has no triplets. Rows
    that repeat a doc_id follow each other by a hash of their text, then by
    text; those without one come last. A single row is its own next. No rows:
    no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows = written(dealt.mapInArrow(_ordered, f"{_OWN}, part int, edge int, text string"), "ordered")
    edges = rows.where("edge is not null").select("part", "edge", "doc_id", "text", "fingerprint")
    firsts = edges.where("edge = 0")
    # one row for each task that had rows
    parts = firsts.select("part").select("part", F.lead("part").over(Window.orderBy("part")).alias("after"), F.min("part").over(Window.orderBy("part")).alias("first"))
    parts = parts.select("part", F.coalesce("after", "first").alias("after"))
    after = firsts.select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    open_ = edges.where("edge = 1").join(parts, "part").join(after, "after").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return rows.where("edge is null").select(*_NAMES).unionByName(open_.mapInArrow(_closed, _OWN))
