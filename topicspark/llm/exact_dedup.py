"""Exact dedup by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its last 32 bytes has its
top bits clear, so equal texts are cut alike and shared passages mostly too. A
chunk's identifier is its 128-bit hash; a pass over the distinct (identifier,
bytes) rows verifies that no identifier stands for two byte strings (else all is
done again under another seed). A document's recipe is the ordered list of its
identifiers: from then on recipes are shuffled and compared, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import SPACE, at_starts, fresh, row_slices, same, small_batches, utf8, written

#: A cut falls on one position of 2**CUT_BITS on average; longer chunks are cut at MAX_CHUNK bytes.
CUT_BITS, MAX_CHUNK, WINDOW = 11, 1 << 16, 32
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space of each row becomes one space."""
    space = SPACE[data]
    after = np.empty(len(data), bool)
    after[:1], after[1:] = False, space[:-1]
    after &= ~at_starts(len(data), offsets)
    keep = ~(space & after)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return np.where(space, np.uint8(32), data)[keep], at[offsets]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of the chunks of all rows; every row bound is one."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    found = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    row = np.searchsorted(offsets, found, side="right") - 1
    # the window must lie inside the row, else the cut would depend on the row before
    found = found[found - offsets[row] >= WINDOW]
    bounds = np.unique(np.concatenate([found, offsets]))
    long = np.flatnonzero(np.diff(bounds) > MAX_CHUNK)
    if len(long):
        bounds = np.unique(np.concatenate([bounds, *(np.arange(bounds[i], bounds[i + 1], MAX_CHUNK) for i in long)]))
    return bounds


def chunked(column: pa.Array, seed: int) -> Iterator[tuple[bytes, list[bytes], list[bytes]]]:
    """Per row: its normalised bytes, its chunks and their identifiers."""
    data, offsets = normalised(*utf8(column))
    bounds = cuts(data, offsets)
    text, at = data.tobytes(), np.searchsorted(bounds, offsets)
    ends = bounds.tolist()
    for i in range(len(offsets) - 1):
        chunks = [text[ends[k]:ends[k + 1]] for k in range(at[i], at[i + 1])]
        yield text[offsets[i]:offsets[i + 1]], chunks, [xxhash.xxh3_128_digest(c, seed) for c in chunks]


def _recipes(seed: int):
    def run(batches):
        for b in row_slices(batches):
            rows = list(chunked(b.column("text"), seed))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("text_hash"),
                pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in rows], pa.string()),
                pa.array([b"".join(ids) for _, _, ids in rows], pa.binary()),
            ], ["doc_id", "text_hash", "text_sha256", "recipe"])
    return run


def _chunks(seed: int):
    def run(batches):
        for b in row_slices(batches):
            seen = {(i, c) for _, chunks, ids in chunked(b.column("text"), seed) for i, c in zip(ids, chunks)}
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in seen], pa.binary()), pa.array([c for _, c in seen], pa.binary())], ["chunk_id", "chunk"])
    return run


def recipes(docs: DataFrame) -> DataFrame:
    """<doc_id, text_hash, text_sha256, recipe> with verified chunk identifiers;
    text_hash is that of the text as it stands."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    for seed in range(16):
        store = texts.select("text").mapInArrow(_chunks(seed), "chunk_id binary, chunk binary").distinct()
        if store.groupBy("chunk_id").count().where("count > 1").limit(1).count() == 0:
            return written(texts.mapInArrow(_recipes(seed), f"doc_id {id_type}, text_hash bigint, text_sha256 string, recipe binary"), "recipes")
    raise RuntimeError("chunk identifiers collide under 16 seeds")


def _grouped(docs: DataFrame) -> DataFrame:
    r = recipes(docs)
    groups = r.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # copies of one text may be a third of all rows: only their ids and recipes move; the groups
    # are written first, so that both sides of the join are plain exchanges whose large
    # partitions adaptive execution splits
    groups = written(groups, "groups")
    out = r.join(groups.withColumn("in_group", F.lit(True)), "recipe", "left").select(
        "doc_id", F.when(F.col("in_group"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", "text_hash")
    return out.withColumn("kept", same("doc_id", "keep_id"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` <doc_id, text>: doc_id, keep_id, group_size,
    kept, text_sha256.

    Texts are equal when identical after each run of white space (space, tab to
    carriage return) became one space; null counts as empty and empty texts are
    equal. The smallest doc_id of a group is kept; rows that repeat a doc_id
    with an equal text count in group_size and share its decision. A null
    doc_id is kept only where its group has no other id. An empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    return _grouped(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each different normalised text,
    with all their columns: of rows that repeat the kept doc_id one stays."""
    row, hashed = fresh(docs, "_kept_id"), fresh(docs, "_text_hash")
    kept = _grouped(docs).where("kept").groupBy(F.col("doc_id").alias(row), "text_sha256").agg(F.min("text_hash").alias(hashed)).drop("text_sha256")
    own = F.xxhash64("text")
    out = docs.join(kept, same("doc_id", row) & (own == F.col(hashed)), "left_semi")
    return out.dropDuplicates(["doc_id", "text"])


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
