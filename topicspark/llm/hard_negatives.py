"""Hard negatives of anchor vectors by Four-Russians scoring.

Vectors become integers and are kept as bit planes: plane k of a row holds, for
each group of eight dimensions, a byte with bit k of those components in two's
complement. For an anchor, the sums of every subset of a group's components are
precomputed (256 per group, by doubling). A candidate's byte is the place of its
subset's sum, so plane k of the inner product is one lookup per group, and the
whole score follows from the planes by shifting and adding. Scores are exact.

Candidates are dealt into blocks of bounded size by their id; the anchors, a
stated query set, visit every block. From each block only an anchor's first few
rows leave, and those of all blocks are ranked afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import small_batches, written

#: Positives of an anchor; negatives of a positive; their scores' bounds in percent of the positive's score.
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 3, 50, 95
#: What components are multiplied by before they are rounded down.
SCALE = 256
#: Candidates of a block on average, candidates and anchors scored at a time.
BLOCK, ROWS, ANCHORS = 4096, 1024, 128
_GROUP = 8
_NO_SCORE = np.iinfo(np.int64).min


# --- scores --------------------------------------------------------------------

def largest(dim: int) -> int:
    """Components up to this size (either sign) have scores that a long holds."""
    return math.isqrt((1 << 62) // max(1, dim))


def planes(whole: np.ndarray) -> list[bytes]:
    """The bit planes of each row of integers, the sign's first: as many planes
    as the row needs, each of a byte for every eight dimensions."""
    n, dim = whole.shape
    groups = max(1, -(-dim // _GROUP))
    wide = np.zeros((n, groups * _GROUP), np.int64)
    wide[:, :dim] = whole
    need = np.frexp((wide ^ (wide >> 63)).max(axis=1).astype(np.float64))[1] + 1  # bits of the largest component, and the sign
    out: list[bytes] = [b""] * n
    for b in np.unique(need).tolist():
        at = np.flatnonzero(need == b)
        bits = (wide[at][:, None, :] >> np.arange(b - 1, -1, -1)[None, :, None]) & 1
        packed = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")
        for i, p in zip(at.tolist(), packed):
            out[i] = p.tobytes()
    return out


def stacked(rows: list[bytes], dim: int) -> np.ndarray:
    """Planes of all ``rows`` in one array (rows x planes x groups); shorter rows repeat their sign."""
    groups = max(1, -(-dim // _GROUP))
    own = [np.frombuffer(r, np.uint8).reshape(-1, groups) for r in rows]
    most = max(map(len, own))
    out = np.empty((len(own), most, groups), np.uint8)
    for i, p in enumerate(own):
        out[i, :most - len(p)] = p[0]
        out[i, most - len(p):] = p
    return out


def unpacked(packed: np.ndarray, dim: int) -> np.ndarray:
    """The integers (rows x dim) of an array of planes."""
    bits = np.unpackbits(packed, axis=2, bitorder="little")[:, :, :dim].astype(np.int64)
    weight = 1 << np.arange(packed.shape[1] - 1, -1, -1, dtype=np.int64)
    weight[0] = -weight[0]
    return np.einsum("nbd,b->nd", bits, weight)


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """Sums of all subsets of each anchor's components by groups of eight (groups x 256 x anchors)."""
    n, dim = anchors.shape
    groups = max(1, -(-dim // _GROUP))
    wide = np.zeros((groups * _GROUP, n), dtype)
    wide[:dim] = anchors.T
    out = np.zeros((groups, 1 << _GROUP, n), dtype)
    for g in range(groups):
        for j in range(_GROUP):
            out[g, 1 << j:2 << j] = out[g, :1 << j] + wide[g * _GROUP + j]
    return out


def scores(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x candidates) of integer rows and candidates' planes."""
    n, n_planes, groups = packed.shape
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << n_planes
    tables = subset_sums(anchors, np.int32 if most < 1 << 31 else np.int64)
    out = np.empty((len(anchors), n), np.int64)
    for s in range(0, n, ROWS):
        part = packed[s:s + ROWS]
        total = np.zeros((len(part), len(anchors)), tables.dtype)
        for k in range(n_planes):
            if k == 1:
                np.negative(total, out=total)  # the first plane counts against the others
            total += total
            for g in range(groups):
                total += tables[g][part[:, k, g]]
        out[:, s:s + len(part)] = (-total if n_planes == 1 else total).T
    return out


# --- blocks --------------------------------------------------------------------

class Block:
    """The candidates of a block with vectors of one length, by vec_id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: list[bytes], dim: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.dim = ids[order], labels[order], dim
        self.planes = stacked([rows[i] for i in order.tolist()], dim)

    def positives(self, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(anchor, candidate, score): the first ``POSITIVES`` of each anchor's label, itself left out."""
        for label in np.unique(labels):
            own, those = np.flatnonzero(labels == label), np.flatnonzero(self.labels == label)
            if not len(those):
                continue
            found = scores(anchors[own], self.planes[those])
            at = np.searchsorted(self.ids[those], ids[own])
            at[at == len(those)] = 0
            mine = np.flatnonzero(self.ids[those][at] == ids[own])
            found[mine, at[mine]] = _NO_SCORE
            for i, j, s in _first(found, POSITIVES):
                yield int(ids[own[i]]), int(self.ids[those[j]]), s

    def negatives(self, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, held: list[list[dict]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor, positive, its score, candidate, score): for each positive the
        first ``NEGATIVES`` of other labels within the bounds."""
        found = scores(anchors, self.planes)
        found[labels[:, None] == self.labels[None, :]] = _NO_SCORE
        for k in range(max(map(len, held), default=0)):
            own = np.array([i for i, p in enumerate(held) if len(p) > k], np.int64)
            score = [held[i][k]["score"] for i in own.tolist()]
            lo, hi = (np.array([edge(s) for s in score], np.int64)[:, None] for edge in (lambda s: -(-LOWEST * s // 100), lambda s: HIGHEST * s // 100))
            inside = found[own]
            inside[(inside < lo) | (inside > hi)] = _NO_SCORE
            for i, j, s in _first(inside, NEGATIVES):
                p = held[own[i]][k]
                yield int(ids[own[i]]), p["id"], p["score"], int(self.ids[j]), s


def _first(found: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(row, column, score) of each row's ``n`` highest scores; of equal ones the first columns. Clears them."""
    rows = np.arange(len(found))
    for _ in range(min(n, found.shape[1])):
        best = found.argmax(axis=1)
        score = found[rows, best]
        for i in np.flatnonzero(score != _NO_SCORE).tolist():
            yield i, int(best[i]), int(score[i])
        found[rows, best] = _NO_SCORE


def _visits(names: list[str]):
    """Rows sorted by block, candidates before anchors, to an anchor's first rows of each block."""

    def run(batches):
        block, parts, own = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            at, kind = (np.asarray(batch.column(c)) for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                part = batch.slice(s, e - s)
                if at[s] != block:
                    block, parts, own = at[s], [], {}
                if kind[s] == 0:
                    parts.append(part)
                    continue
                if parts:
                    own, parts = _by_length(parts), []
                for t in range(0, part.num_rows, ANCHORS):
                    found = list(_asked(own, part.slice(t, ANCHORS), len(names) > 3))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)
    return run


def _columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    whole = pa.Table.from_batches(parts)
    return *(whole.column(c).to_numpy() for c in ("vec_id", "label", "dim")), whole.column("planes").to_pylist()


def _by_length(parts: list[pa.RecordBatch]) -> dict[int, Block]:
    ids, labels, dims, rows = _columns(parts)
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        out[dim] = Block(ids[at], labels[at], [rows[i] for i in at.tolist()], dim)
    return out


def _asked(own: dict[int, Block], anchors: pa.RecordBatch, with_positives: bool):
    ids, labels, dims, rows = _columns([anchors])
    held = anchors.column("positives").to_pylist()
    for dim in np.unique(dims).tolist():
        if dim in own:
            at = np.flatnonzero(dims == dim)
            whole = unpacked(stacked([rows[i] for i in at.tolist()], dim), dim)
            if with_positives:
                yield from own[dim].negatives(ids[at], labels[at], whole, [held[i] for i in at.tolist()])
            else:
                yield from own[dim].positives(ids[at], labels[at], whole)


# --- over tables ---------------------------------------------------------------

def _pack(batches):
    """<vec_id, label, dim, planes> of the rows that take part."""
    for b in batches:
        vec_id, label, vectors = (b.column(c) for c in ("vec_id", "label", "embedding"))
        known = np.asarray(vec_id.is_valid()) & np.asarray(label.is_valid()) & np.asarray(vectors.is_valid())
        by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in np.flatnonzero(known).tolist():
            v = vectors[i].values
            if not v.null_count:
                by_dim.setdefault(len(v), []).append((i, v.to_numpy(zero_copy_only=False)))
        rows, dims, packed = [], [], []
        for dim, own in by_dim.items():
            x = np.array([v for _, v in own], np.float64).reshape(len(own), dim)
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * x)
            fits = (np.abs(x) <= largest(dim)).all(axis=1)  # false for what is not a finite number
            rows += [i for (i, _), f in zip(own, fits) if f]
            dims += [dim] * int(fits.sum())
            packed += planes(x[fits].astype(np.int64))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([vec_id.take(at), label.take(at), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "label", "dim", "planes"])


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Candidates in blocks, and after them in each block all anchors."""
    columns = ["vec_id", "label", "dim", "planes", "positives"]
    no_positives = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), *columns[:4], no_positives)
    visits = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                            *columns[:4], *([columns[4]] if "positives" in anchors.columns else [no_positives]))
    return own.unionByName(visits).repartition(2 * blocks, "block").sortWithinPartitions("block", "kind")


def mine(vectors: DataFrame, label: Column | str = "label", every: int = 50, block: int = BLOCK) -> DataFrame:
    """<anchor_id, positive_id, rank, negative_id, positive_score, negative_score>
    of ``vectors`` <vec_id bigint, embedding, label>.

    Components become floor(256 x), a row's score is its integer inner product
    with the anchor; higher scores come first, ties by smaller vec_id. Anchors
    are the rows whose vec_id is divisible by ``every``. An anchor's positives
    are its first five other rows of its ``label``; each positive's negatives
    are the first three rows of other labels with 50 % to 95 % of its score (of
    no positive score: none but 0 for 0). Fewer where there are fewer.

    Rows without vec_id, label or vector, or with a null or non-finite
    component, take no part, nor do those with a component beyond ``largest``
    (some 500 million for 16 dimensions), whose scores a long may not hold. Of
    rows that repeat a vec_id the one of smallest label, length and planes
    counts. Vectors of unlike lengths are not compared; empty ones score 0.
    No rows: no rows. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    label = F.col(label) if isinstance(label, str) else label
    packed = vectors.select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), "embedding").mapInArrow(_pack, "vec_id bigint, label bigint, dim int, planes binary")
    rows = written(packed.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "planes")).alias("r")).select("vec_id", "r.*"), "planes")
    blocks = max(1, -(-rows.count() // block))
    anchors = rows.where(F.col("vec_id") % every == 0)

    near = _dealt(rows, anchors, blocks).mapInArrow(_visits(["anchor_id", "id", "score"]), "anchor_id bigint, id bigint, score bigint")
    order = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    near = near.withColumn("r", order).where(F.col("r") <= POSITIVES)
    near = written(near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("id", "score")).alias("positives")), "positives")

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    far = _dealt(rows, anchors.join(near, "vec_id"), blocks).mapInArrow(_visits(names), ", ".join(f"{n} bigint" for n in names))
    order = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", order).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
