"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o is rotated by a random orthogonal matrix and its signs are kept:
they name the corner x of the cube {+-1/sqrt(D)}^D next to it. With the stored
correction factor f = <x, o>, <x, q> / f estimates <o, q> for any unit q without
bias. A linked q is at most acos(threshold) from o, and o is acos(f) from x, so
<x, q> is at least the cosine of the sum: a bound that no link falls below.

All vectors of a label are compared, at every size: whether two of them link
depends on these two only. A label is split into blocks, and a task takes two
blocks at a time, in tiles; blocks grow with the label, up to a bound, so that
its codes are copied to few of them. The work is the square of a label's size.

First only codes go to the blocks: a rotated vector in four bits a dimension,
its sign foremost, and its correction factor. The signs' bound, then that of all
four bits (both with all that four bits leave open) name the rows that have a
pair to compute. Then the vectors of these rows follow, in double precision;
counts and a spanning star leave the second step. So neither step writes pairs,
and vectors move only where a link is likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import small_batches, written
from topicspark.llm.components import components

#: Cosine of a link; share of the pairs at that very cosine to find (closer ones: more) by bands; eps of the confidence bound.
THRESHOLD, RECALL, EPS, SEED = 0.93, 0.995, 4.0, 7
#: Unlike vectors per bucket aimed at; vectors per block.
BUCKET, BLOCK = 32, 1024
#: A label has up to so many blocks before they grow; then up to so many times ``BLOCK`` vectors and so many bytes.
BLOCKS, GROWN, BLOCK_BYTES = 4, 64, 32 << 20
#: Rows of a tile of codes, of vectors.
TILE, FULL_TILE = 2048, 1024
_SLACK = 1e-6


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bands_for(largest: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band's key, bands) for a label of ``largest`` vectors. Says what bands
    would take; ``link_vectors`` has none, as they lose links."""
    bits = min(31, max(8, math.ceil(math.log2(max(1, largest) / BUCKET))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def plan_for(n: int, block: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, bands) for a label of ``n`` vectors; (0, 1) where its blocks take no more
    copies of a code than its bands would. Not asked by ``link_vectors``: no result
    may follow from it."""
    bits, bands = bands_for(n, threshold, recall)
    return (0, 1) if n <= block * bands else (bits, bands)


def units(vectors: list[bytes], kind: str = "<f8") -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), kind).astype("<f8").reshape(len(vectors), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated rows and their correction factors."""
    turned = unit @ rotation(unit.shape[1], SEED).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def quarters(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotated rows in four bits a dimension (sign, then one of eight steps of
    the size), packed, and the steps' widths."""
    turned = unit @ rotation(unit.shape[1], SEED).T
    width = np.abs(turned).max(axis=1).astype("<f4") / np.float32(8)
    steps = np.minimum(7, np.abs(turned) / width[:, None]).astype(np.uint8) | ((turned > 0) << 3).astype(np.uint8)
    steps = np.pad(steps, ((0, 0), (0, steps.shape[1] % 2)))
    return steps[:, ::2] << 4 | steps[:, 1::2], width


def rough(packed: np.ndarray, width: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners and rotated vectors that ``quarters`` stands for, in single precision."""
    steps = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    sign = np.where(steps & 8, np.float32(1), np.float32(-1))
    return sign / np.float32(math.sqrt(dim)), sign * ((steps & 7) + np.float32(0.5)) * width[:, None]


def upper_bounds(code: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of <o, q> for the coded vectors o (rows) and the unit vectors q (columns)."""
    dim = unit.shape[1]
    corner = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    estimate = (corner @ (unit @ rotation(dim, SEED).T).T.astype(np.float32)) / factor[:, None].astype(np.float32)
    margin = EPS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return estimate + margin[:, None].astype(np.float32) + np.float32(_SLACK)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: cosine of the unit vectors in double precision at least ``threshold``."""
    cosine = a @ b.T
    i, j = np.nonzero(np.abs(cosine - threshold) < 1e-12)  # where a product's rounding, which its shape sways, would decide
    cosine[i, j] = np.einsum("ij,ij->i", a[i], b[j])
    return cosine >= threshold


def _joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of ``i`` and ``j`` in ``up``, the root of each row."""
    while len(i):
        a, b = up[i], up[j]
        new = a != b
        i, j, a, b = i[new], j[new], a[new], b[new]
        up[np.maximum(a, b)] = np.minimum(a, b)
        while (up[up] != up).any():
            up[:] = up[up]


_GROUP = ["label", "size", "b1", "b2"]


def _groups(batches) -> Iterator[pa.Table]:
    """The groups of contiguous rows, each whole."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        ends = np.zeros(rows.num_rows, bool)
        for c in _GROUP:
            x = rows.column(c)
            ends[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy()
            ends[0] |= bool(held) and held[-1].column(c)[-1] != x[0]
        at = [0, *np.flatnonzero(ends).tolist(), rows.num_rows]
        for s, e in zip(at[:-1], at[1:]):
            if ends[s] and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            if e > s:
                held.append(rows.slice(s, e - s))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _tiles(rows: pa.Table, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of two tiles of a group, a tile of one block and one of the
    other; of a block with itself each pair of tiles once."""
    first, second = rows.column("b1")[0].as_py(), rows.column("b2")[0].as_py()
    block = rows.column("block").to_numpy()
    i, j = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for s in range(0, len(i), size):
        for t in range(s if first == second else 0, len(j), size):
            yield i[s:s + size], j[t:t + size]


def _blocks(threshold: float, kind: str):
    """(rep, links, rep of a linked vector) of the groups: a block, or two blocks of one label."""
    def run(batches):
        for rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            vec, copies, rep = rows.column("vec"), rows.column("copies").to_numpy(), rows.column("rep").to_numpy()
            links, up, at = np.zeros(len(rep), np.int64), np.arange(len(rep)), None
            for i, j in _tiles(rows, FULL_TILE):
                if at is None or at[0] != i[0]:
                    at = i
                    a = units(vec.take(pa.array(i)).to_pylist(), kind)
                b = a if i[0] == j[0] else units(vec.take(pa.array(j)).to_pylist(), kind)
                link = linked(a, b, threshold)
                if i[0] == j[0]:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                links[i] += link @ copies[j]
                if i[0] != j[0]:
                    links[j] += copies[i] @ link
                x, y = np.nonzero(link)
                _joined(up, i[x], j[y])
            got = np.flatnonzero(links)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(rep[got]), pa.array(links[got]), pa.array(rep[up[got]])], ["rep", "links", "root"])
    return run


def _likely(group: dict, threshold: float) -> np.ndarray:
    """Places of the rows of a group that have a pair to compute: one whose bounds by
    the signs and by all four bits reach the threshold. No link falls below these."""
    first, second = group["b1"][0], group["b2"][0]
    i, j = np.flatnonzero(group["block"] == first), np.flatnonzero(group["block"] == second)
    if not len(i) or not len(j):
        return i[:0]
    corner, turned, width, factor = group["corner"], group["turned"], group["width"], group["factor"]
    dim = corner.shape[1]
    slack = _SLACK + dim * 2.0**-22  # of sums in single precision

    def beside(rows, *columns):
        return np.column_stack([rows, *columns]).astype(np.float32)
    # <code, vector> >= cos(angle of the code's own vector + angle of a link); four bits miss a vector by half a step a dimension
    own = np.arccos(np.clip(factor - 1e-6, 0, 1))  # never too small by the factor's rounding
    least = np.cos(np.minimum(math.pi, own + math.acos(min(1, max(-1, threshold)))))
    half, one = width / 2, np.ones(len(width))
    may = beside(corner[i], one[i], -least[i]) @ beside(turned[j], half[j] * math.sqrt(dim), one[j]).T >= -slack
    if first == second:
        may &= ~np.tri(len(i), dtype=bool)
    # <q, r> misses by half a step of r times the sum of q's sizes, and by half a step of q times that of the sizes r stands for
    a = beside(turned[i], np.abs(turned[i]).sum(axis=1), half[i])
    b = beside(turned[j], half[j], factor[j] * math.sqrt(dim))
    if may.any():
        may &= a @ b.T >= threshold - slack
    return np.union1d(i[may.any(axis=1)], j[may.any(axis=0)])


def _survivors(threshold: float):
    """Rows <label, size, b1, b2, block, rep> with a pair to compute, each once a group."""
    keep = [*_GROUP, "block", "rep"]

    def run(batches):
        for rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            factor, width, dim = (rows.column(c).to_numpy() for c in ("factor", "width", "dim"))
            packed = np.frombuffer(b"".join(rows.column("quarters").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            alive = np.zeros(rows.num_rows, bool)
            for i, j in _tiles(rows, TILE):
                one = i[0] == j[0]
                at = i if one else np.concatenate([i, j])
                side = np.repeat([0, 1], [len(i), len(at) - len(i)])
                group = {"b1": np.zeros(len(at), int), "b2": np.full(len(at), 0 if one else 1), "block": side, "factor": factor[at], "width": width[at]}
                group["corner"], group["turned"] = rough(packed[at], width[at], int(dim[0]))
                alive[at[_likely(group, threshold)]] = True
            at = np.flatnonzero(alive)
            if len(at):
                # several vectors of one vec_id come as one row: it brings all of them
                at = at[np.unique(rows.column("rep").to_numpy()[at], return_index=True)[1]]
                yield from rows.select(keep).take(pa.array(at)).combine_chunks().to_batches()
    return run


def _encode(kind: str):
    """Codes of the vectors: <label, size, rep, blocks, dim, factor, quarters, width>."""
    own = ["label", "size", "rep", "blocks"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vecs, sizes = b.column("vec").to_pylist(), np.asarray(b.column("size"))
            n = len(vecs)
            packed, factor, width, dims = [None] * n, np.zeros(n, "<f4"), np.zeros(n, "<f4"), np.zeros(n, np.int32)
            for size in {*sizes.tolist()}:
                at = np.flatnonzero(sizes == size)
                u = units([vecs[i] for i in at], kind)
                factor[at] = codes(u)[1]
                q, width[at] = quarters(u)
                dims[at] = u.shape[1]
                for m, i in enumerate(at):
                    packed[i] = q[m].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in own], pa.array(dims), pa.array(factor), pa.array(packed, pa.binary()), pa.array(width)],
                [*own, "dim", "factor", "quarters", "width"])
    return run


def _blocks_of(n, size):
    """Blocks of a label of ``n`` vectors of ``size`` bytes: ``BLOCK`` vectors each, larger ones from ``BLOCKS`` on."""
    most = F.greatest(F.lit(BLOCK), F.least(F.lit(GROWN * BLOCK), F.floor(F.lit(BLOCK_BYTES) / size).cast("int")))
    return F.least(F.ceil(n / F.lit(BLOCK)), F.greatest(F.lit(BLOCKS), F.ceil(n / most))).cast("int")


def _bytes(kind: str):
    """Vectors as bytes of numbers of ``kind``; null for those that link with nothing."""
    def run(batches):
        for b in batches:
            out = []
            for v, label in zip(b.column("embedding"), b.column("label").is_valid().to_pylist()):
                x = None
                if label and v.is_valid and len(v.values) and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), kind)
                    x = None if not np.isfinite(x).all() or not x.any() else x.tobytes()
                out.append(x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])
    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` <vec_id bigint, embedding, label>: vec_id,
    n_links, component_id, kept.

    Vectors link when labels are equal and not null, lengths are equal and the
    cosine in double precision is at least ``threshold``. Null, empty and zero
    vectors and those with null or non-finite components link with nothing, as
    do rows without vec_id. Equal vectors are one representative with a number
    of copies, which link with each other (for a threshold of at most 1); rows
    that repeat a vec_id count as copies; with other vectors or labels under one
    vec_id all its rows share one component, and links of any of them count for
    each. All pairs of a label at the threshold are linked and none below it,
    whatever the label's size; a label's links don't depend on other labels. No
    rows: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label_type = vectors.schema["label"].dataType.simpleString()
    # single precision is kept as it is; products are made in double precision
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(_bytes(kind), f"vec_id bigint, label {label_type}, vec binary")
    # ``vectors`` is read twice: a row's vector moves once, to its class; its class number comes back by a digest
    digest = F.unhex(F.sha2("vec", 256))
    members = written(rows.select("vec_id", "label", digest.alias("digest")), "members")
    classes = rows.where("vec is not null and vec_id is not null").groupBy("label", "vec").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("size", F.octet_length("vec")).withColumn("digest", digest), "classes")
    # a label's size says into how many blocks it is split, not which pairs are compared
    sizes = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", _blocks_of(F.col("n"), F.col("size")))
    coded = written(classes.drop("digest", "copies").join(sizes.drop("n"), ["label", "size"]).mapInArrow(
        _encode(kind), f"label {label_type}, size int, rep bigint, blocks int, dim int, factor float, quarters binary, width float"), "codes")

    own = ["label", "size", "rep"]
    placed = (coded.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select(*own, "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "dim", "factor", "quarters", "width"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*[F.col(c) for c in _GROUP]).sortWithinPartitions(*_GROUP)
    likely = written(dealt(placed).mapInArrow(_survivors(threshold), f"label {label_type}, size int, b1 int, b2 int, block int, rep bigint"), "likely")
    full = likely.join(classes.select(*own, "copies", "vec"), own)
    found = written(dealt(full).mapInArrow(_blocks(threshold, kind), "rep bigint, links bigint, root bigint"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    result = classes.select("label", "digest", "rep", "copies").join(links, "rep", "left").join(parts, "rep", "left").select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = members.where("digest is not null and vec_id is not null").join(result, ["label", "digest"]).select("vec_id", "n_links", "component_id").unionByName(
        members.where("digest is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a
), c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.id LEFT JOIN n ON n.a = e.vec_id
"""
