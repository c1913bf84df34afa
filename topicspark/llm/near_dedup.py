"""Near-dedup by min-max hashing.

1. Each text's set of word shingles gets the minimum and the maximum under 40
   permutations: 80 values for 40 hash evaluations, cut into 20 bands of 4. A
   pair of similarity 0.8 shares no band with a probability of 3 in 100,000.
2. Equal sets become one class. Classes that share a band's key are candidates.
3. Candidates meet with their full sets: those that share buckets with the same
   first member in one block where they fit, else every bucket on its own. Groups are split into
   blocks of bounded members and shingles; within a block all intersections are
   counted, and only a spanning forest of the confirmed links leaves it.
4. What the blocks of a group leave in different components is compared across
   its blocks: the members outside the group's largest component against all.
   Members of one component need no further comparison, so a group of near
   copies, however large, costs about its size times a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import fresh, row_slices, same, small_batches, written
from topicspark.llm.components import components
from topicspark.llm.shingles import band_keys, set_key, shingle_sets, signature

PERCENT = 80
#: Most members of a block and the shingles that its members may have together, on average.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 19

_SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, keys array<bigint>"


def _sign(batches):
    for part in row_slices(batches):
        sets = list(shingle_sets(part.column("text")))
        values = [signature(x) for x in sets]
        keys = band_keys(np.stack(values)).view(np.int64)
        some = [len(x) > 0 for x in sets]
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
            pa.array([set_key(x) if ok else None for x, ok in zip(sets, some)], pa.binary()),
            pa.array([k if ok else None for k, ok in zip(keys, some)], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "keys"])


def _sets(batches):
    for part in row_slices(batches):
        yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"))], pa.binary())], ["rep", "found"])


# --- blocks --------------------------------------------------------------------

def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sizes of the intersections of a[i] with each of b)."""
    every = np.concatenate(b)
    row = np.repeat(np.arange(len(b)), [len(x) for x in b])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    for i, x in enumerate(a):
        lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, side="right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        yield i, np.bincount(row[at], minlength=len(b))


class Forest:
    """Disjoint sets of 0..n-1 that remember which unions joined two of them."""

    def __init__(self, n: int):
        self.up, self.joined = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.joined.append((i, j))


def links(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of ``a`` and of ``b`` (or
    within ``a``); members of ``b`` are numbered after those of ``a``."""
    first, b = (0, a) if b is None else (len(a), b)
    forest = Forest(first + len(b))
    sizes = np.array([len(x) for x in b])
    for i, both in shared_counts(a, b):
        ok = 100 * both >= percent * (len(a[i]) + sizes - both)
        for j in np.flatnonzero(ok):
            if first + j != i:
                forest.union(i, first + int(j))
    return forest.joined


def _block(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    rep, asks = rows["rep"].to_numpy(), rows["asks"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["found"]]
    if not asks.any():
        return [(int(rep[i]), int(rep[j])) for i, j in links(sets, None, percent)] if len(sets) > 1 else []
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(b):
        return []
    rep = np.concatenate([rep[a], rep[b]])
    return [(int(rep[i]), int(rep[j])) for i, j in links([sets[k] for k in a], [sets[k] for k in b], percent)]


def _blocks(group: list[str], percent: int):
    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            rows = batch.to_pandas()
            if rows.empty:
                continue
            new = (rows[group] != rows[group].shift()).any(axis=1).to_numpy()
            new[0] = not held or (rows[group].iloc[0] != held[-1][group].iloc[0]).any()
            starts = np.flatnonzero(new)
            pairs = []
            for k, s in enumerate(starts):
                if s > 0:
                    held.append(rows.iloc[starts[k - 1] if k else 0:s])
                if held:
                    pairs += _block(pd.concat(held), percent)
                held = []
            held.append(rows.iloc[starts[-1] if len(starts) else 0:])
            if pairs:
                yield out(pairs)
        if held and (pairs := _block(pd.concat(held), percent)):
            yield out(pairs)
    return run


def _compared(rows: DataFrame, sets: DataFrame, group: list[str], percent: int) -> DataFrame:
    """Links <a, b> within the groups of ``rows`` <*group, rep, asks>."""
    full = rows.join(sets, "rep").select(*group, "rep", "asks", "found")
    dealt = full.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)
    return written(dealt.mapInArrow(_blocks(group, percent), "a bigint, b bigint"), "links")


# --- the operator --------------------------------------------------------------

def _blocks_of(members, shingles):
    return F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _groups(classes: DataFrame) -> DataFrame:
    """<whole, id, rep, n_shingles, block, blocks>: every class in each group
    in which it meets others.

    A class's home is the smallest first member of its buckets, followed twice
    more to that one's home. Classes of one home are a group that meets as a
    whole where it fits a block. A bucket whose members have several homes, or
    one that doesn't fit, meets on its own: so all that share a bucket meet.
    """
    banded = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    hubs = written(banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "buckets")
    met = written(banded.join(hubs, "key"), "banded")
    homes = written(met.groupBy("rep", "n_shingles").agg(F.min("hub").alias("home")), "homes")
    for _ in range(2):
        far = homes.select(F.col("rep").alias("_at"), F.col("home").alias("_next"))
        homes = written(homes.join(far, F.col("home") == F.col("_at")).select("rep", "n_shingles", F.col("_next").alias("home")), "homes")
    sums = [F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")]
    fits = written(homes.groupBy("home").agg(*sums).select("home", (_blocks_of(F.col("members"), F.col("shingles")) <= 1).alias("whole")), "homes_size")
    homes = written(homes.join(fits, "home"), "homes_placed")
    placed = written(met.select("key", "rep", "n_shingles").join(homes.select("rep", "home", "whole"), "rep"), "placed")
    buckets = placed.groupBy("key").agg(F.min("home").alias("h1"), F.max("home").alias("h2"), F.min("whole").alias("whole"), *sums)
    buckets = written(buckets.where("h1 <> h2 or not whole").select("key", _blocks_of(F.col("members"), F.col("shingles")).alias("blocks")), "own_buckets")
    one = homes.where("whole").select(F.lit(True).alias("whole"), F.col("home").alias("id"), "rep", "n_shingles", F.lit(0).alias("block"), F.lit(1).alias("blocks"))
    many = placed.select("key", "rep", "n_shingles").join(buckets, "key").select(
        F.lit(False).alias("whole"), F.col("key").alias("id"), "rep", "n_shingles",
        F.pmod(F.xxhash64("rep", "key"), "blocks").cast("int").alias("block"), "blocks")
    return written(one.unionByName(many), "met")


def _across(groups: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the blocks of groups that have several."""
    several = groups.where("blocks > 1").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = written(several, "several")
    each = several.groupBy("whole", "id", "component").count()
    largest = each.groupBy("whole", "id").agg(F.max(F.struct("count", F.col("component").alias("c"))).alias("m")).select("whole", "id", F.col("m.c").alias("main"))
    tagged = written(several.join(written(largest, "largest"), ["whole", "id"]).withColumn("outside", F.col("component") != F.col("main")), "tagged")
    outside = tagged.where("outside")
    parts = outside.groupBy("whole", "id").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    parts = written(parts.select("whole", "id", _blocks_of(F.col("members"), F.col("shingles")).alias("parts")), "parts")
    tagged = tagged.join(parts, ["whole", "id"])
    every = tagged.select("whole", "id", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    asking = tagged.where("outside").select("whole", "id", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                                            F.pmod(F.xxhash64(F.lit(1), "rep"), "parts").cast("int").alias("part"), F.lit(True).alias("asks"))
    return _compared(every.unionByName(asking), sets, ["whole", "id", "block", "part"], percent).where("a <> b")


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` <doc_id bigint, text>: doc_id, n_shingles,
    component_id, kept.

    Texts link when 100 * shared shingles >= ``percent`` * all shingles of both
    (4 words each, A-Z in lower case); component_id is the smallest doc_id
    reachable. Texts with fewer words are one shingle; null, empty and blank
    texts have none and link with nothing. Links are confirmed on full sets of
    64-bit shingle hashes. Rows that repeat a doc_id with the same text share
    their result, links of any of its texts are links of that id; rows without
    doc_id link with nothing. No rows: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    signed = written(texts.mapInArrow(_sign, _SIGNED), "signed")
    good = signed.where("set_key is not null and doc_id is not null")
    classes = written(good.groupBy("set_key", "n_shingles", "keys").agg(F.min("doc_id").alias("rep")), "classes")
    groups = _groups(classes)
    # texts are dealt by doc_id at every size: the list of classes that need theirs grows with the corpus
    needed = groups.select(F.col("rep").alias("_rep")).distinct().hint("merge")
    wanted = texts.join(needed, F.col("doc_id") == F.col("_rep"), "left_semi").select(F.col("doc_id").alias("rep"), "text").dropDuplicates(["rep", "text"])
    sets = written(wanted.mapInArrow(_sets, "rep bigint, found binary"), "sets")

    inside = _compared(groups.select("whole", "id", "block", "rep", F.lit(False).alias("asks")), sets, ["whole", "id", "block"], percent)
    found = inside
    if not groups.where("blocks > 1").isEmpty():
        # one round tells most of what already belongs together
        some = written(components(inside, rounds=1), "some_components")
        found = inside.unionByName(_across(groups, some, sets, percent)).unionByName(some.select(F.col("id").alias("a"), F.col("component").alias("b")))
    comps = components(found)
    result = written(classes.select("set_key", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
                     .select("set_key", F.coalesce("component", "rep").alias("component_id")), "result")
    out = good.join(result, "set_key").select("doc_id", "n_shingles", "component_id").unionByName(
        signed.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", same("doc_id", "component_id"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    row = fresh(docs, "_kept_id")
    kept = near_groups(docs, percent).where("kept").select(F.col("doc_id").alias(row)).distinct()
    return docs.join(kept, same("doc_id", row), "left_semi")
