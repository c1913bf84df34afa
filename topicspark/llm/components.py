"""Connected components of an edge table by alternating stars.

Large star: every node hands its larger neighbours to its smallest one; small
star: every node hands its smaller neighbours and itself to the smallest. Both
are a grouped minimum and a join, rounds grow with the logarithm of the longest
path, and a node with very many edges is a skewed join key, which adaptive
execution splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import written


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """edges <u, v> with u > v -> edges <u, v> of the next half round."""
    pairs = edges
    if both_ways:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # the key is computed anew, so that the join has plain exchanges on both sides and a node
    # with very many edges can be split
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("w"), F.least("u", "m").alias("m"))
    j = pairs.join(least, F.col("u") == F.col("w"))
    if both_ways:
        return j.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = j.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """<id, component> of every node that has an edge in ``edges`` <a, b>;
    component is the smallest id reachable. Self loops and nulls are left out,
    directions and repeats don't matter. Runs until no edge changes, or for
    ``rounds``: nodes of one component may then still have several values, but
    an equal value means the same component."""
    e = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct()
    e, seen, done = written(e, "edges"), None, 0
    while rounds is None or done < rounds:
        if rounds is None:
            now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == seen or not now[0]:
                break
            seen = now
        e = written(_stars(_stars(e, True), False), "stars")
        done += 1
    roots = e.select(F.col("v").alias("id")).distinct()
    # before the last round a node may have several smaller neighbours
    own = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return own.unionByName(roots.join(own.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
