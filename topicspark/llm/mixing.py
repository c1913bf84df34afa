"""Mixing sources to target weights by fitting each source's word budget.

1. Sources get targets by weight; a target stops at ``epochs`` times its
   source's size and the excess is shared again by weight (water-filling).
2. A target is whole passes over the source plus a rest. For the rest the
   documents are counted by exact length, each length gives the same share of
   its documents, and a bounded-knapsack dynamic program over the lengths left
   fills what remains, to the word where the lengths allow it.
3. Of each length as many documents as its count are selected by a seeded hash.
   Counts per hash bucket tell which buckets are taken whole, so only the one
   bucket in which a count ends is ranked, whatever the size of the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import fresh, same, written

#: Weights of the sources in order of code point, repeating; share of all words to take; most passes over a source.
WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 42
#: Documents per hash bucket aimed at, and the most buckets of one (source, length).
BUCKET_DOCS, MAX_BUCKETS = 500, 1 << 30

_WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """<doc_id, source, size, h>: words per document (null text: 0) and a seeded hash in [0, 2^62)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
                       F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 2).alias("h"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """<source, source_size, target>, a row for each source.

    Targets are min(epochs * size, level * weight): sources in order of the
    level at which they are full, the excess of the full ones shared among the
    others by weight. The windows run over one row per source.
    """
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = every.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(epochs)).alias("cap"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, every_row = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select("*", (F.sum("source_size").over(every_row) * float(share)).alias("total"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
                 (F.sum("w").over(every_row) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"))
    # the level if this source and all after it share what the sources before it leave; the lowest of
    # these that some source does not exceed is the level of all
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("w_left"))
    first_open = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("full", "level"))).over(every_row)
    s = s.withColumn("level", F.coalesce(first_open["level"], F.lit(float("inf"))))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come
    nearest to ``budget``, at most ``counts`` of each.

    Every length first gives the same share of its documents, and some more or
    fewer until two to four times the longest length remain (or all of a small
    budget). A bounded knapsack over the documents left fills that: bit s of an
    integer tells whether s words can be made up, counts enter by doubling, and
    the parts are traced back.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if budget == total:
        return counts.copy()
    take = (counts * (budget / total)).astype(np.int64) if total else counts * 0
    rest = budget - int((lengths * take).sum())
    longest = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):  # one more of each length as long as much remains
        if rest > 4 * longest and take[i] < counts[i] and lengths[i] > 0:
            take[i] += 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):  # only where rounding left even more, or less than the knapsack can use
        size = max(1, int(lengths[i]))
        if rest > 4 * longest:
            more = min(int(counts[i] - take[i]), (rest - 4 * longest) // size + 1)
        else:
            more = -min(int(take[i]), max(0, -(-(2 * longest - rest) // size)))
        take[i] += more
        rest -= more * int(lengths[i])
    limit = rest + longest
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in np.argsort(lengths, kind="stable"):
        size, left = int(lengths[i]), int(counts[i] - take[i])
        left = min(left, limit // size) if size else 0
        part = 1
        while left > 0 and not reach >> rest & 1:
            part = min(part, left)
            wider = (reach | reach << part * size) & mask
            if wider != reach:
                steps.append((i, part, reach))
                reach = wider
            left -= part
            part *= 2
        if reach >> rest & 1:
            break
    best = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    if above:
        over = rest + 1 + (above & -above).bit_length() - 1
        best = over if over - rest < rest - best else best
    for i, part, had in reversed(steps):
        if not had >> best & 1:
            take[i] += part
            best -= part * int(lengths[i])
    return take


def _fit(hist: pd.DataFrame) -> pd.DataFrame:
    hist = hist.sort_values("size", kind="stable")
    size, n = hist["size"].to_numpy(), hist["n"].to_numpy()
    words, target = int(hist["source_size"].iloc[0]), float(hist["target"].iloc[0])
    passes = int(target // words) if words else 1
    extra = fit_lengths(size, n, round(target - passes * words)) if words else np.zeros(len(size), np.int64)
    # a document without words costs nothing: it comes once
    empty = size == 0
    return pd.DataFrame({"source": hist["source"], "size": size, "passes": np.where(empty, 1, passes), "extra": np.where(empty, 0, extra)})


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of ``docs`` <doc_id, text, source>: doc_id, size,
    source_size, target, taken, copies.

    ``copies`` (0 to ``epochs``) is how often the mix takes the document and
    ``taken`` = copies * size. The words of a source differ from its target by
    less than its shortest document unless no sum of lengths comes nearer.
    Documents without words (null, empty, blank) come once. Null sources form
    one source, the last. Reruns agree; rows that repeat a doc_id are selected
    in any order among themselves, with the same totals. No rows: no rows.
    Other columns are not read.
    """
    sized = written(sizes(docs), "sizes")
    hist = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = written(hist, "lengths")
    targets = source_targets(hist.select("source", (F.col("size") * F.col("n")).alias("size"))).withColumnRenamed("source", "_s")
    source_type = sized.schema["source"].dataType.simpleString()
    plan = hist.join(targets, same("source", "_s")).drop("_s")
    # one group per source: a row per distinct length, so at most as many as the longest document has words
    fitted = plan.groupBy("source").applyInPandas(_fit, f"source {source_type}, size long, passes long, extra long")
    plan = plan.withColumnsRenamed({"source": "_s", "size": "_z"}).join(fitted, same("_s", "source") & (F.col("_z") == F.col("size"))).drop("_s", "_z")
    buckets = F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("n") / BUCKET_DOCS)).cast("long")
    plan = written(plan.withColumn("buckets", buckets), "plan").withColumnsRenamed({"source": "_s", "size": "_z"})

    placed = (sized.join(plan, same("source", "_s") & (F.col("size") == F.col("_z"))).drop("_s", "_z")
              .withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 62)) * F.col("buckets"))))
    # counts per bucket and the one bucket of each (source, size) in which the extra documents end
    split = placed.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    per = split.groupBy("source", "size", "extra", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    ends = (per.where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("in_bucket") >= F.col("extra")))
            .select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("bucket").alias("end"), (F.col("extra") - F.col("before")).alias("from_end")))
    placed = placed.join(ends, same("source", "_s") & (F.col("size") == F.col("_z")), "left").drop("_s", "_z")
    in_end = F.col("bucket") == F.col("end")
    ranked = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))
    cut = placed.where(in_end).withColumn("r", ranked).withColumn("more", (F.col("r") <= F.col("from_end")).cast("long")).drop("r")
    rest = placed.where(~F.coalesce(in_end, F.lit(False))).withColumn(
        "more", F.when(F.col("extra") >= F.col("n"), 1).when(F.col("extra") <= 0, 0).otherwise((F.col("bucket") < F.col("end")).cast("long")).cast("long"))
    copies = F.col("passes") + F.col("more")
    return rest.unionByName(cut).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies, with all its columns."""
    row, copy = fresh(docs, "_mixed_id"), fresh(docs, "_copies")
    taken = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias(row)).agg(F.max("copies").cast("int").alias(copy))
    out = docs.join(taken, same("doc_id", row))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).drop(row, copy)
