"""Pairs of model-sized tables and cosines of their vectors.

Topics x labels and topics x topics are what some results consist of. Both sides
are dealt into blocks, as many as their rows need for blocks of bounded size; a
block pair is the join key, and each pair of rows is made in one task of many:
no cross join, nothing brought to the driver, and filters on the pair apply
where it is made. Vectors are arrays of fixed length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block on average. A row is copied once for each block of the other side.
BLOCK_ROWS = 256


def paired_in_blocks(a: DataFrame, b: DataFrame, condition: Column | None = None, on: list[str] | None = None,
                     block_rows: int | None = None) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` (within equal ``on`` columns
    where given), where ``condition`` holds. Column names must differ but for ``on``.

    The blocks of a side follow from its rows, which are counted in the plan.
    """
    on = on or []
    own_a = [c for c in a.columns if c not in on]
    own_b = [c for c in b.columns if c not in on]
    rows = block_rows or BLOCK_ROWS
    n_a, n_b = (F.greatest(F.lit(1), F.ceil(x.select(F.count(F.lit(1))).scalar() / rows)).cast("int") for x in (a, b))

    def dealt(x, own, place, n, other, m):
        return x.withColumn(place, F.pmod(F.xxhash64(*own[:2]), n).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), m - 1)))
    left, right = dealt(a, own_a, "_i", n_a, "_j", n_b), dealt(b, own_b, "_j", n_b, "_i", n_a)
    out = left.join(right, [*on, "_i", "_j"]).drop("_i", "_j")
    return out if condition is None else out.filter(condition)


def vector_arrays(long: DataFrame, keys: list[str]) -> DataFrame:
    """<keys..., vec array<double>> of a long frame <keys..., dim, v>; missing dimensions are 0."""
    e = F.array_sort(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), F.col("v").cast("double").alias("v"))))
    m = long.groupBy(*keys).agg(e.alias("_e")).withColumn("_last", F.element_at("_e", -1)["dim"])
    dense = F.transform("_e", lambda x: x["v"])
    by_dim = F.map_from_entries("_e")
    filled = F.transform(F.sequence(F.lit(0), "_last"), lambda d: F.coalesce(F.element_at(by_dim, d), F.lit(0.0)))
    return m.select(*keys, F.when(F.size("_e") == F.col("_last") + 1, dense).otherwise(filled).alias("vec"))


def dot(u, v) -> Column:
    """Dot product of two array columns; what one lacks at the end counts as 0."""
    return F.aggregate(F.zip_with(u, v, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x)


def unit_vectors(long: DataFrame, keys: list[str]) -> DataFrame:
    """<keys..., u> scaled to length 1; null for a zero vector."""
    v = vector_arrays(long, keys).withColumn("_n", F.sqrt(dot("vec", "vec")))
    return v.select(*keys, F.when(F.col("_n") > 0, F.transform("vec", lambda x: x / F.col("_n"))).alias("u"))


#: Dimensions from which a pair's cosine is bounded first.
HEAD = 16


def with_head(units: DataFrame) -> DataFrame:
    """``units`` <..., u> with its first ``HEAD`` dimensions and the length of the rest: <..., head, rest>."""
    head = units.withColumn("head", F.slice("u", 1, HEAD))
    return head.withColumn("rest", F.sqrt(F.greatest(F.lit(0.0), 1.0 - dot("head", "head"))))


def cosine_bound(head1, rest1, head2, rest2) -> Column:
    """What the cosine of two unit vectors can't exceed: their heads' product and,
    by Cauchy and Schwarz, the product of the rests' lengths (with room for rounding)."""
    return dot(head1, head2) + F.col(rest1) * F.col(rest2) + 1e-9


def cosines(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str]) -> DataFrame:
    """Cosine of every vector of ``a`` and every vector of ``b`` (long frames): <a_keys..., b_keys..., score>."""
    x = unit_vectors(a, a_keys).withColumnRenamed("u", "_u1")
    y = unit_vectors(b, b_keys).withColumnRenamed("u", "_u2")
    return paired_in_blocks(x, y).select(*a_keys, *b_keys, dot("_u1", "_u2").alias("score"))
