"""Projections, filters and time steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import bounded_broadcast, ordered_index, year_month, year_of_date

SEED = 42
#: Hexadecimal digits of a key's md5 by which a sample is counted.
PREFIX = 4


def drop_null_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.na.drop(subset=[text])


def date_to_step(df: DataFrame, date_col: str, fn: Callable[[Column], Column] = year_of_date,
                 out: str = "step") -> DataFrame:
    """Overridable date -> step hook: pass any ``Column -> Column`` (year, YYYYMM, identity...)."""
    return df.withColumn(out, fn(F.col(date_col)))


def batch_years(df: DataFrame, year: str = "step", years_per_step: int = 1, out: str = "batch",
                return_mapping: bool = False):
    """batch = floor((year - min year) / years_per_step).

    The minimum is a scalar subquery: computed once (partial aggregates) and
    inlined as a literal, never a join or a single-partition window.
    """
    lo = df.select(F.min(year)).scalar()
    res = df.withColumn(out, F.floor((F.col(year) - lo) / F.lit(years_per_step)).cast("int"))
    if return_mapping:
        return res, res.select(year, out).distinct()
    return res


def present_month_mapping(df: DataFrame, date_col: str, out: str = "step") -> DataFrame:
    """Distinct present months in order; step = index // 3 (not calendar quarters)."""
    months = df.select(year_month(F.col(date_col)).alias("month")).distinct()
    # one row per distinct month: ordering them in one task is bounded by the time span
    idx = F.dense_rank().over(Window.orderBy("month")) - 1
    return months.select("month", F.floor(idx / 3).cast("int").alias(out))


def bucket_present_months(df: DataFrame, date_col: str, out: str = "step") -> DataFrame:
    mapping = present_month_mapping(df, date_col, out)
    keyed = df.withColumn("month", year_month(F.col(date_col)))
    # the mapping has one row per month of the data's span: small by construction
    return keyed.join(bounded_broadcast(mapping), "month").drop("month")


def apply_step_map(df: DataFrame, mapping: DataFrame, key: str = "step", value: str = "mapped") -> DataFrame:
    """Replace a document's step by a mapping <key, value> (one row per time unit).
    A step that the mapping lacks fails the query and is named in the error."""
    known = mapping.select(F.col(key).alias("_from"), F.col(value).alias("_to"), F.lit(True).alias("_known"))
    j = df.join(bounded_broadcast(known), F.col(key).eqNullSafe(F.col("_from")), "left")
    missing = F.raise_error(F.concat(F.lit("step without a mapping: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return j.withColumn(key, F.when(F.col("_known"), F.col("_to")).otherwise(missing.cast(mapping.schema[value].dataType))).drop("_from", "_to", "_known")


def step_range(df: DataFrame, lo=None, hi=None, step: str = "step") -> DataFrame:
    """Keep steps in [lo, hi]; a missing bound is the data's own (no filter)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(step) >= lo)
    if hi is not None:
        cond = cond & (F.col(step) <= hi)
    return df.filter(cond)


def sample_docs(df: DataFrame, limit: int | None, key: str = "doc_id", seed: int = SEED,
                shuffle: bool = True) -> DataFrame:
    """Seeded, repeatable order and, with ``limit``, its first rows (limit is the feature).

    ``doc_order`` is the sort key: the md5 of seed and id, or the id itself.
    Rows are not sorted here. With a limit, keys are counted by the first digits
    of their md5 (65,536 groups): all of the groups before the one in which the
    limit ends are in, and only that one is ranked. Without ``shuffle`` ids are
    ranked by a distributed sort. Documents are picked by a semi join, so no
    text is sorted, and no task gets all first ids.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))) if shuffle else F.col(key)
    out = df.withColumn("doc_order", order)
    if not limit:
        return out
    ids = out.select(F.col(key).alias("_id"), F.col("doc_order").alias("_o"))
    if shuffle:
        ids = ids.withColumn("_p", F.substring("_o", 1, PREFIX))
        counts = ids.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        groups = counts.withColumn("_before", before).where(F.col("_before") < limit)
        met = ids.join(F.broadcast(groups), "_p")  # at most one row for each prefix
        ends = F.col("_before") + F.col("_n") > limit
        rank = F.row_number().over(Window.partitionBy("_p").orderBy("_o", "_id"))
        last = met.where(ends).withColumn("_r", rank).where(F.col("_r") <= limit - F.col("_before"))
        first = met.where(~ends).select("_id").unionByName(last.select("_id"))
    else:
        first = ordered_index(ids, ["_o", "_id"], "_r").where(F.col("_r") < limit).select("_id")
    return out.join(first, F.col(key).eqNullSafe(F.col("_id")), "left_semi")
