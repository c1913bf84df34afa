"""Vocabulary and bag of words.

Token rows are <doc_id, pos, w> (``tokens_long``). Word counts use partial
(map-side) aggregation; the vocabulary is small after ``min_freq`` and gets
dense ids from a distributed ordered index, never a one-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from topicspark.functions import measured_broadcast, ordered_index


def split_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Token arrays as given, or a string split on single spaces (empties dropped, Q27)."""
    if dict(df.dtypes)[text].startswith("array"):
        return df.withColumn(out, F.filter(F.col(text), lambda x: x != ""))
    return df.withColumn(out, F.filter(F.split(F.col(text), " "), lambda x: x != ""))


def tokens_long(df: DataFrame, tokens: str = "tokens", key: str = "doc_id", keep=()) -> DataFrame:
    # an outer explode, as the other one has its array computed once more to filter on its size
    return df.select(key, *keep, F.posexplode_outer(tokens).alias("pos", "w")).where("pos is not null")


def word_counts(tok: DataFrame) -> DataFrame:
    """<w, cnt> corpus frequency."""
    return tok.groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))


def vocab(tok: DataFrame, min_freq: int = 150, order: str = "doc_order") -> DataFrame:
    """Words with count > min_freq (strict, Q7), ids by first appearance.

    First appearance = min (doc order, position). Returns <word_id, word, cnt>.
    """
    if isinstance(tok.schema[order].dataType, IntegralType):
        # order and position in one number: combined in the scan's tasks, so one row per word and task is exchanged
        place = F.col(order).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")
        kept = tok.groupBy("w").agg(F.count(F.lit(1)).alias("cnt"), F.min(place).alias("_p")).filter(F.col("cnt") > min_freq)
        return ordered_index(kept, ["_p"], name="word_id").select("word_id", F.col("w").alias("word"), "cnt")
    # two hash aggregates (numeric buffers, partial aggregation on the map
    # side) instead of one sort-based min over a struct
    per_doc = tok.groupBy("w", order).agg(F.count(F.lit(1)).alias("_c"), F.min("pos").alias("_p"))
    first = per_doc.groupBy("w").agg(F.sum("_c").alias("cnt"), F.min(order).alias("_d"),
                                     F.min_by("_p", F.col(order)).alias("_p"))
    kept = first.filter(F.col("cnt") > min_freq)
    ids = ordered_index(kept, [F.col("_d"), F.col("_p")], name="word_id")
    return ids.select("word_id", F.col("w").alias("word"), "cnt")


def doc_term_counts(tok: DataFrame, voc: DataFrame, key: str = "doc_id", keep=()) -> DataFrame:
    """<doc, word_id, cnt, first_pos> within the vocabulary.

    A vocabulary of bounded size is broadcast to the tokens, so that words outside
    it and all words' text stay in the scan's tasks and (doc, word_id) is what is
    counted. A larger one meets the counts per (doc, word) in a join, as does one
    in which ids repeat. The vocabulary is read first, to measure it.
    """
    v = voc.select(F.col("word").alias("w"), "word_id")
    small = measured_broadcast(v)
    if small is not v and v.groupBy("word_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        g = tok.join(small, "w").groupBy(key, *keep, "word_id").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
        return g.select(key, *keep, "cnt", "first_pos", "word_id")
    g = tok.groupBy(key, *keep, "w").agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos"))
    return g.join(v, "w").drop("w")


def filter_docs(dtc: DataFrame, min_tokens: int = 15, min_unique: int = 5, key: str = "doc_id") -> DataFrame:
    """Keep docs with tokens > min_tokens and distinct tokens > min_unique (both strict)."""
    # window per document instead of aggregate + semi join: no second pass
    # over the counts and no exchange when dtc is partitioned by document
    w = Window.partitionBy(key)
    out = dtc.withColumn("_n", F.sum("cnt").over(w)).withColumn("_u", F.count(F.lit(1)).over(w))
    return out.filter((F.col("_n") > min_tokens) & (F.col("_u") > min_unique)).drop("_n", "_u")


def bow_rows(dtc: DataFrame, key: str = "doc_id", keep=()) -> DataFrame:
    """``ntypes id:count ...``: counts desc, ties by first appearance in the doc."""
    g = dtc.groupBy(key, *keep).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("cnt")).alias("k1"), F.col("first_pos").alias("k2"), "word_id", "cnt"))).alias("_e"))
    body = F.array_join(F.transform("_e", lambda e: F.concat(e["word_id"].cast("string"), F.lit(":"),
                                                             e["cnt"].cast("string"))), " ")
    return g.select(key, *keep, F.size("_e").alias("ntypes"),
                    F.concat(F.size("_e").cast("string"), F.lit(" "), body).alias("bow"))


def order_docs(df: DataFrame, step: str = "step", order: str = "doc_order") -> DataFrame:
    """Documents ordered by step, stable inside a step (range-partitioned sort)."""
    return df.orderBy(step, order)


def step_counts(df: DataFrame, step: str = "step") -> DataFrame:
    """Documents per non-empty step (Q9)."""
    return df.groupBy(step).agg(F.count(F.lit(1)).alias("n_docs"))
