"""Model consistency checks (the reference's runtime asserts) as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_model(doc_steps: DataFrame, step_counts: DataFrame, doc_topic: DataFrame, topic_term: DataFrame,
                vocab: DataFrame, n_docs: int, n_topics: int) -> DataFrame:
    """<check, expected, actual, ok>.

    doc_steps <doc_idx, step>, step_counts <step_idx, n_docs>, doc_topic
    <doc_idx, topic, weight>, topic_term <topic, word_id, step_idx, prob>,
    vocab <word_id, ...>. Each table is read once and comes down to one row
    (partial aggregation), from which its checks are made.
    """
    expected_docs = n_docs if not isinstance(n_docs, int) else F.lit(n_docs)
    n_steps = step_counts.select(F.count(F.lit(1))).scalar()
    v = vocab.select(F.count(F.lit(1))).scalar()
    number = F.count(F.lit(1)).alias("n")

    def rows(one: DataFrame, **checks) -> DataFrame:
        entries = [F.struct(F.lit(k).alias("check"), e.cast("long").alias("expected"), F.col(a).cast("long").alias("actual")) for k, (e, a) in checks.items()]
        return one.select(F.inline(F.array(*entries)))

    # per-step document counts agree with the step file, in step order
    per_step = doc_steps.groupBy("step").agg(number).withColumn("step_idx", (F.dense_rank().over(Window.orderBy("step")) - 1).cast("int"))
    told = step_counts.groupBy("step_idx").agg(F.collect_list("n_docs").alias("told"))
    per_step = per_step.join(told, "step_idx", "left")
    agree = F.coalesce(F.sum(F.size(F.filter("told", lambda x: x == F.col("n")))), F.lit(0)).alias("agree")
    docs = per_step.select("n", F.coalesce("told", F.array().cast(told.schema["told"].dataType)).alias("told")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), agree)
    mixtures = doc_topic.groupBy("topic").agg(number).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("topic").alias("topics"))
    terms = topic_term.groupBy("topic").agg(number).agg(F.count("topic").alias("topics"), F.count(F.when(F.col("n") == v * n_steps, 1)).alias("full"))
    out = [rows(docs, doc_steps_rows=(expected_docs, "rows"), steps_agree=(n_steps, "agree")),
           rows(step_counts.agg(F.sum("n_docs").alias("n")), step_count_total=(expected_docs, "n")),
           rows(mixtures, doc_topic_rows=(expected_docs * n_topics, "n"), topics_per_doc=(F.lit(n_topics), "topics")),
           rows(terms, topics_present=(F.lit(n_topics), "topics"), topic_term_full=(F.lit(n_topics), "full"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).withColumn("ok", F.col("expected") == F.col("actual"))
