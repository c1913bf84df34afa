"""Topic analytics over long-form model tables.

Inputs:
  doc_topic   <doc_id, step, topic, weight>        (gamma / theta, one row per cell)
  topic_term  <topic, step, word_id, word, prob>   (dynamic model, prob not log)
  static      <topic, word_id, word, prob>         (static model)

Every top-k uses ``row_number() <= n`` over a partitioned window, which Spark
turns into a partial per-partition limit before the shuffle (WindowGroupLimit),
so only n rows per key and map task cross the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import bounded_broadcast, ln_or_neg_inf, strip_label_code


def doc_topic_mixtures(doc_topic: DataFrame, step: str = "step") -> DataFrame:
    """<doc_id, step, mixture array<struct<topic, weight>>> sorted by topic."""
    return doc_topic.groupBy("doc_id", step).agg(
        F.array_sort(F.collect_list(F.struct("topic", "weight"))).alias("mixture"))


def step_topic_share(doc_topic: DataFrame, step: str = "step", logged: bool = False) -> DataFrame:
    """Share of each topic in a step: sum of weights / step total (optionally ln)."""
    g = doc_topic.groupBy(step, "topic").agg(F.sum("weight").alias("_w"))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy(step))
    out = g.select(step, "topic", share.alias("share"))
    if logged:
        out = out.select(step, "topic", ln_or_neg_inf("share").alias("log_share"))
    return out


def topic_terms(topic_term: DataFrame, topic: int | None = None) -> DataFrame:
    """Word distribution of a topic (or all) at each step."""
    return topic_term if topic is None else topic_term.filter(F.col("topic") == topic)


def _rank(df: DataFrame, keys, score: str, n: int, tie: str = "word_id") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _rescale(df: DataFrame, keys, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col) / F.sum(col).over(Window.partitionBy(*keys)))


def top_words(topic_term: DataFrame, share: DataFrame | None = None, n: int = 10,
              weighted: bool = True, rescaled: bool = True, step: str = "step", keys=("topic",)) -> DataFrame:
    """Top n words per topic (``keys``: of several models, <model, topic>) over all steps.

    weighted: score = sum over steps of share(topic, step) * prob(word | topic, step)
    else:     score = sum over steps of prob.  Ties: word_id desc (Q13).
    Returns <keys..., rank, word_id, word, prob> (prob rescaled to sum 1 over the n).
    """
    if weighted:
        if share is None:
            raise ValueError("weighted top words need the step shares")
        j = topic_term.join(bounded_broadcast(share.select(step, *keys, "share")), [step, *keys])
        contrib = F.col("share") * F.col("prob")
    else:
        j = topic_term
        contrib = F.col("prob")
    acc = j.groupBy(*keys, "word_id", "word").agg(F.sum(contrib).alias("prob"))
    top = _rank(acc, keys, "prob", n)
    if rescaled:
        top = _rescale(top, keys, "prob")
    return top.select(*keys, "rank", "word_id", "word", "prob")


def top_words_over_time(topic_term: DataFrame, n: int = 10, rescaled: bool = True,
                        step: str = "step") -> DataFrame:
    """Top n words per (topic, step); probs kept when not rescaled (Q17)."""
    top = _rank(topic_term, ["topic", step], "prob", n)
    if rescaled:
        top = _rescale(top, ["topic", step], "prob")
    return top.select("topic", step, "rank", "word_id", "word", "prob")


def top_words_frame(topic_term: DataFrame, n: int = 10, topic: int | None = None,
                    step: str = "step", keys=("topic",)) -> DataFrame:
    """One row per (topic, step) with the ordered top-word array."""
    src = topic_terms(topic_term, topic)
    top = _rank(src, [*keys, step], "prob", n)
    return top.groupBy(*keys, step).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("top_words"))


def print_topic(frame: DataFrame, topic: int, step: str = "step") -> DataFrame:
    """Year-by-year top words of one topic, in year order."""
    return frame.filter(F.col("topic") == topic).orderBy(step)


def top_words_static(static: DataFrame, n: int = 10, with_prob: bool = True, keys=("topic",)) -> DataFrame:
    """Top n words of each static topic by prob (ties word_id desc)."""
    top = _rank(static, list(keys), "prob", n)
    cols = [*keys, "rank", "word_id", "word"] + (["prob"] if with_prob else [])
    return top.select(*cols)


def top_label(labels: DataFrame) -> DataFrame:
    """Best label per topic from a ranked label frame <topic, rank, label, ...>."""
    return labels.filter(F.col("rank") == 1).select("topic", F.col("label").alias("top_label"))


def topic_share_long(share: DataFrame, labels: DataFrame | None = None, step: str = "step") -> DataFrame:
    """<step, topic, share, topic_name>: name = id, or label without code + "(id)"."""
    if labels is None:
        return share.select(step, "topic", "share", F.col("topic").cast("string").alias("topic_name"))
    j = share.join(bounded_broadcast(top_label(labels)), "topic", "left")
    name = F.concat(strip_label_code("top_label"), F.lit("("), F.col("topic").cast("string"), F.lit(")"))
    return j.select(step, "topic", "share", name.alias("topic_name"))


def merge_topics_by_label(share: DataFrame, labels: DataFrame, step: str = "step") -> DataFrame:
    """Sum the share of topics with the same top-1 label per step."""
    j = share.join(bounded_broadcast(top_label(labels)), "topic")
    return j.groupBy(step, strip_label_code("top_label").alias("topic_name")).agg(F.sum("share").alias("share"))


def drop_small_topics(share_long: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Keep topics whose mean share over steps exceeds threshold."""
    keep = share_long.groupBy("topic").agg(F.avg("share").alias("_m")).filter(F.col("_m") > threshold)
    return share_long.join(keep.select("topic"), "topic", "left_semi")


def year_limit(df: DataFrame, limit: int | None, step: str = "step") -> DataFrame:
    return df if limit is None else df.filter(F.col(step) <= limit)


def topic_share_matrix(share_long: DataFrame, names: list[str] | None = None, limit: int | None = None,
                       step: str = "step") -> DataFrame:
    """Pivot to step x topic_name. Pass ``names`` to skip the distinct-values job."""
    src = year_limit(share_long, limit, step)
    return src.groupBy(step).pivot("topic_name", names).agg(F.first("share"))


def topic_series_pct(share_long: DataFrame, step: str = "step") -> DataFrame:
    """Each topic's share per step as a percentage of its own total."""
    pct = 100 * F.col("share") / F.sum("share").over(Window.partitionBy("topic_name"))
    return share_long.select(step, "topic", "topic_name", pct.alias("pct"))


def topic_share_pct(share_long: DataFrame, keep: list | None = None, step: str = "step") -> DataFrame:
    """Rescale each step over all topics to 100, then keep the chosen ones."""
    pct = 100 * F.col("share") / F.sum("share").over(Window.partitionBy(step))
    out = share_long.select(step, "topic_name", pct.alias("pct"))
    return out if keep is None else out.filter(F.col("topic_name").isin([str(k) for k in keep]))


def order_topics(share_long: DataFrame, sort_by="peak_pos", step: str = "step") -> DataFrame:
    """Topic order: by first step of peak share then name (Q26), numeric/alpha
    name, or a caller's ``Column -> Column`` key.

    Returns <topic_name, peak_step, ord>.
    """
    peak = share_long.groupBy("topic_name").agg(
        F.max_by(F.col(step), F.struct(F.col("share"), -F.col(step))).alias("peak_step"))
    if callable(sort_by):
        # caller's order: a Column -> Column key over the topic name
        order = [sort_by(F.col("topic_name")), F.col("topic_name")]
    elif sort_by == "peak_pos":
        order = [F.col("peak_step"), F.col("topic_name")]
    else:
        order = [F.col("topic_name").try_cast("int").asc_nulls_last(), F.col("topic_name")]
    # one row per topic: ordering the topic list in one task is fine
    return peak.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)


def check_words(topic_term: DataFrame, words: list[str]) -> None:
    """Raise if a requested word is not in the vocabulary (reference exits)."""
    spark = topic_term.sparkSession
    req = spark.createDataFrame([(w,) for w in words], "word string")
    missing = req.join(topic_term.select("word").distinct(), "word", "left_anti").limit(len(words)).collect()
    if missing:
        raise ValueError(f"words not in vocabulary: {[r.word for r in missing]}")


def words_over_time(topic_term: DataFrame, words: list[str], topic: int | None = None,
                    step: str = "step", check: bool = False) -> DataFrame:
    """Prob of chosen words per (topic, step), one column per word."""
    if check:
        check_words(topic_term, words)
    src = topic_terms(topic_term, topic).filter(F.col("word").isin(words))
    return src.groupBy("topic", step).pivot("word", words).agg(F.first("prob"))


def words_with_share(words_frame: DataFrame, share: DataFrame, step: str = "step") -> DataFrame:
    """words_over_time plus ``_prop``: the topic's share in percent of its own total over the steps."""
    series = topic_series_pct(topic_share_long(share, step=step), step)
    return words_frame.join(series.select(step, "topic", F.col("pct").alias("_prop")), [step, "topic"], "left")
