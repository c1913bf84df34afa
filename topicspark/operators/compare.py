"""Comparing the topics of two (or more) static models.

Models are long tables <model, topic, word, prob>. Vectors stay sparse: the
cosine after full-rank PCA equals the cosine of mean-centred rows (Q8), so
centring is done algebraically over the words each topic has:
  (x-m).(y-m) = x.y - x.m - y.m + m.m,   |x-m|^2 = x.x - 2 x.m + m.m,
with m the per-word mean over all K1 + K2 topics (implicit zeros included).
No dense matrix is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions import bounded_broadcast, ordered_index
from topicspark.operators.vectors import cosines, paired_in_blocks


def common_vocab(*vocabs: DataFrame) -> DataFrame:
    """Union of vocabularies (column ``word``) with new ids by word order."""
    u = vocabs[0].select("word")
    for v in vocabs[1:]:
        u = u.union(v.select("word"))
    return ordered_index(u.distinct(), [F.col("word")], "cid")


def align_models(models: DataFrame, common: DataFrame) -> DataFrame:
    """<model, topic, cid, word, prob> over the common vocabulary; zeros stay implicit."""
    return models.join(common.select("word", "cid"), "word").select("model", "topic", "cid", "word", "prob")


def centre_topics(aligned: DataFrame, keys=()) -> DataFrame:
    """Per-word mean over all topics of the compared models: <keys..., word, m>."""
    s = aligned.groupBy(*keys, "word").agg(F.sum("prob").alias("_s"))
    if not keys:
        k = aligned.select("model", "topic").distinct().select(F.count(F.lit(1))).scalar()
        return s.select("word", (F.col("_s") / k).alias("m"))
    k = aligned.select(*keys, "model", "topic").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    j = s.join(bounded_broadcast(k), list(keys))
    return j.select(*keys, "word", (F.col("_s") / F.col("_k")).alias("m"))


def _sides(models: DataFrame) -> DataFrame:
    """<model, topic, xx, xs, k, ss>: per topic its squared length and its dot
    product with the word sums of every model (a map), per model its topic count
    and the dot products of its word sums with those of every model."""
    sums = models.groupBy("model", "word").agg(F.sum("prob").alias("s"))
    other = sums.select(F.col("model").alias("other"), "word", F.col("s").alias("t"))

    def by_other(df, keys, value, name):
        # one entry for each compared model
        d = df.groupBy(*keys, "other").agg(F.sum(value).alias("d"))
        return d.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("other", "d"))).alias(name))
    topics = models.groupBy("model", "topic").agg(F.sum(F.col("prob") * F.col("prob")).alias("xx"))
    xs = by_other(models.join(other, "word"), ["model", "topic"], F.col("prob") * F.col("t"), "xs")
    ss = by_other(sums.join(other, "word"), ["model"], F.col("s") * F.col("t"), "ss")
    k = topics.groupBy("model").agg(F.count(F.lit(1)).alias("k"))
    return topics.join(xs, ["model", "topic"]).join(k, "model").join(ss, "model")


def _similarities(models: DataFrame, condition, centred: bool = True) -> DataFrame:
    """<model_1, model_2, topic_1, topic_2, similarity> of the model pairs for
    which ``condition`` on <model_1, model_2> holds.

    The mean of a pair is (S1 + S2) / (K1 + K2) with S the models' word sums, so
    all products with it come from products with single models, made once.
    """
    m = models.select("model", "topic", "word", "prob")
    a = m.select(F.col("model").alias("model_1"), F.col("topic").alias("topic_1"), "word", F.col("prob").alias("x"))
    b = m.select(F.col("model").alias("model_2"), F.col("topic").alias("topic_2"), "word", F.col("prob").alias("y"))
    # x.y over shared words; a word has at most one row per topic
    xy = a.join(b, "word").filter(condition).groupBy("model_1", "model_2", "topic_1", "topic_2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    side = _sides(m)

    def numbered(i):
        return side.select(*[F.col(c).alias(f"{c}_{i}") for c in side.columns])
    # every pair of topics, also those that share no word (x.y = 0)
    j = paired_in_blocks(numbered(1), numbered(2), condition).join(xy, ["model_1", "model_2", "topic_1", "topic_2"], "left")
    at = lambda col, key: F.coalesce(F.element_at(col, F.col(key)), F.lit(0.0))
    k = F.col("k_1") + F.col("k_2")
    xm = (at("xs_1", "model_1") + at("xs_1", "model_2")) / k
    ym = (at("xs_2", "model_1") + at("xs_2", "model_2")) / k
    mm = (at("ss_1", "model_1") + 2 * at("ss_1", "model_2") + at("ss_2", "model_2")) / (k * k)
    if not centred:
        xm = ym = mm = F.lit(0.0)
    dot = F.coalesce(F.col("xy"), F.lit(0.0)) - xm - ym + mm
    nx, ny = F.col("xx_1") - 2 * xm + mm, F.col("xx_2") - 2 * ym + mm
    return j.select("model_1", "model_2", "topic_1", "topic_2", F.try_divide(dot, F.sqrt(nx * ny)).alias("similarity"))


def topic_similarity(models: DataFrame, m1=0, m2=1, centred: bool = True) -> DataFrame:
    """Cosine between every topic of model m1 and every topic of model m2:
    <topic_1, topic_2, similarity>."""
    both = models.filter(F.col("model").isin([m1, m2]))
    s = _similarities(both, (F.col("model_1") == m1) & (F.col("model_2") == m2), centred)
    return s.select("topic_1", "topic_2", "similarity")


def vector_similarity(x: DataFrame, y: DataFrame, x_key: str = "xid", y_key: str = "yid") -> DataFrame:
    """Cosine of caller-given long vectors <key, dim, v> (not centred)."""
    return cosines(x, y, [x_key], [y_key]).withColumnRenamed("score", "similarity")


def similarity_matrix(sim: DataFrame, names_1: DataFrame | None = None, names_2: DataFrame | None = None,
                      order: list[str] | None = None) -> DataFrame:
    """Heatmap frame: rows model-1 topic names, one column per model-2 topic name.
    Names default to topic ids; pass <topic, name> frames for label names."""
    s = sim
    s = s.join(names_1.withColumnRenamed("topic", "topic_1").withColumnRenamed("name", "name_1"), "topic_1") \
        if names_1 is not None else s.withColumn("name_1", F.col("topic_1").cast("string"))
    s = s.join(names_2.withColumnRenamed("topic", "topic_2").withColumnRenamed("name", "name_2"), "topic_2") \
        if names_2 is not None else s.withColumn("name_2", F.col("topic_2").cast("string"))
    return s.groupBy("name_1").pivot("name_2", order).agg(F.first("similarity"))


def topic_names(labels: DataFrame) -> DataFrame:
    """Heatmap axis names: best label without its 4-digit code, then the id."""
    best = labels.filter(F.col("rank") == 1)
    return best.select("topic", F.concat(F.regexp_replace("label", r"\d{4} ", ""), F.col("topic").cast("string")).alias("name"))


def similar_topics(sim: DataFrame, words_1: DataFrame, words_2: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs with similarity > threshold with what is known of both topics: the
    other columns of <topic, words, ...>, numbered by side."""
    def side(df, i):
        return df.select(*[F.col(c).alias(f"{c}_{i}") for c in df.columns])
    s = sim.filter(F.col("similarity") > threshold)
    return s.join(side(words_1, 1), "topic_1").join(side(words_2, 2), "topic_2")


def unique_topics(sim: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Topics of either model whose best similarity to the other is <= threshold
    (Q23: <= here, > for similar): <side, topic, max_sim>."""
    m1 = sim.groupBy(F.col("topic_1").alias("topic")).agg(F.max("similarity").alias("max_sim")).withColumn("side", F.lit(1))
    m2 = sim.groupBy(F.col("topic_2").alias("topic")).agg(F.max("similarity").alias("max_sim")).withColumn("side", F.lit(2))
    return m1.unionByName(m2).filter(F.col("max_sim") <= threshold).select("side", "topic", "max_sim")


def compare_all_models(models: DataFrame) -> DataFrame:
    """Centred cosine for every unordered pair of models in one job:
    <model_1, model_2, topic_1, topic_2, similarity>."""
    return _similarities(models, F.col("model_1") < F.col("model_2"))


__all__ = [
    "common_vocab", "align_models", "centre_topics", "topic_similarity", "vector_similarity",
    "similarity_matrix", "topic_names", "similar_topics", "unique_topics", "compare_all_models",
]
