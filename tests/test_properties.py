"""Property checks."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicspark.operators import compare as C
from topicspark.operators import thesaurus as H
from topicspark.operators import topics as T
from topicspark.plans.catalog import Ctx


def test_shares_sum_to_one(spark):
    c = Ctx(spark, SF_SMALL)
    sums = c.share.groupBy("step").agg(F.sum("share").alias("s")).collect()
    assert sums and all(r.s == pytest.approx(1.0, abs=1e-9) for r in sums)


def test_rescaled_top_words_sum_to_one(spark):
    c = Ctx(spark, SF_SMALL)
    for df in (T.top_words(c.topic_term, c.share), T.top_words_over_time(c.topic_term)):
        keys = [k for k in ("topic", "step") if k in df.columns]
        sums = df.groupBy(*keys).agg(F.sum("prob").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert all(r.s == pytest.approx(1.0, abs=1e-9) and r.n <= 10 for r in sums)


def test_merge_plan_idempotent(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "e")], "l1 string, l2 string")
    plan = H.merge_plan(pairs)
    m = {r.label: r.merged_into for r in plan.collect()}
    assert all(m[m[x]] == m[x] for x in m)


def test_similarity_symmetric_under_swap(spark):
    c = Ctx(spark, SF_SMALL)
    a = {(r.topic_1, r.topic_2): r.similarity for r in C.topic_similarity(c.model, 0, 1).collect()}
    b = {(r.topic_2, r.topic_1): r.similarity for r in C.topic_similarity(c.model, 1, 0).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_label_share_normalised(spark):
    from topicspark.operators import labels as L
    c = Ctx(spark, SF_SMALL)
    ls = L.label_share_over_time(c.topic_term, c.thesaurus, c.word_vec)
    sums = ls.groupBy("topic", "step").agg(F.sum("value").alias("s")).collect()
    assert sums and all(r.s == pytest.approx(1.0, abs=1e-9) for r in sums)
