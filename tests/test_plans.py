"""Plan-shape checks: the properties the design relies on at scale."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicspark.plans.catalog import QUERIES, Ctx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    for name in ["compare_all_models", "topic_similarity", "label_scores_embedding", "label_model_topics",
                 "phrase_match", "measure_space", "merge_plan"]:
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = QUERIES["step_range"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    df2 = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter(F.col("lang") == "en").select("doc_id")
    p2 = _plan(df2)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p2 and "ReadSchema: struct<doc_id:bigint,lang:string>" in p2


def test_in_row_text_work_needs_one_scan_and_no_exchange(spark):
    for name in ["tokenize_sentences", "filter_tokens", "drop_terms", "merge_sentences", "merge_docs", "split_tokens"]:
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "Exchange" not in plan and plan.count("Scan parquet") == 1, name


def test_topk_uses_group_limit(spark):
    c = Ctx(spark, SF_SMALL)
    from topicspark.operators.topics import top_words_over_time
    plan = _plan(top_words_over_time(c.topic_term))
    assert "WindowGroupLimit" in plan


def test_no_large_table_meets_in_one_task(spark):
    """Only frames of one row per step, topic, label or partition go to a single partition."""
    for name in ["check_model", "label_docs", "term_label_tfidf", "topic_terms"]:
        df = QUERIES[name](spark, SF_SMALL)
        df.write.format("noop").mode("overwrite").save()
        for line in _plan(df).split("\n"):
            if "Window [" in line:
                assert "pos" in line or "step" in line or "_c" in line or "topic" in line or "_pid" in line, (name, line)


def test_samples_equal_a_sort_and_no_task_gets_them_all(spark):
    from topicspark.operators import steps as S
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    d = d.unionByName(d.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, "x")], d.schema))
    for shuffle in (True, False):
        for limit in (1, 2, 50, 199, 10_000):
            got = S.sample_docs(d, limit, shuffle=shuffle)
            assert "TakeOrderedAndProject" not in _plan(got) and "GlobalLimit" not in _plan(got)
            order = S.sample_docs(d, None, shuffle=shuffle)
            ids = [r.doc_id for r in order.orderBy("doc_order", "doc_id").limit(limit).collect()]
            assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in d.collect() if r.doc_id in ids)


def test_blocks_grow_in_number_with_the_rows(spark):
    from topicspark.operators.vectors import paired_in_blocks
    a, b = spark.range(30).withColumnRenamed("id", "a"), spark.range(41).withColumnRenamed("id", "b")
    for rows in (1, 7, 256):
        got = paired_in_blocks(a, b, F.col("a") < F.col("b"), block_rows=rows)
        assert sorted((r.a, r.b) for r in got.collect()) == [(i, j) for i in range(30) for j in range(41) if i < j]
    groups = []
    for n in (300, 600):
        x = spark.range(n).withColumnRenamed("id", "a")
        pairs = paired_in_blocks(x, x.withColumnRenamed("a", "b"), block_rows=50).withColumn("p", F.spark_partition_id())
        groups.append(pairs.count())
    assert groups == [300 * 300, 600 * 600]
    assert paired_in_blocks(a.limit(0), b).collect() == []


def test_checks_read_each_table_once(spark):
    from topicspark.operators.checks import check_model
    docs = spark.createDataFrame([(0, 1999), (1, 1999), (2, 2001)], "doc_idx int, step int")
    steps = spark.createDataFrame([(0, 2), (1, 1)], "step_idx int, n_docs int")
    mix = spark.createDataFrame([(i, t, 0.5) for i in range(3) for t in range(2)], "doc_idx int, topic int, weight double")
    terms = spark.createDataFrame([(t, w, s, 0.5) for t in range(2) for w in range(2) for s in range(2)][:-1], "topic int, word_id int, step_idx int, prob double")
    voc = spark.createDataFrame([(0,), (1,)], "word_id int")
    got = {r.check: (r.expected, r.actual, r.ok) for r in check_model(docs, steps, mix, terms, voc, 3, 2).collect()}
    assert got == {"doc_steps_rows": (3, 3, True), "steps_agree": (2, 2, True), "step_count_total": (3, 3, True), "doc_topic_rows": (6, 6, True),
                   "topics_per_doc": (2, 2, True), "topics_present": (2, 2, True), "topic_term_full": (2, 1, False)}
