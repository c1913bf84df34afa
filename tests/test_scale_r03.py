"""What a task holds and what is exchanged: vocabulary, bag of words, topic tables, fitting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.functions import ids
from topicspark.operators import fit
from topicspark.operators import vocab as V
from topicspark.plans import fixtures as fx
from topicspark.sources import files as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


ROWS = [(3, ["b", "a", "b"]), (-2, ["c", "a"]), (3, ["d", "c"]), (None, ["e", "a"]), (7, []), (8, None)]


@pytest.fixture()
def tok(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, tokens array<string>")
    return V.tokens_long(df.withColumn("doc_order", F.col("doc_id")), keep=("doc_order",))


def test_vocabulary_ids_by_first_place_with_repeated_negative_and_null_orders(tok):
    got = {r.word: (r.word_id, r.cnt) for r in V.vocab(tok, min_freq=0).collect()}
    assert got == {"e": (0, 1), "c": (1, 2), "a": (2, 3), "b": (3, 2), "d": (4, 1)}
    text = V.vocab(tok.withColumn("doc_order", F.format_string("%05d", F.col("doc_order") + 100)).where("doc_id is not null"), min_freq=0)
    assert [r.word for r in text.orderBy("word_id").collect()] == ["c", "a", "b", "d"]


def test_counts_exchange_word_ids_and_vocabulary_is_broadcast_by_its_real_size(tok):
    voc = V.vocab(tok, min_freq=1)
    dtc = V.doc_term_counts(tok, voc)
    plan = _plan(dtc)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and " w#" in x]
    place = {r.word: r.word_id for r in voc.collect()}
    want = {(3, place["b"], 2, 0), (3, place["a"], 1, 1), (-2, place["c"], 1, 0), (-2, place["a"], 1, 1), (3, place["c"], 1, 1), (None, place["a"], 1, 1)}
    assert {(r.doc_id, r.word_id, r.cnt, r.first_pos) for r in dtc.collect()} == want


def test_counts_are_the_same_with_a_large_vocabulary_and_with_repeated_ids(spark, tok, monkeypatch):
    voc = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "word_id long, word string")
    want = [(r.doc_id, r.word_id, r.cnt, r.first_pos) for r in V.doc_term_counts(tok, voc).collect()]
    assert sorted(map(str, want)) == sorted(map(str, [(3, 0, 1, 1), (3, 1, 2, 0), (3, 1, 1, 1), (-2, 1, 1, 0), (-2, 0, 1, 1), (None, 0, 1, 1)]))
    one = voc.where("word <> 'c'")
    small = sorted(map(str, V.doc_term_counts(tok, one).collect()))
    monkeypatch.setattr(ids.measured_broadcast, "__defaults__", (0,))
    assert sorted(map(str, V.doc_term_counts(tok, one).collect())) == small


def test_tokens_are_made_once(spark):
    d = spark.createDataFrame([(1, "A b b", "en", "src1", 2000), (2, None, "en", "src1", 2000), (3, "", "en", "src1", 2000)],
                              "doc_id long, text string, lang string, source string, step int")
    tok = fx.fx_tokens(d)
    assert _optimized(tok).count("split(") == 1
    assert [(r.doc_id, r.pos, r.w) for r in tok.collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "b")]


def test_bag_of_words_is_read_without_an_exchange_by_words(spark, tok):
    voc = V.vocab(tok, min_freq=0)
    lines = V.bow_rows(V.doc_term_counts(tok, voc)).select(F.lit("f").alias("file_path"), F.col("doc_id").alias("line"), F.col("bow").alias("value"))
    back = R.parse_bow(lines, voc)
    assert "SortMergeJoin" not in _plan(back)
    got = {r.doc_idx: sorted(r.tokens) for r in back.collect()}
    assert got == {3: ["a", "b", "b", "c", "d"], -2: ["a", "c"], None: ["a", "e"]}


def test_topic_terms_count_vocabulary_words_by_id(spark):
    d = spark.createDataFrame([(1, "a b b x", "en", "src1", 2000), (2, "a a", "en", "src1", 2000), (3, "b x", "en", None, 2001)],
                              "doc_id long, text string, lang string, source string, step int")
    tok = fx.fx_tokens(d)
    voc = spark.createDataFrame([(0, "a"), (1, "b")], "word_id long, word string")
    tt = fx.fx_topic_term(tok, voc)
    assert not [x for x in _plan(tt).split("\n") if "HashAggregate" in x and " w#" in x]
    assert sorted(map(str, [tuple(r) for r in tt.collect()])) == sorted(map(str, [(1, 2000, 0, "a", 0.6), (1, 2000, 1, "b", 0.4), (None, 2001, 1, "b", 1.0)]))


def test_mixtures_of_many_documents_equal_each_alone():
    rng = np.random.default_rng(1)
    sizes, k = [3, 1, 7, 2], 4
    starts = np.append(0, np.cumsum(sizes)[:-1])
    counts, probs = rng.integers(1, 9, sum(sizes)).astype(float), rng.random((k, sum(sizes)))
    theta, given = fit.mixtures(counts, probs, starts, 0.1)
    for d, (s, n) in enumerate(zip(starts, sizes)):
        t, g = fit.mixture(counts[s:s + n], probs[:, s:s + n].T, 0.1)
        assert theta[:, d] == pytest.approx(t) and given[:, s:s + n].T == pytest.approx(g)


def test_fit_exchanges_sums_only_and_is_the_same_by_batches_and_by_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, 2000 + i % 2, [f"w{(i * j) % 7}" for j in range(9)]) for i in range(12)], "doc_id long, step int, tokens array<string>")
    run = [{"topics": 2, "alpha": 0.1, "topic_var": 0.05}]

    def fitted():
        return [sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
                for df in fit.fit_topics_grid(docs, run, max_iter=2, step="step")]
    own = spark.createDataFrame([(1, 2000, [0, 1], [2, 1])], "_doc long, step int, word_ids array<long>, cnt array<long>")
    matrix = spark.createDataFrame([(2000, 0, [0.5, 0.5])], "step int, word_id long, b array<double>")
    plan = _plan(fit._asked(own, matrix, ["step", "word_id"], 10, 2))
    assert "Exchange hashpartitioning" not in plan
    want = fitted()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(fit, "BROADCAST_BYTES", 0)
    try:
        assert fitted() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
