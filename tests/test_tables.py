"""Compiled word tables: the same rows as by joins, without an exchange."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from topicspark.functions import tables
from topicspark.operators import match as M
from topicspark.operators import text as X
from topicspark.plans.catalog import Ctx
from topicspark.plans.catalog_text import plural_lemmas


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return Counter(tuple(str(x) for x in r) for r in df.collect())


@pytest.fixture()
def small_tables(monkeypatch):
    """Tables count as too large to be compiled."""
    def few(on):
        monkeypatch.setattr(tables, "MAX_ENTRIES", 0 if on else 100_000)
    return few


def test_lookup_finds_what_a_dictionary_holds(spark):
    own = {w: w.upper() for w in ["", "a", "é", 'quo"te', "back\\slash", "東京", *(f"w{i}" for i in range(500))]}
    found, known = tables.lookup(own), tables.member(own)
    words = [*own, "b", "w500", None, "A"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", found(F.col("w")).alias("v"), known(F.col("w")).alias("k"))
    for r in df.collect():
        assert r.v == own.get(r.w) and bool(r.k) == (r.w in own)
    assert tables.bounded_rows(spark.range(5), 4) is None and len(tables.bounded_rows(spark.range(5), 5)) == 5


LEMMAS = [("Mines", "Mine"), ("mines", "mine"), ("leaves", "leaf"), ("leaf", "leave"), ("ran", "run fast"), ("ran", "zz"), ("same", "same"), (None, "x"), ("x", None)]
DOCS = [(1, "Coal mines, and the mine. Leaves leaf"), (2, None), (3, ""), (4, "ran same ran\nmines the coal mine of coal mines"), (4, "mines again"), (5, "!!! ... ")]


def _docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("other", F.lit("o"))


def test_lemmas_by_table_and_by_join_agree(spark, small_tables):
    lemmas = spark.createDataFrame(LEMMAS, "form string, lemma string")
    df = X.tokenize_sentences(_docs(spark))
    near = X.lemmatize(df, lemmas)
    assert "Exchange" not in _plan(near) and near.columns == df.columns
    got = {r.doc_id: r.sents for r in near.where("doc_id <> 4").collect()}
    assert got[1] == [["coal", "mine", "and", "the", "mine"], ["leaf", "leave"]] and got[2] == [] and got[3] == []
    small_tables(True)
    far = X.lemmatize(df, lemmas)
    assert "Exchange" in _plan(far) and far.columns == df.columns and _rows(far) == _rows(near)
    assert X.lemmatize(_docs(spark).withColumn("sents", F.array().cast("array<array<string>>")).limit(0), lemmas).collect() == []


@pytest.mark.parametrize("with_lemmas", [False, True])
def test_matches_by_table_and_by_join_agree(spark, small_tables, with_lemmas):
    lemmas = spark.createDataFrame(LEMMAS, "form string, lemma string") if with_lemmas else None
    themes = spark.createDataFrame([("a", "coal mine"), ("a", "Mine"), ("b", "coal mines"), ("b", "the mine."), ("c", "leaf"), ("c", "leave"), ("c", "leaf"), (None, "ran"), ("d", None), ("d", " "), ("e", "of coal mine")], "theme string, keyword string")
    docs = _docs(spark).select("doc_id", M.match_tokens("text").alias("toks"))
    near = M.phrase_match(docs, themes, lemmas=lemmas)
    assert "Exchange" not in _plan(near) and "Join" not in _plan(near)
    found, measured = _rows(near), [_rows(M.measure_space(_docs(spark).where("doc_id <> 4"), themes, mode=m, lemmas=lemmas)) for m in ("fold", "simple", "longest")]
    assert sum(found.values()) > 5
    small_tables(True)
    far = M.phrase_match(docs, themes, lemmas=lemmas)
    assert "BroadcastHashJoin" not in _plan(far.where("theme is not null")) or "BuildLeft" not in _plan(far)
    assert _rows(far.where("theme is not null")) == found
    assert [_rows(M.measure_space(_docs(spark).where("doc_id <> 4"), themes, mode=m, lemmas=lemmas)) for m in ("fold", "simple", "longest")] == measured


def test_measured_corpus_is_filtered_at_no_more_than_twice_the_work(spark):
    """A filter on the counts is pushed below the projection; what it repeats is one expression, not one for each token."""
    c = Ctx(spark, SF_SMALL)
    ms = M.measure_space(c.t("documents"), c.themes, lemmas=plural_lemmas(spark, SF_SMALL))
    assert "Exchange" not in _plan(ms) and _plan(ms).count("Scan parquet") == 1
    start = time.perf_counter()
    ms.where(F.size("theme_counts") > 0).select(F.explode("theme_counts")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 60


def test_no_phrases_and_no_documents(spark):
    none = spark.createDataFrame([], "theme string, keyword string")
    docs = _docs(spark).select("doc_id", M.match_tokens("text").alias("toks"))
    assert M.phrase_match(docs, none).collect() == [] and M.phrase_match(docs.limit(0), spark.createDataFrame([("a", "coal")], "theme string, keyword string")).collect() == []
    assert {(r.doc_id, str(r.theme_counts)) for r in M.measure_space(_docs(spark), none).collect()} == {(i, "{}") for i in (1, 2, 3, 4, 5)}


def test_ngrams_by_table_and_by_join_agree(spark, small_tables):
    ng = spark.createDataFrame([("a b",), ("b c",), ("a b c d",), ("c d e",), ("e e",), ("single",), (None,), ("a b",)], "ngram string")
    sents = [[["a", "b", "c", "d", "e"], [], ["e", "e", "e", "e", "e"]], [["b", "c", "d", "e", "single"]], [], [["x"]]]
    df = spark.createDataFrame([(i, s, "o") for i, s in enumerate(sents)], "doc_id long, sents array<array<string>>, other string")
    near = X.join_ngrams(df, ng)
    assert "Exchange" not in _plan(near)
    assert {r.doc_id: r.sents for r in near.collect()} == {0: [["a_b_c_d", "e"], [], ["e_e", "e_e", "e"]], 1: [["b", "c_d_e", "single"]], 2: [], 3: [["x"]]}
    small_tables(True)
    far = {r.doc_id: r.sents for r in X.join_ngrams(df, ng).collect()}
    assert {i: far[i] for i in (0, 1, 3)} == {r.doc_id: r.sents for r in near.collect() if r.doc_id != 2}


def test_a_sentence_of_many_matches_takes_seconds(spark):
    n = 6_700  # some 20,000 matches
    df = spark.createDataFrame([(1, [["a", "b"] * n])], "doc_id long, sents array<array<string>>")
    ng = spark.createDataFrame([("a b",), ("b a",), ("b a b",)], "ngram string")
    start = time.perf_counter()
    (row,) = X.join_ngrams(df, ng).collect()
    assert time.perf_counter() - start < 60
    # the longest first, then leftmost: each third span of the chain stays, as by a plain loop
    spans = sorted([(-3, i, i + 2, "a b") for i in range(0, 2 * n, 2)] + [(-3, i, i + 2, "b a") for i in range(1, 2 * n - 1, 2)] + [(-5, i, i + 3, "b a b") for i in range(1, 2 * n - 2, 2)])
    taken, kept = bytearray(2 * n), []
    for _, s, e, k in spans:
        if not any(taken[s:e]):
            taken[s:e] = b"\1" * (e - s)
            kept.append((s, e, k))
    want, at = [], 0
    for s, e, k in sorted(kept):
        want += (["a", "b"] * n)[at:s] + [k.replace(" ", "_")]
        at = e
    assert row.sents[0] == want + (["a", "b"] * n)[at:]
