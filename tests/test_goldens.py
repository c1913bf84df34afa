"""Hand goldens (FIXTURES.md section 5)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import compare as C
from topicspark.operators import labels as L
from topicspark.operators import match as M
from topicspark.operators import steps as S
from topicspark.operators import text as X
from topicspark.operators import thesaurus as H
from topicspark.operators import topics as T
from topicspark.operators import vocab as V

# weather: rain storm snow storm rain cloud (6 tokens); food: bread rice fish soup (4)
THESAURUS = {"rain": "weather", "bread": "food", "storm": "weather", "snow storm": "weather", "rice": "food",
             "fish soup": "food", "rain cloud": "weather"}
TOPIC = [(0.5, "storm"), (0.2, "rice"), (0.2, "rain_cloud"), (0.1, "unheard")]


def _topic_df(spark):
    return spark.createDataFrame([(0, w, p) for p, w in TOPIC], "topic int, word string, prob double")


def test_label_docs(spark):
    tok, lens = L.label_docs(L.thesaurus_from_dict(spark, THESAURUS))
    assert {r.label: r.doc_len for r in lens.collect()} == {"weather": 6, "food": 4}
    got = sorted((r.label, r.g, r.tok) for r in tok.collect())
    assert [t for lab, _, t in got if lab == "weather"] == "rain storm snow storm rain cloud".split()


def test_label_docs_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 2)
    tok, _ = L.label_docs(L.thesaurus_from_dict(spark, THESAURUS))
    assert sorted((r.g, r.tok) for r in tok.collect() if r.label == "food") == [(0, "bread"), (1, "rice"), (2, "fish"), (3, "soup")]


def test_label_scores_tfidf(spark):
    thes = L.thesaurus_from_dict(spark, THESAURUS)
    scores = {r.label: r.score for r in L.label_scores_tfidf(_topic_df(spark), thes).collect()}
    # storm: 2 matches x tf 2/6; rain cloud: 1 x 1/6; rice: 1 x 1/4; idf ln 2
    assert scores["weather"] == pytest.approx((0.5 * 2 * 2 / 6 + 0.2 * 1 / 6) * math.log(2), abs=1e-9)
    assert scores["food"] == pytest.approx(0.2 * 1 / 4 * math.log(2), abs=1e-9)


def test_raw_scores_hold_every_label(spark):
    """Labels without a match score 0 and are there."""
    thes = L.thesaurus_from_dict(spark, {**THESAURUS, "stone": "geology"})
    raw = L.label_topics(_topic_df(spark), thes, score_type="tfidf", raw=True)
    assert {r.label: r.score for r in raw.collect()}["geology"] == 0.0


def test_top_labels(spark):
    thes = L.thesaurus_from_dict(spark, THESAURUS)
    top = L.label_topics(_topic_df(spark), thes, top_n=1, score_type="tfidf").collect()
    assert [(r.label, r.score) for r in top] == [("weather", 0.25)]


def test_top_labels_zero_fill(spark):
    """A topic without any match still gets its n labels (score 0, label order)."""
    thes = L.thesaurus_from_dict(spark, THESAURUS)
    tw = spark.createDataFrame([(5, "nothing", 1.0)], "topic int, word string, prob double")
    top = L.label_topics(tw, thes, top_n=2, score_type="tfidf").orderBy("rank").collect()
    assert [(r.label, r.score) for r in top] == [("food", 0.0), ("weather", 0.0)]


def test_topic_without_vectors_gets_no_embedding_label(spark):
    thes = L.thesaurus_from_dict(spark, {"rain": "weather", "bread": "food"})
    vec = spark.createDataFrame([("rain", [1.0, 0.0]), ("bread", [0.0, 1.0]), ("snow", [0.9, 0.1])], "word string, vec array<float>")
    tw = spark.createDataFrame([(0, "snow", 1.0), (1, "unheard", 1.0)], "topic int, word string, prob double")
    got = L.label_topics(tw, thes, vec, top_n=1).collect()
    assert [(r.topic, r.label) for r in got] == [(0, "weather")]


LEMMAS = [("mines", "mine"), ("storms", "storm"), ("xs", "x")]


def _lemmas(spark):
    return spark.createDataFrame(LEMMAS, "form string, lemma string")


def test_terms_and_phrases_match_by_lemma(spark):
    thes = L.thesaurus_from_dict(spark, {"storms": "weather", "bread": "food"})
    tw = spark.createDataFrame([(0, "storm", 1.0)], "topic int, word string, prob double")
    scores = {r.label: r.score for r in L.label_scores_tfidf(tw, thes, lemmas=_lemmas(spark)).collect()}
    assert scores["weather"] > 0 and scores["food"] == 0


def _spans(spark, spans, theme="t"):
    rows = [(1, theme if isinstance(s[0], int) else s[0], *(s if isinstance(s[0], int) else s[1:]), "x")
            for s in spans]
    return spark.createDataFrame(rows, "doc_id long, theme string, start int, end int, term string")


SPANS = [(0, 4), (2, 3), (2, 6), (7, 8), (7, 9), (8, 12)]


def test_dedupe_fold(spark):
    kept = M.dedupe_matches(_spans(spark, SPANS), "fold").orderBy("start").collect()
    assert [(r.start, r.end) for r in kept] == [(2, 6), (7, 9), (8, 12)]


def test_dedupe_longest(spark):
    kept = M.dedupe_matches(_spans(spark, SPANS), "longest").orderBy("start").collect()
    assert [(r.start, r.end) for r in kept] == [(0, 4), (2, 6), (7, 9), (8, 12)]


def test_dedupe_same_start(spark):
    kept = M.dedupe_matches(_spans(spark, [(0, 2), (0, 4)]), "fold").collect()
    assert [(r.start, r.end) for r in kept] == [(0, 4)]


def test_dedupe_two_themes(spark):
    kept = M.dedupe_matches(_spans(spark, [("a", 0, 1), ("b", 0, 2)]), "fold").orderBy("theme").collect()
    assert [(r.theme, r.start, r.end) for r in kept] == [("a", 0, 1), ("b", 0, 2)]


def _sents(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, sents array<array<string>>")


def test_join_ngrams(spark):
    df = _sents(spark, [[["the", "old", "stone", "bridge"]], [["a", "river", "bank", "river", "bank", "b"], []],
                        [["old", "stone", "bridge", "x"]]])
    ng = spark.createDataFrame([("old stone bridge",), ("river bank",), ("stone bridge",)], "ngram string")
    out = {r.doc_id: r.sents for r in X.join_ngrams(df, ng).collect()}
    assert out[0] == [["the", "old_stone_bridge"]]
    assert out[1] == [["a", "river_bank", "river_bank", "b"], []]
    assert out[2] == [["old_stone_bridge", "x"]]


def test_longest_text_joins_first(spark):
    """The order is that of text length, not of the number of words."""
    df = _sents(spark, [[["a", "of", "an", "international-agreement", "now"]]])
    ng = spark.createDataFrame([("a of an",), ("an international-agreement",)], "ngram string")
    assert X.join_ngrams(df, ng).first().sents == [["a", "of", "an_international-agreement", "now"]]


def test_length_and_digit_rules_look_at_the_lemma(spark):
    df = spark.createDataFrame([(0, "Xs and storms of 12 b2b mines, a")], "doc_id long, text string")
    out = X.preprocess(df, lemmas=_lemmas(spark), stopwords=["and", "of"]).first().sents
    assert out == [["storm", "mine"]]


def test_lemmatize_keeps_other_columns_and_empty_rows(spark):
    df = spark.createDataFrame([(0, "kept", [["mines"], [], ["x"]]), (1, None, []), (2, "c", [[]])], "doc_id long, other string, sents array<array<string>>")
    got = {r.doc_id: (r.other, r.sents) for r in X.lemmatize(df, _lemmas(spark)).collect()}
    assert got == {0: ("kept", [["mine"], [], ["x"]]), 1: (None, []), 2: ("c", [[]])}


def test_merge_sentences_and_docs(spark):
    df = _sents(spark, [[["this", "is", "the", "first", "sentence"], ["second", "sentence"]], [[]], [["a", "b"]]])
    m = {r.doc_id: r.tokens for r in X.merge_sentences(df).collect()}
    assert m[0] == ["this", "is", "the", "first", "sentence", "second", "sentence"]
    keep = {r.doc_id: r.doc for r in X.merge_docs(df, keep_empty=True).collect()}
    assert keep[1] == "" and keep[2] == "a b"
    drop = {r.doc_id: r.doc for r in X.merge_docs(df).collect()}
    assert 1 not in drop and drop[2] == "a b"


def _tok(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, doc_order long, pos int, w string")


def test_vocab_strict(spark):
    rows = [(0, 0, i, "a") for i in range(3)] + [(0, 0, 3 + i, "b") for i in range(2)]
    voc = V.vocab(_tok(spark, rows), min_freq=2).collect()
    assert [(r.word, r.cnt, r.word_id) for r in voc] == [("a", 3, 0)]


def test_vocab_first_appearance(spark):
    rows = [(1, 0, 0, "z"), (1, 0, 1, "y"), (0, 5, 0, "y"), (0, 5, 1, "x"), (0, 5, 2, "z"), (0, 5, 3, "x")]
    voc = {r.word: r.word_id for r in V.vocab(_tok(spark, rows), min_freq=0).collect()}
    assert voc == {"z": 0, "y": 1, "x": 2}


def test_filter_docs(spark):
    voc = spark.createDataFrame([(i, f"w{i}", 100) for i in range(6)], "word_id long, word string, cnt long")
    rows = [(0, 0, i, f"w{i % 5}") for i in range(15)]
    rows += [(1, 1, i, f"w{i % 5}") for i in range(16)]
    rows += [(2, 2, i, f"w{i % 6}") for i in range(16)]
    dtc = V.doc_term_counts(_tok(spark, rows), voc)
    kept = sorted({r.doc_id for r in V.filter_docs(dtc).collect()})
    assert kept == [2]


def test_bow_rows(spark):
    voc = spark.createDataFrame([(0, "a", 9), (1, "b", 9), (2, "c", 9)], "word_id long, word string, cnt long")
    rows = [(0, 0, i, w) for i, w in enumerate(["b", "a", "b", "c"])]
    bow = V.bow_rows(V.doc_term_counts(_tok(spark, rows), voc)).collect()
    assert bow[0].bow == "3 1:2 0:1 2:1"


def test_batch_years(spark):
    df = spark.createDataFrame([(y,) for y in [1997, 1999, 2000, 2003]], "step int")
    out = [r.batch for r in S.batch_years(df, "step", 3).orderBy("step").collect()]
    assert out == [0, 0, 1, 2]


def test_bucket_present_months(spark):
    import datetime as dt
    dates = [dt.date(2012, 1, 5), dt.date(2012, 2, 5), dt.date(2012, 3, 5), dt.date(2012, 5, 5)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "id int, d date")
    out = [r.step for r in S.bucket_present_months(df, "d").orderBy("id").collect()]
    assert out == [0, 0, 0, 1]


def test_merge_plan(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "l1 string, l2 string")
    plan = {r.label: r.merged_into for r in H.merge_plan(pairs).collect()}
    assert plan == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "d"}


def test_merge_plan_of_a_long_chain(spark):
    """Components of any length are found whole."""
    names = [f"n{i:03d}" for i in range(150)]
    pairs = spark.createDataFrame(list(zip(names, names[1:])), "l1 string, l2 string")
    plan = H.merge_plan(pairs).collect()
    assert {r.merged_into for r in plan} == {"n001"} and {r.group_size for r in plan} == {150}


def test_merge_by_category_of_lowercased_labels(spark):
    thes = spark.createDataFrame([("1011 european union law",), ("1016 european construction",)], "MT string")
    assert {(r.merged_into, r.label) for r in H.merge_by_category(thes).collect() if r.label != r.merged_into} \
        in (set(), {("1011 european union law", "1016 european construction")})
    assert "1011 european union law" in {r.merged_into for r in H.merge_by_category(thes).collect()}


def test_merge_by_category(spark):
    thes = spark.createDataFrame([("1606 economic policy",), ("1621 economic structure",),
                                  ("6626 soft energy",), ("6611 coal and mining industries",)], "MT string")
    steps = {(r.merged_into, r.label) for r in H.merge_by_category(thes).collect()}
    assert steps == {("1606 economic policy", "1606 economic policy"), ("1606 economic policy", "1621 economic structure")}


def test_strip_label_code(spark):
    df = spark.createDataFrame([("6626 renewable energy",), ("sport",)], "l string")
    assert [r[0] for r in df.select(H.strip_label_code("l")).collect()] == ["renewable energy", "sport"]


def test_normalise_labels(spark):
    df = spark.createDataFrame([("2016 Trade",), ("6626 soft energy",)], "MT string")
    out = [r.MT for r in H.normalise_labels(df, cols=("MT",)).collect()]
    assert out == ["2016 business operations and trade", "6626 renewable energy"]


def _models(spark, m1, m2):
    rows = [(0, t, w, p) for t, d in enumerate(m1) for w, p in d.items()]
    rows += [(1, t, w, p) for t, d in enumerate(m2) for w, p in d.items()]
    return spark.createDataFrame(rows, "model int, topic int, word string, prob double")


M1 = [{"tea": .6, "cup": .4}, {"cup": .5, "milk": .5}]
M2 = [{"tea": .25, "pot": .75}, {"milk": 1.0}]


def _dense_cosines(m1, m2):
    words = sorted({w for d in m1 + m2 for w in d})
    x = np.array([[d.get(w, 0) for w in words] for d in m1 + m2])
    x = x - x.mean(axis=0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(i, j): x[i] @ x[len(m1) + j] for i in range(len(m1)) for j in range(len(m2))}


def test_topic_similarity(spark):
    sim = {(r.topic_1, r.topic_2): r.similarity for r in C.topic_similarity(_models(spark, M1, M2)).collect()}
    assert sim == pytest.approx(_dense_cosines(M1, M2), abs=1e-9)


def test_topic_similarity_one_topic(spark):
    m = _models(spark, [{"tea": .7, "cup": .3}], [{"tea": .2, "pot": .8}])
    assert C.topic_similarity(m).collect()[0].similarity == pytest.approx(-1.0, abs=1e-9)


def test_vector_similarity_of_sparse_vectors(spark):
    x = spark.createDataFrame([("a", 0, 3.0), ("a", 2, 4.0), ("z", 1, 0.0)], "xid string, dim int, v double")
    y = spark.createDataFrame([("b", 0, 1.0), ("c", 5, 2.0)], "yid string, dim int, v double")
    got = {(r.xid, r.yid): r.similarity for r in C.vector_similarity(x, y).collect()}
    assert got == {("a", "b"): pytest.approx(0.6), ("a", "c"): 0.0, ("z", "b"): None, ("z", "c"): None}


def test_order_topics(spark):
    rows = [(2001, 0, 0.5, "x"), (1999, 0, 0.1, "x"), (1999, 1, 0.6, "y"), (2001, 1, 0.2, "y"),
            (1999, 2, 0.4, "z"), (2001, 2, 0.3, "z")]
    sl = spark.createDataFrame(rows, "step int, topic int, share double, topic_name string")
    order = [r.topic_name for r in T.order_topics(sl).orderBy("ord").collect()]
    assert order == ["y", "z", "x"]


def test_compare_all_models_matches_pairwise(spark):
    m = _models(spark, M1, M2)
    allp = {(r.topic_1, r.topic_2): r.similarity for r in C.compare_all_models(m).collect()}
    one = {(r.topic_1, r.topic_2): r.similarity for r in C.topic_similarity(m).collect()}
    assert allp.keys() == one.keys()
    for k in one:
        assert allp[k] == pytest.approx(one[k], abs=1e-9)


def test_measure_space_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, "Coal mine and coal.")], "doc_id long, text string")
    themes = spark.createDataFrame([("coal", "coal"), ("coal", "coal mine")], "theme string, keyword string")
    out = {r.doc_id: r for r in M.measure_space(df, themes).collect()}
    assert out[1].text is None and out[1].theme_counts == {}
    assert out[2].theme_counts == {"coal": 2}
    assert out[2].theme_terms == {"coal mine": 1, "coal": 1}


def _match(spark, text, keyword, lemmas=None):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    themes = spark.createDataFrame([("t", keyword)], "theme string, keyword string")
    return tuple(sorted(M.measure_space(df, themes, lemmas=lemmas).first()["theme_terms"].items()))


def test_keywords_match_by_lemma_and_keep_the_surface(spark):
    lem = _lemmas(spark)
    for keyword in ("coal mines", "coal mine"):
        assert _match(spark, "Old coal mines closed; one coal mine stayed", keyword, lem) == (("coal mine", 1), ("coal mines", 1))
    assert not _match(spark, "Old coal mines closed", "coal mine")


def test_punctuation_and_line_ends_block_a_match(spark):
    assert not _match(spark, "They sold coal. Mine workers left", "coal mine")
    assert not _match(spark, "coal\nmine", "coal mine")
    assert _match(spark, "a coal  mine, too", "coal mine") == (("coal mine", 1),)


def test_a_step_without_mapping_fails(spark):
    df = spark.createDataFrame([(1, 1997), (2, 1998)], "doc_id long, step int")
    mapping = spark.createDataFrame([(1997, 0)], "step int, mapped int")
    with pytest.raises(Exception, match="step without a mapping: 1998"):
        S.apply_step_map(df, mapping).collect()
    assert S.apply_step_map(df.filter("step = 1997"), mapping).first().step == 0


def test_share_series_is_in_percent_of_the_topics_own_total(spark):
    share = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.6), (1, 1, 0.8), (2, 1, 0.4)], "step int, topic int, share double")
    words = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.3)], "topic int, step int, w double")
    got = {r.step: r._prop for r in T.words_with_share(words, share).collect()}
    assert got == {1: pytest.approx(25.0), 2: pytest.approx(75.0)}


def test_sample_docs_repeatable(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = [r.doc_id for r in S.sample_docs(d, 20).collect()]
    b = [r.doc_id for r in S.sample_docs(d, 20).collect()]
    assert a == b and len(set(a)) == 20


def test_fit_topics_grid(spark):
    docs = spark.createDataFrame([(i, ["coal", "mine", "gas"] * 3 if i % 2 else ["sun", "solar", "panel"] * 3)
                                  for i in range(20)], "doc_id long, tokens array<string>")
    tt, dt = __import__("topicspark.operators.fit", fromlist=["x"]).fit_topics_grid(
        docs, [{"topics": 2, "alpha": 0.1, "topic_var": 0.05}], max_iter=5)
    sums = [r.s for r in tt.groupBy("topic").agg(F.sum("prob").alias("s")).collect()]
    assert len(sums) == 2 and all(s == pytest.approx(1.0, abs=1e-6) for s in sums)
    per_doc = [r.s for r in dt.groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()]
    assert len(per_doc) == 20 and all(s == pytest.approx(1.0, abs=1e-6) for s in per_doc)


def test_order_topics_callable(spark):
    rows = [(2001, 0, 0.5, "10"), (1999, 1, 0.6, "9"), (1999, 2, 0.4, "x")]
    sl = spark.createDataFrame(rows, "step int, topic int, share double, topic_name string")
    order = [r.topic_name for r in T.order_topics(sl, sort_by=lambda c: F.length(c)).orderBy("ord").collect()]
    assert order == ["9", "x", "10"]
