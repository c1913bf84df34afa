"""Registered queries for topic analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.operators import topics as T
from topicspark.plans.catalog import Ctx, register, rounded

_SHARE_LONG_SQL = "fx_share_long AS (SELECT step, topic, share, CAST(topic AS VARCHAR) AS topic_name FROM fx_share)"


@register("doc_topic_mixtures", """
SELECT doc_id, step, string_agg(CAST(topic AS VARCHAR) || ':' || CAST(weight AS VARCHAR), ' ' ORDER BY topic) AS mixture
FROM fx_doc_topic GROUP BY doc_id, step""")
def q_doc_topic_mixtures(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    m = T.doc_topic_mixtures(c.doc_topic)
    s = F.array_join(F.transform("mixture", lambda x: F.concat(x["topic"].cast("string"), F.lit(":"),
                                                              x["weight"].cast("string"))), " ")
    return m.select("doc_id", "step", s.alias("mixture"))


@register("step_topic_share", "SELECT step, topic, round(share, 6) AS share FROM fx_share")
def q_step_topic_share(spark, sf_dir):
    return rounded(Ctx(spark, sf_dir).share, "share")


@register("step_topic_log_share", "SELECT step, topic, round(ln(share), 6) AS log_share FROM fx_share")
def q_step_topic_log_share(spark, sf_dir):
    return rounded(T.step_topic_share(Ctx(spark, sf_dir).doc_topic, logged=True), "log_share")


@register("topic_terms", "SELECT topic, step, word_id, word, round(prob, 6) AS prob FROM fx_topic_term")
def q_topic_terms(spark, sf_dir):
    return rounded(T.topic_terms(Ctx(spark, sf_dir).topic_term), "prob")


def _top_sql(score: str, join: str, rescaled: bool) -> str:
    prob = "prob / sum(prob) OVER (PARTITION BY topic)" if rescaled else "prob"
    return f"""
WITH acc AS (SELECT t.topic, t.word_id, t.word, sum({score}) AS prob FROM fx_topic_term t {join}
             GROUP BY t.topic, t.word_id, t.word),
top AS (SELECT topic, word_id, word, prob,
               row_number() OVER (PARTITION BY topic ORDER BY prob DESC, word_id DESC) AS rank
        FROM acc QUALIFY rank <= 10)
SELECT topic, CAST(rank AS INTEGER) AS rank, word_id, word, round({prob}, 6) AS prob FROM top"""


_W_JOIN = "JOIN fx_share s ON s.topic = t.topic AND s.step = t.step"


@register("top_words_weighted", _top_sql("s.share * t.prob", _W_JOIN, True))
def q_top_words_weighted(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(T.top_words(c.topic_term, c.share, n=10), "prob")


@register("top_words_sum", _top_sql("t.prob", "", True))
def q_top_words_sum(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(T.top_words(c.topic_term, n=10, weighted=False), "prob")


@register("top_words_raw", _top_sql("s.share * t.prob", _W_JOIN, False))
def q_top_words_raw(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(T.top_words(c.topic_term, c.share, n=10, rescaled=False), "prob")


_OT_SQL = """
WITH top AS (SELECT topic, step, word_id, word, prob,
                    row_number() OVER (PARTITION BY topic, step ORDER BY prob DESC, word_id DESC) AS rank
             FROM fx_topic_term QUALIFY rank <= 10)
"""


@register("top_words_over_time", _OT_SQL + """
SELECT topic, step, CAST(rank AS INTEGER) AS rank, word_id, word,
       round(prob / sum(prob) OVER (PARTITION BY topic, step), 6) AS prob FROM top""")
def q_top_words_over_time(spark, sf_dir):
    return rounded(T.top_words_over_time(Ctx(spark, sf_dir).topic_term, n=10), "prob")


@register("top_words_frame", _OT_SQL + """
SELECT topic, step, string_agg(word, ' ' ORDER BY rank) AS top_words FROM top GROUP BY topic, step""")
def q_top_words_frame(spark, sf_dir):
    f = T.top_words_frame(Ctx(spark, sf_dir).topic_term, n=10)
    return f.select("topic", "step", F.array_join("top_words", " ").alias("top_words"))


@register("print_topic", _OT_SQL + """
SELECT step, string_agg(word, ' ' ORDER BY rank) AS top_words FROM top WHERE topic = 0 GROUP BY step""")
def q_print_topic(spark, sf_dir):
    f = T.top_words_frame(Ctx(spark, sf_dir).topic_term, n=10)
    return T.print_topic(f, 0).select("step", F.array_join("top_words", " ").alias("top_words"))


@register("top_words_static", """
WITH top AS (SELECT model, topic, word_id, word, prob,
                    row_number() OVER (PARTITION BY model, topic ORDER BY prob DESC, word_id DESC) AS rank
             FROM fx_model QUALIFY rank <= 10)
SELECT model, topic, CAST(rank AS INTEGER) AS rank, word_id, word, round(prob, 6) AS prob FROM top""")
def q_top_words_static(spark, sf_dir):
    return rounded(T.top_words_static(Ctx(spark, sf_dir).model, n=10, keys=("model", "topic")), "prob")


@register("topic_share_long", "SELECT step, topic, round(share, 6) AS share, CAST(topic AS VARCHAR) AS topic_name FROM fx_share")
def q_topic_share_long(spark, sf_dir):
    return rounded(T.topic_share_long(Ctx(spark, sf_dir).share), "share")


@register("drop_small_topics", f"""
WITH {_SHARE_LONG_SQL},
keep AS (SELECT topic FROM fx_share_long GROUP BY topic HAVING avg(share) > 1.0 / 6)
SELECT step, topic, round(share, 6) AS share, topic_name FROM fx_share_long WHERE topic IN (SELECT topic FROM keep)""")
def q_drop_small_topics(spark, sf_dir):
    sl = T.topic_share_long(Ctx(spark, sf_dir).share)
    return rounded(T.drop_small_topics(sl, threshold=1.0 / 6), "share")


_NAMES = [str(i) for i in range(6)]


@register("topic_share_matrix", f"""
WITH {_SHARE_LONG_SQL}
SELECT step, {", ".join(f"round(first(share) FILTER (WHERE topic_name = '{n}'), 6) AS \"{n}\"" for n in _NAMES)}
FROM fx_share_long WHERE step <= 2015 GROUP BY step""")
def q_topic_share_matrix(spark, sf_dir):
    sl = T.topic_share_long(Ctx(spark, sf_dir).share)
    m = T.topic_share_matrix(sl, names=_NAMES, limit=2015)
    return rounded(m, *_NAMES)


@register("year_limit", f"""
WITH {_SHARE_LONG_SQL}
SELECT step, topic, round(share, 6) AS share, topic_name FROM fx_share_long WHERE step <= 2015""")
def q_year_limit(spark, sf_dir):
    sl = T.topic_share_long(Ctx(spark, sf_dir).share)
    return rounded(T.year_limit(sl, 2015), "share")


@register("topic_series_pct", f"""
WITH {_SHARE_LONG_SQL}
SELECT step, topic, topic_name, round(100 * share / sum(share) OVER (PARTITION BY topic_name), 6) AS pct
FROM fx_share_long""")
def q_topic_series_pct(spark, sf_dir):
    sl = T.topic_share_long(Ctx(spark, sf_dir).share)
    return rounded(T.topic_series_pct(sl), "pct")


@register("topic_share_pct", f"""
WITH {_SHARE_LONG_SQL},
p AS (SELECT step, topic_name, 100 * share / sum(share) OVER (PARTITION BY step) AS pct FROM fx_share_long)
SELECT step, topic_name, round(pct, 6) AS pct FROM p WHERE topic_name IN ('1', '3', '5')""")
def q_topic_share_pct(spark, sf_dir):
    sl = T.topic_share_long(Ctx(spark, sf_dir).share)
    return rounded(T.topic_share_pct(sl, keep=[1, 3, 5]), "pct")


@register("order_topics", f"""
WITH {_SHARE_LONG_SQL},
peak AS (SELECT topic_name, arg_max(step, (share, -step)) AS peak_step FROM fx_share_long GROUP BY topic_name)
SELECT topic_name, peak_step, CAST(row_number() OVER (ORDER BY peak_step, topic_name) - 1 AS INTEGER) AS ord FROM peak""")
def q_order_topics(spark, sf_dir):
    sl = T.topic_share_long(Ctx(spark, sf_dir).share)
    return T.order_topics(sl)


_WORDS = ["the", "and", "of"]


@register("words_over_time", f"""
SELECT topic, step, {", ".join(f"round(first(prob) FILTER (WHERE word = '{w}'), 6) AS \"{w}\"" for w in _WORDS)}
FROM fx_topic_term WHERE word IN ({", ".join(repr(w) for w in _WORDS)}) GROUP BY topic, step""")
def q_words_over_time(spark, sf_dir):
    return rounded(T.words_over_time(Ctx(spark, sf_dir).topic_term, _WORDS, check=True), *_WORDS)


@register("words_with_share", f"""
WITH w AS (SELECT topic, step, {", ".join(f"first(prob) FILTER (WHERE word = '{w}') AS \"{w}\"" for w in _WORDS)}
           FROM fx_topic_term WHERE word IN ({", ".join(repr(w) for w in _WORDS)}) GROUP BY topic, step)
SELECT w.topic, w.step, {", ".join(f'round(w."{x}", 6) AS "{x}"' for x in _WORDS)}, round(s.pct, 6) AS _prop
FROM w LEFT JOIN (SELECT topic, step, 100 * share / sum(share) OVER (PARTITION BY topic) AS pct FROM fx_share) s ON s.topic = w.topic AND s.step = w.step""")
def q_words_with_share(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    wf = T.words_over_time(c.topic_term, _WORDS)
    return rounded(T.words_with_share(wf, c.share), *_WORDS, "_prop")
