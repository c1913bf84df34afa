"""Registered queries for automatic labelling and named topic shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.functions import TOKEN_PATTERN
from topicspark.operators import labels as L
from topicspark.operators import topics as T
from topicspark.plans.catalog import Ctx, register, rounded

P = TOKEN_PATTERN.replace("'", "''")
_NUMS = ", ".join("'" + w + "'" for w in __import__("topicspark.operators.text", fromlist=["x"]).NUMBER_WORDS)


def _tok_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{P}'), lambda x: x <> '')"


# top 10 share-weighted words per topic (rescaled), as in top_words_weighted
_TW = """
tw AS (SELECT topic, CAST(rank AS INTEGER) AS rank, word_id, word, prob / sum(prob) OVER (PARTITION BY topic) AS prob
       FROM (SELECT t.topic, t.word_id, t.word, sum(s.share * t.prob) AS prob,
                    row_number() OVER (PARTITION BY t.topic ORDER BY sum(s.share * t.prob) DESC, t.word_id DESC) AS rank
             FROM fx_topic_term t JOIN fx_share s ON s.topic = t.topic AND s.step = t.step
             GROUP BY t.topic, t.word_id, t.word QUALIFY rank <= 10))"""

_TFIDF = _TW + f""",
twk AS (SELECT *, array_to_string({_tok_sql("replace(word, '_', ' ')")}, ' ') AS term FROM tw),
ld AS (SELECT label, flatten(list(toks ORDER BY pos)) AS toks, CAST(len(flatten(list(toks ORDER BY pos))) AS INTEGER) AS doc_len
       FROM (SELECT pos, lower(label) AS label, {_tok_sql("phrase")} AS toks FROM fx_thesaurus) GROUP BY label),
tk AS (SELECT DISTINCT term FROM twk WHERE term <> ''),
tl AS (SELECT DISTINCT len(string_split(term, ' ')) AS n FROM tk),
lw AS (SELECT ld.label, array_to_string(ld.toks[i + 1 : i + tl.n], ' ') AS term
       FROM ld, tl, unnest(range(0, len(ld.toks) - tl.n + 1)) AS r(i)),
cnt AS (SELECT term, label, count(*) AS cnt FROM lw JOIN tk USING (term) GROUP BY ALL),
nd AS (SELECT term, count(*) AS nd FROM cnt GROUP BY term),
tfidf AS (SELECT c.term, c.label, c.cnt, (c.cnt / ld.doc_len) * ln((SELECT count(*) FROM ld) / nd.nd) AS tfidf
          FROM cnt c JOIN nd USING (term) JOIN ld USING (label)),
sc AS (SELECT twk.topic, t.label, sum(twk.prob * t.cnt * t.tfidf) AS score FROM twk JOIN tfidf t USING (term) GROUP BY ALL),
allp AS (SELECT tp.topic, l.label, coalesce(sc.score, 0.0) AS score
         FROM (SELECT DISTINCT topic FROM tw) tp CROSS JOIN (SELECT DISTINCT lower(label) AS label FROM fx_thesaurus) l
         LEFT JOIN sc USING (topic, label)),
ranked AS (SELECT topic, label, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, label) AS rank FROM allp)"""


def _tw(c: Ctx):
    return T.top_words(c.topic_term, c.share, n=10)


@register("read_thesaurus", "SELECT p_partkey AS pos, p_name AS phrase, p_type AS label FROM part")
def q_read_thesaurus(spark, sf_dir):
    return L.read_thesaurus(Ctx(spark, sf_dir).t("part"), "p_name", "p_type", "p_partkey")


@register("label_docs", f"""
WITH d AS (SELECT label, flatten(list(toks ORDER BY pos)) AS toks
           FROM (SELECT p_partkey AS pos, lower(p_type) AS label, {_tok_sql("p_name")} AS toks FROM part) GROUP BY label)
SELECT label, unnest(range(len(toks))) AS g, unnest(toks) AS tok, len(toks) AS doc_len FROM d""")
def q_label_docs(spark, sf_dir):
    thes = L.read_thesaurus(Ctx(spark, sf_dir).t("part"), "p_name", "p_type", "p_partkey")
    tok, lens = L.label_docs(thes)
    return tok.join(lens, "label").select("label", "g", "tok", "doc_len")


@register("preprocess_thesaurus", rf"""
WITH s AS (SELECT p_partkey, p_type, list_filter(regexp_split_to_array(
             regexp_replace(p_name, '(https?://|www\.)\S+', ' ', 'g'), '[.!?]+\s+|\n+'), lambda x: trim(x) <> '') AS ss
           FROM part)
SELECT p_partkey AS pos, array_to_string(flatten(list_transform(ss, lambda y: list_filter({_tok_sql("y")},
         lambda x: NOT regexp_matches(x, '\p{{N}}') AND x NOT IN ({_NUMS}) AND length(x) > 1))), ' ') AS phrase,
       p_type AS label FROM s""")
def q_preprocess_thesaurus(spark, sf_dir):
    thes = L.read_thesaurus(Ctx(spark, sf_dir).t("part"), "p_name", "p_type", "p_partkey")
    return L.preprocess_thesaurus(thes, stopwords=[])


@register("unjoin_terms", "SELECT p_partkey, replace(p_name, ' ', '_') AS term, replace(replace(p_name, ' ', '_'), '_', ' ') AS unjoined FROM part")
def q_unjoin_terms(spark, sf_dir):
    from topicspark.functions import unjoin_terms
    p = Ctx(spark, sf_dir).t("part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("term"))
    return p.withColumn("unjoined", unjoin_terms("term"))


@register("term_label_tfidf", "WITH " + _TFIDF + "\nSELECT term, label, cnt, round(tfidf, 6) AS tfidf FROM tfidf")
def q_term_label_tfidf(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    tw = L.term_keys(_tw(c))
    return rounded(L.term_label_tfidf(tw.select("term").distinct(), c.thesaurus), "tfidf")


@register("label_scores_tfidf", "WITH " + _TFIDF + "\nSELECT topic, label, round(score, 6) AS score FROM allp")
def q_label_scores_tfidf(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(L.label_scores_tfidf(_tw(c), c.thesaurus), "score")


@register("top_labels", "WITH " + _TFIDF + """
SELECT topic, CAST(rank AS INTEGER) AS rank, label, round(score, 2) AS score FROM ranked WHERE rank <= 1""")
def q_top_labels(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return L.label_topics(_tw(c), c.thesaurus, top_n=1, score_type="tfidf")


@register("label_model_topics", "WITH " + _TFIDF + """
SELECT topic, CAST(rank AS INTEGER) AS rank, label, round(score, 2) AS score FROM ranked WHERE rank <= 4""")
def q_label_model_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return L.label_model_topics(c.topic_term, c.share, c.thesaurus, score_type="tfidf")


_STATIC = f"""
WITH tw AS (SELECT model, topic, word, prob, row_number() OVER (PARTITION BY model, topic ORDER BY prob DESC, word_id DESC) AS rank
            FROM fx_model QUALIFY rank <= 10),
twk AS (SELECT *, array_to_string({_tok_sql("replace(word, '_', ' ')")}, ' ') AS term FROM tw),
ld AS (SELECT label, flatten(list(toks ORDER BY pos)) AS toks, CAST(len(flatten(list(toks ORDER BY pos))) AS INTEGER) AS doc_len
       FROM (SELECT pos, lower(label) AS label, {_tok_sql("phrase")} AS toks FROM fx_thesaurus) GROUP BY label),
tk AS (SELECT DISTINCT term FROM twk WHERE term <> ''),
tl AS (SELECT DISTINCT len(string_split(term, ' ')) AS n FROM tk),
lw AS (SELECT ld.label, array_to_string(ld.toks[i + 1 : i + tl.n], ' ') AS term
       FROM ld, tl, unnest(range(0, len(ld.toks) - tl.n + 1)) AS r(i)),
cnt AS (SELECT term, label, count(*) AS cnt FROM lw JOIN tk USING (term) GROUP BY ALL),
nd AS (SELECT term, count(*) AS nd FROM cnt GROUP BY term),
tfidf AS (SELECT c.term, c.label, c.cnt, (c.cnt / ld.doc_len) * ln((SELECT count(*) FROM ld) / nd.nd) AS tfidf
          FROM cnt c JOIN nd USING (term) JOIN ld USING (label)),
sc AS (SELECT twk.model, twk.topic, t.label, sum(twk.prob * t.cnt * t.tfidf) AS score FROM twk JOIN tfidf t USING (term) GROUP BY ALL),
allp AS (SELECT tp.model, tp.topic, l.label, coalesce(sc.score, 0.0) AS score
         FROM (SELECT DISTINCT model, topic FROM tw) tp CROSS JOIN (SELECT DISTINCT lower(label) AS label FROM fx_thesaurus) l
         LEFT JOIN sc USING (model, topic, label)),
ranked AS (SELECT model, topic, label, score, row_number() OVER (PARTITION BY model, topic ORDER BY score DESC, label) AS rank FROM allp)
SELECT model, topic, CAST(rank AS INTEGER) AS rank, label, round(score, 2) AS score FROM ranked WHERE rank <= 4"""


@register("label_static_topics", _STATIC)
def q_label_static_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return L.label_static_topics(c.model, c.thesaurus, score_type="tfidf", keys=("model", "topic"))


# ------------------------------------------------------------------ vectors

_VEC = f"""
wv AS (SELECT word, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS dim, unnest(vec) AS v FROM fx_word_vec),
pv AS (SELECT t.pos, t.label, wv.dim, avg(wv.v) AS v
       FROM (SELECT pos, lower(label) AS label, unnest({_tok_sql("phrase")}) AS word FROM fx_thesaurus) t
       JOIN wv USING (word) GROUP BY ALL),
lv AS (SELECT label, dim, avg(v) AS v FROM pv GROUP BY ALL)"""


def _cos_sql(tv: str, keys: str) -> str:
    return f"""
dot AS (SELECT {", ".join("a." + k for k in keys.split(", "))}, b.label, sum(a.v * b.v) AS d FROM {tv} a JOIN lv b USING (dim) GROUP BY ALL),
na AS (SELECT {keys}, sqrt(sum(v * v)) AS na FROM {tv} GROUP BY ALL),
nb AS (SELECT label, sqrt(sum(v * v)) AS nb FROM lv GROUP BY ALL),
es AS (SELECT dot.*, d / (na * nb) AS score FROM dot JOIN na USING ({keys}) JOIN nb USING (label))"""


_TV = f""",
tv AS (SELECT topic, dim, avg(prob * wv) AS v FROM (
         SELECT t.topic, t.word, t.prob, wv.dim, avg(wv.v) AS wv
         FROM (SELECT topic, word, prob, unnest({_tok_sql("replace(word, '_', ' ')")}) AS tok FROM tw) t
         JOIN wv ON wv.word = t.tok GROUP BY ALL) GROUP BY ALL)"""


@register("phrase_vectors", "WITH" + _VEC + "\nSELECT pos, label, dim, round(v, 6) AS v FROM pv")
def q_phrase_vectors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(L.phrase_vectors(c.thesaurus, c.word_vec), "v")


@register("label_phrase_map", f"""
WITH t AS (SELECT pos, lower(label) AS label, lower(phrase) AS phrase, unnest({_tok_sql("phrase")}) AS word FROM fx_thesaurus)
SELECT DISTINCT label, pos, phrase FROM t WHERE word IN (SELECT word FROM fx_word_vec)""")
def q_label_phrase_map(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return L.label_phrase_map(c.thesaurus, c.word_vec)


@register("label_vectors", "WITH" + _VEC + "\nSELECT label, dim, round(v, 6) AS v FROM lv")
def q_label_vectors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(L.label_vectors(L.phrase_vectors(c.thesaurus, c.word_vec)), "v")


@register("topic_vectors", "WITH" + _VEC + "," + _TW + _TV + "\nSELECT topic, dim, round(v, 6) AS v FROM tv")
def q_topic_vectors(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(L.topic_vectors(_tw(c), c.word_vec), "v")


@register("label_scores_embedding", "WITH" + _VEC + "," + _TW + _TV + "," + _cos_sql("tv", "topic")
          + "\nSELECT topic, label, round(score, 6) AS score FROM es")
def q_label_scores_embedding(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(L.label_scores_embedding(_tw(c), c.thesaurus, c.word_vec), "score")


@register("label_topics", "WITH" + _VEC + "," + _TW + _TV + "," + _cos_sql("tv", "topic") + """
SELECT topic, CAST(rank AS INTEGER) AS rank, label, round(score, 2) AS score
FROM (SELECT topic, label, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC NULLS LAST, label) AS rank FROM es)
WHERE rank <= 1""")
def q_label_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return L.label_topics(_tw(c), c.thesaurus, c.word_vec, top_n=1, score_type="embedding")


_OTW = """,
tw AS (SELECT topic, step, word_id, word, prob / sum(prob) OVER (PARTITION BY topic, step) AS prob
       FROM (SELECT topic, step, word_id, word, prob,
                    row_number() OVER (PARTITION BY topic, step ORDER BY prob DESC, word_id DESC) AS rank
             FROM fx_topic_term QUALIFY rank <= 10))"""

_OTV = f""",
tv AS (SELECT topic, step, dim, avg(prob * wv) AS v FROM (
         SELECT t.topic, t.step, t.word, t.prob, wv.dim, avg(wv.v) AS wv
         FROM (SELECT topic, step, word, prob, unnest({_tok_sql("replace(word, '_', ' ')")}) AS tok FROM tw) t
         JOIN wv ON wv.word = t.tok GROUP BY ALL) GROUP BY ALL)"""

_LSOT = ("WITH" + _VEC + _OTW + _OTV + "," + _cos_sql("tv", "topic, step")
         + ",\nlsot AS (SELECT topic, step, label, score / sum(score) OVER (PARTITION BY topic, step) AS value FROM es)")


@register("label_share_over_time", _LSOT + "\nSELECT topic, step, label, round(value, 6) AS value FROM lsot")
def q_label_share_over_time(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(L.label_share_over_time(c.topic_term, c.thesaurus, c.word_vec), "value")


_CHOSEN = ["6611 A", "6626 F"]


@register("chosen_labels_over_time", _LSOT + """
SELECT topic, step, regexp_replace(label, '\\d{4} ', '', 'g') AS label, round(value, 6) AS value
FROM lsot WHERE label IN ('6611 a', '6626 f')""")
def q_chosen_labels_over_time(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    ls = L.label_share_over_time(c.topic_term, c.thesaurus, c.word_vec)
    return rounded(L.chosen_labels_over_time(ls, _CHOSEN), "value")


# ------------------------------------------------------------------ named shares (2.7)

@register("topic_share_names", "WITH " + _TFIDF + """
SELECT s.step, s.topic, round(s.share, 6) AS share,
       regexp_replace(r.label, '^\\d{2,4} ', '') || '(' || CAST(s.topic AS VARCHAR) || ')' AS topic_name
FROM fx_share s LEFT JOIN (SELECT topic, label FROM ranked WHERE rank = 1) r USING (topic)""")
def q_topic_share_names(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    labels = L.label_model_topics(c.topic_term, c.share, c.thesaurus, score_type="tfidf")
    return rounded(T.topic_share_long(c.share, labels), "share")


@register("merge_topics_by_label", "WITH " + _TFIDF + """
SELECT s.step, regexp_replace(r.label, '^\\d{2,4} ', '') AS topic_name, round(sum(s.share), 6) AS share
FROM fx_share s JOIN (SELECT topic, label FROM ranked WHERE rank = 1) r USING (topic) GROUP BY ALL""")
def q_merge_topics_by_label(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    labels = L.label_model_topics(c.topic_term, c.share, c.thesaurus, score_type="tfidf")
    return rounded(T.merge_topics_by_label(c.share, labels), "share")

