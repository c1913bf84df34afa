"""Registered queries for model checks, sinks' frames, the report and fitting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from topicspark.operators import checks as K
from topicspark.operators import labels as L
from topicspark.operators import vocab as V
from topicspark.operators.fit import fit_topics_grid
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import Ctx, register, rounded
from topicspark.plans.catalog_compare import _DENSE, _WORDS, SIMILAR_THRESHOLD, UNIQUE_THRESHOLD
from topicspark.plans.catalog_labels import _STATIC, _TFIDF, _TV, _VEC, _cos_sql
from topicspark.plans.report import compare_report, model_report
from topicspark.sources.sinks import doc_topics_wide


@register("check_model", """
WITH ds AS (SELECT doc_id AS doc_idx, step FROM fx_corpus),
sc AS (SELECT CAST(dense_rank() OVER (ORDER BY step) - 1 AS INTEGER) AS step_idx, n AS n_docs
       FROM (SELECT step, count(*) AS n FROM fx_corpus GROUP BY step)),
nd AS (SELECT count(*) AS n FROM fx_corpus),
tt AS (SELECT topic, word_id, CAST(dense_rank() OVER (ORDER BY step) - 1 AS INTEGER) AS step_idx, prob FROM fx_topic_term),
ps AS (SELECT CAST(dense_rank() OVER (ORDER BY step) - 1 AS INTEGER) AS step_idx, n
       FROM (SELECT step, count(*) AS n FROM ds GROUP BY step)),
r AS (
  SELECT 'doc_steps_rows' AS c, (SELECT n FROM nd) AS expected, (SELECT count(*) FROM ds) AS actual
  UNION ALL SELECT 'doc_topic_rows', (SELECT n FROM nd) * 6, (SELECT count(*) FROM fx_doc_topic)
  UNION ALL SELECT 'topics_per_doc', 6, (SELECT count(DISTINCT topic) FROM fx_doc_topic)
  UNION ALL SELECT 'step_count_total', (SELECT n FROM nd), (SELECT sum(n_docs) FROM sc)
  UNION ALL SELECT 'steps_agree', (SELECT count(*) FROM sc), (SELECT count(*) FROM ps JOIN sc USING (step_idx) WHERE ps.n = sc.n_docs)
  UNION ALL SELECT 'topics_present', 6, (SELECT count(DISTINCT topic) FROM tt)
  UNION ALL SELECT 'topic_term_full', 6, (SELECT count(*) FROM (SELECT topic, count(*) AS n FROM tt GROUP BY topic)
                                          WHERE n = (SELECT count(*) FROM fx_vocab) * (SELECT count(*) FROM sc)))
SELECT c AS "check", CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, expected = actual AS ok FROM r""")
def q_check_model(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    ds = c.corpus.select(F.col("doc_id").alias("doc_idx"), "step")
    sc = V.step_counts(c.corpus).select((F.dense_rank().over(Window.orderBy("step")) - 1).cast("int").alias("step_idx"), "n_docs")
    dt = c.doc_topic.select(F.col("doc_id").alias("doc_idx"), "topic", "weight")
    # steps are ranked on their distinct values (one row each), then joined
    steps = c.topic_term.select("step").distinct().withColumn("step_idx", (F.dense_rank().over(Window.orderBy("step")) - 1).cast("int"))
    tt = c.topic_term.join(steps, "step").select("topic", "word_id", "step_idx", "prob")
    n_docs = c.corpus.select(F.count(F.lit(1))).scalar()
    return K.check_model(ds, sc, dt, tt, c.vocab, n_docs, fx.N_TOPICS)


@register("write_doc_topics", "SELECT doc_id, step, " + ", ".join(
    f"first(weight) FILTER (WHERE topic = {i}) AS \"{i}\"" for i in range(fx.N_TOPICS)) + " FROM fx_doc_topic GROUP BY doc_id, step")
def q_write_doc_topics(spark, sf_dir):
    return doc_topics_wide(Ctx(spark, sf_dir).doc_topic, fx.N_TOPICS)


_LIST = "string_agg(label || ':' || CAST(round(score, 2) AS VARCHAR), ', ' ORDER BY rank)"


@register("model_report", "WITH" + _VEC + "," + _TFIDF + _TV + "," + _cos_sql("tv", "topic") + f""",
er AS (SELECT topic, label, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC NULLS LAST, label) AS rank FROM es),
tl4 AS (SELECT topic, {_LIST} AS tfidf_labels FROM ranked WHERE rank <= 4 GROUP BY topic),
el4 AS (SELECT topic, {_LIST} AS emb_labels FROM er WHERE rank <= 4 GROUP BY topic),
tws AS (SELECT topic, string_agg(word, ' ' ORDER BY rank) AS top_words FROM tw GROUP BY topic),
top AS (SELECT topic, step, word, row_number() OVER (PARTITION BY topic, step ORDER BY prob DESC, word_id DESC) AS rank
        FROM fx_topic_term QUALIFY rank <= 30),
f AS (SELECT topic, step, string_agg(word, ' ' ORDER BY rank) AS step_words FROM top GROUP BY topic, step)
SELECT s.topic, s.step, printf('%05.3f', s.share) AS share, coalesce(f.step_words, '') AS step_words,
       tws.top_words, tl4.tfidf_labels, el4.emb_labels
FROM fx_share s LEFT JOIN f USING (topic, step) LEFT JOIN tws USING (topic) LEFT JOIN tl4 USING (topic) LEFT JOIN el4 USING (topic)""")
def q_model_report(spark, sf_dir):
    """The report's step rows next to its topic rows."""
    c = Ctx(spark, sf_dir)
    r = model_report(c.topic_term, c.share, c.thesaurus, c.word_vec)
    return r["topic_steps"].withColumnRenamed("top_words", "step_words").join(r["topics"], "topic", "left")


@register("compare_report", "WITH " + _DENSE + "," + _WORDS + ", " + _STATIC.strip().removeprefix("WITH tw AS").replace(
    "(SELECT model, topic, word, prob, row_number()", "stw AS (SELECT model, topic, word, prob, row_number()", 1).replace(
    "FROM tw)", "FROM stw)").replace("FROM tw ", "FROM stw ").split("SELECT model, topic, CAST(rank")[0].rstrip() + f""",
best AS (SELECT model, topic, label FROM ranked WHERE rank = 1),
nm AS (SELECT tw.model, tw.topic, tw.words, best.label FROM tw LEFT JOIN best USING (model, topic)),
u AS (SELECT 1 AS side, topic_1 AS topic, max(similarity) AS max_sim FROM sim GROUP BY topic_1
      UNION ALL SELECT 2, topic_2, max(similarity) FROM sim GROUP BY topic_2)
SELECT 'similar' AS part, CAST(topic_1 AS VARCHAR) || '-' || CAST(topic_2 AS VARCHAR) AS topics, round(similarity, 6) AS value, a.words || ' | ' || b.words AS words,
       a.label || ' | ' || b.label AS label
FROM sim JOIN nm a ON a.model = 0 AND a.topic = topic_1 JOIN nm b ON b.model = 1 AND b.topic = topic_2 WHERE similarity > {SIMILAR_THRESHOLD}
UNION ALL
SELECT 'unique', CAST(u.side AS VARCHAR) || ':' || CAST(u.topic AS VARCHAR), round(u.max_sim, 6), nm.words, nm.label
FROM u JOIN nm ON nm.model = u.side - 1 AND nm.topic = u.topic WHERE u.max_sim <= {UNIQUE_THRESHOLD}
UNION ALL
SELECT 'heatmap', regexp_replace(a.label, '\\d{{4}} ', '') || CAST(topic_1 AS VARCHAR), round(sum(similarity), 6), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
FROM sim JOIN nm a ON a.model = 0 AND a.topic = topic_1 GROUP BY a.label, topic_1""")
def q_compare_report(spark, sf_dir):
    """All three frames of the report as rows; a heatmap row as its axis name and the sum of its cells."""
    c = Ctx(spark, sf_dir)
    r = compare_report(c.model, 0, 1, SIMILAR_THRESHOLD, UNIQUE_THRESHOLD, thes=c.thesaurus)
    both = lambda a, b: F.concat(F.col(a), F.lit(" | "), F.col(b))
    similar = r["similar_topics"].select(F.lit("similar").alias("part"), F.concat_ws("-", F.col("topic_1").cast("string"), F.col("topic_2").cast("string")).alias("topics"),
                                         F.col("similarity").alias("value"), both("words_1", "words_2").alias("words"), both("label_1", "label_2").alias("label"))
    unique = r["unique_topics"].select(F.lit("unique").alias("part"), F.concat_ws(":", F.col("side").cast("string"), F.col("topic").cast("string")).alias("topics"),
                                       F.col("max_sim").alias("value"), "words", "label")
    heat = r["heatmap"].drop("pair")
    cells = [F.coalesce(F.col(f"`{x}`"), F.lit(0.0)) for x in heat.columns if x != "name_1"]
    heat = heat.select(F.lit("heatmap").alias("part"), F.col("name_1").alias("topics"), sum(cells, F.lit(0.0)).alias("value"),
                       F.lit(None).cast("string").alias("words"), F.lit(None).cast("string").alias("label"))
    return rounded(similar.unionByName(unique).unionByName(heat), "value")


@register("topic_label_shares", "WITH " + _TFIDF + """
SELECT s.topic, r.label, s.step, round(s.share, 6) AS share
FROM fx_share s JOIN (SELECT topic, label FROM ranked WHERE rank = 1) r USING (topic)""")
def q_topic_label_shares(spark, sf_dir):
    """Flagship: the best TF-IDF label of each topic with the topic's share per step."""
    c = Ctx(spark, sf_dir)
    best = L.label_model_topics(c.topic_term, c.share, c.thesaurus, score_type="tfidf", top_n=1)
    j = c.share.join(best.select("topic", "label"), "topic")
    return rounded(j.select("topic", "label", "step", "share"), "share")


def _fitted(spark, sf_dir, step=None):
    """A two-row grid over the documents' vocabulary words; with ``step``, along the steps."""
    c = Ctx(spark, sf_dir)
    docs = fx.fx_vocab_docs(c.corpus, c.vocab)
    runs = [{"topics": 4, "alpha": 0.1, "topic_var": 0.05}, {"topics": 6, "alpha": 0.01, "topic_var": 0.05}]
    return fit_topics_grid(docs, runs, max_iter=5 if step is None else 2, step=step)


@register("fit_topics_grid")
def q_fit_topics_grid(spark, sf_dir):
    return _fitted(spark, sf_dir)[0]


_GRID = "(VALUES ('k4_a0.1_var0.05', 4), ('k6_a0.01_var0.05', 6)) r(model, k)"


@register("fit_topics_grid_check", f"""
SELECT r.model, CAST(t.topic AS INTEGER) AS topic, (SELECT count(*) FROM fx_vocab) AS n_words, 1.0 AS prob_sum
FROM {_GRID}, LATERAL (SELECT unnest(range(r.k)) AS topic) t""")
def q_fit_topics_grid_check(spark, sf_dir):
    """Every topic of every run has each vocabulary word once, with probabilities that add up to 1."""
    tt = _fitted(spark, sf_dir)[0]
    return tt.groupBy("model", "topic").agg(F.countDistinct("word").alias("n_words"), F.round(F.sum("prob"), 6).alias("prob_sum"))


@register("fit_topics_steps_check", f"""
SELECT r.model, CAST(t.topic AS INTEGER) AS topic, s.step, (SELECT count(*) FROM fx_vocab) AS n_words, 1.0 AS prob_sum
FROM {_GRID}, LATERAL (SELECT unnest(range(r.k)) AS topic) t, (SELECT DISTINCT step FROM fx_tokens JOIN fx_vocab ON word = w) s""")
def q_fit_topics_steps_check(spark, sf_dir):
    """With a chain along the steps: in every step each topic has each vocabulary word once, with probabilities that add up to 1."""
    tt = _fitted(spark, sf_dir, "step")[0]
    return tt.groupBy("model", "topic", "step").agg(F.countDistinct("word").alias("n_words"), F.round(F.sum("prob"), 6).alias("prob_sum"))
