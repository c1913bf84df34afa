"""Registered queries for thesaurus normalisation, merging and model comparison
(SURVEY 2.3 label rows, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.operators import compare as C
from topicspark.operators import labels as L
from topicspark.operators import thesaurus as H
from topicspark.operators import topics as T
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import Ctx, register, rounded


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_q(k)} THEN {_q(v)}" for k, v in mapping.items()) + f" ELSE {col} END"


def _norm_sql(col: str, remap: bool = True) -> str:
    v = f"lower({col})"
    if remap:
        v = _case(v, H.LABEL_REMAPPING)
    return _case(f"({v})", H.LABEL_CORRECTIONS)


_NORM = f"nt AS (SELECT pos, phrase, {_norm_sql('MT')} AS MT, {_norm_sql('domain')} AS domain FROM fx_eurovoc)"
_NORM_NOREMAP = f"nt AS (SELECT pos, phrase, {_norm_sql('MT', False)} AS MT, {_norm_sql('domain', False)} AS domain FROM fx_eurovoc)"

# Fixed test values: whitelisted labels (all present in the fixture thesaurus).
WHITELIST = ["2016 business operations and trade", "6626 renewable energy",
             "6621 electrical and nuclear industries", "0821 defence"]


def _normalised(spark, sf_dir, remap=True):
    return H.normalise_labels(fx.fx_eurovoc(spark, sf_dir), remap=remap)


@register("normalise_labels", f"WITH {_NORM} SELECT pos, phrase, MT, domain FROM nt")
def q_normalise_labels(spark, sf_dir):
    return _normalised(spark, sf_dir)


@register("whitelist_labels", f"""
WITH {_NORM}
SELECT pos, phrase, MT, domain, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS "index"
FROM nt WHERE MT IN ({", ".join(_q(w) for w in WHITELIST)})""")
def q_whitelist_labels(spark, sf_dir):
    wl = spark.createDataFrame([(w,) for w in WHITELIST], "label string")
    return H.whitelist_labels(_normalised(spark, sf_dir), wl, "MT")


@register("strip_label_code", f"""
WITH {_NORM} SELECT pos, regexp_replace(MT, '^\\d{{2,4}} ', '') AS label FROM nt""")
def q_strip_label_code(spark, sf_dir):
    n = _normalised(spark, sf_dir)
    return n.select("pos", H.strip_label_code("MT").alias("label"))


_MERGE_CAT = f"""
WITH {_NORM_NOREMAP},
labs AS (SELECT DISTINCT MT AS label, regexp_extract(MT, '^(\\d{{2}})', 1) AS cat FROM nt),
reps AS (SELECT cat, label AS merged_into FROM labs WHERE lower(label) IN ({", ".join(_q(x.lower()) for x in H.CATEGORY_NAMES)})),
steps AS (SELECT 0 AS iteration, reps.merged_into, labs.label FROM labs JOIN reps USING (cat)
          WHERE labs.cat <> '' AND NOT starts_with(labs.cat, '66'))"""


@register("merge_by_category", _MERGE_CAT + " SELECT iteration, merged_into, label FROM steps")
def q_merge_by_category(spark, sf_dir):
    return H.merge_by_category(_normalised(spark, sf_dir, remap=False), "MT")


@register("apply_merge_steps", _MERGE_CAT + """
SELECT nt.pos, coalesce(steps.merged_into, nt.MT) AS MT FROM nt LEFT JOIN steps ON steps.label = nt.MT""")
def q_apply_merge_steps(spark, sf_dir):
    n = _normalised(spark, sf_dir, remap=False)
    steps = H.merge_by_category(n, "MT")
    return H.apply_merge_steps(n, steps, "MT").select("pos", "MT")


# ------------------------------------------------------------------ label vectors from embeddings

_LV = """
lvec AS (SELECT 'l' || CAST(label AS VARCHAR) AS label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
                unnest(embedding) AS v FROM embeddings),
lv AS (SELECT label, dim, avg(v) AS v FROM lvec GROUP BY ALL),
ln AS (SELECT label, sqrt(sum(v * v)) AS n FROM lv GROUP BY ALL),
sim AS (SELECT a.label AS l1, b.label AS l2, sum(a.v * b.v) / (n1.n * n2.n) AS similarity
        FROM lv a JOIN lv b USING (dim) JOIN ln n1 ON n1.label = a.label JOIN ln n2 ON n2.label = b.label
        WHERE a.label < b.label GROUP BY a.label, b.label, n1.n, n2.n)"""

PAIR_THRESHOLD = 0.2


def _label_vecs(spark, sf_dir):
    vp = fx.fx_vec_phrases(spark, sf_dir)
    pv = vp.select("phrase", F.lower("label").alias("label"), F.posexplode("vec").alias("dim", "v"))
    return L.label_vectors(pv)


@register("label_similarity", "WITH " + _LV + " SELECT l1, l2, round(similarity, 6) AS similarity FROM sim")
def q_label_similarity(spark, sf_dir):
    return rounded(H.label_pairs_similarity(_label_vecs(spark, sf_dir)), "similarity")


@register("similar_label_pairs", "WITH " + _LV + f" SELECT l1, l2 FROM sim WHERE similarity >= {PAIR_THRESHOLD}")
def q_similar_label_pairs(spark, sf_dir):
    return H.similar_labels(_label_vecs(spark, sf_dir), PAIR_THRESHOLD)


@register("merge_plan", "WITH RECURSIVE " + _LV + f""",
pairs AS (SELECT l1, l2 FROM sim WHERE similarity >= {PAIR_THRESHOLD}),
e AS (SELECT l1 AS a, l2 AS b FROM pairs UNION SELECT l2, l1 FROM pairs),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a AS label, min(b) AS comp FROM (SELECT a, b FROM reach UNION SELECT a, a FROM e) GROUP BY a),
freq AS (SELECT label, count(*) AS freq FROM (SELECT l1 AS label FROM pairs UNION ALL SELECT l2 FROM pairs) GROUP BY label),
cf AS (SELECT comp.label, comp.comp, freq.freq FROM comp JOIN freq USING (label)),
rep AS (SELECT comp, label AS merged_into FROM (
          SELECT comp, label, row_number() OVER (PARTITION BY comp ORDER BY freq DESC, label) AS r FROM cf) WHERE r = 1),
sz AS (SELECT comp, count(*) AS group_size FROM cf GROUP BY comp)
SELECT cf.label, rep.merged_into, sz.group_size FROM cf JOIN rep USING (comp) JOIN sz USING (comp)""")
def q_merge_plan(spark, sf_dir):
    return H.merge_plan(H.similar_labels(_label_vecs(spark, sf_dir), PAIR_THRESHOLD).checkpoint(eager=True))


@register("merge_labels")
def q_merge_labels(spark, sf_dir):
    """Iterative merge of the embedding labels (phrase = embedding row)."""
    vp = fx.fx_vec_phrases(spark, sf_dir)
    thes = vp.select(F.col("phrase").cast("long").alias("pos"), "phrase", "label")
    vectors = vp.select(F.col("phrase").alias("word"), "vec")
    steps, _ = H.merge_labels(thes, vectors, threshold=PAIR_THRESHOLD, max_iterations=4)
    return steps


# ------------------------------------------------------------------ model comparison

_DENSE = """
md AS (SELECT * FROM fx_model),
w AS (SELECT DISTINCT word FROM md),
t AS (SELECT DISTINCT model, topic FROM md),
dense AS (SELECT t.model, t.topic, w.word, coalesce(md.prob, 0.0) AS x FROM t CROSS JOIN w LEFT JOIN md USING (model, topic, word)),
mean AS (SELECT word, avg(x) AS mu FROM dense GROUP BY word),
c AS (SELECT d.model, d.topic, d.word, d.x - mean.mu AS x FROM dense d JOIN mean USING (word)),
dot AS (SELECT a.topic AS topic_1, b.topic AS topic_2, sum(a.x * b.x) AS d
        FROM (SELECT * FROM c WHERE model = 0) a JOIN (SELECT * FROM c WHERE model = 1) b USING (word) GROUP BY ALL),
nrm AS (SELECT model, topic, sqrt(sum(x * x)) AS n FROM c GROUP BY ALL),
sim AS (SELECT topic_1, topic_2, d / (n1.n * n2.n) AS similarity FROM dot
        JOIN nrm n1 ON n1.model = 0 AND n1.topic = topic_1 JOIN nrm n2 ON n2.model = 1 AND n2.topic = topic_2)"""


def _sim(c: Ctx):
    return C.topic_similarity(c.model, 0, 1)


@register("common_vocab", """
WITH u AS (SELECT DISTINCT word FROM fx_model)
SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS cid, word FROM u""")
def q_common_vocab(spark, sf_dir):
    m = Ctx(spark, sf_dir).model
    return C.common_vocab(m.filter(F.col("model") == 0), m.filter(F.col("model") == 1)).select("cid", "word")


@register("align_models", """
WITH u AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS cid, word FROM (SELECT DISTINCT word FROM fx_model))
SELECT m.model, m.topic, u.cid, m.word, round(m.prob, 6) AS prob FROM fx_model m JOIN u USING (word)""")
def q_align_models(spark, sf_dir):
    m = Ctx(spark, sf_dir).model
    cv = C.common_vocab(m.filter(F.col("model") == 0), m.filter(F.col("model") == 1))
    return rounded(C.align_models(m, cv), "prob")


@register("centre_topics", "WITH " + _DENSE + " SELECT word, round(mu, 6) AS m FROM mean")
def q_centre_topics(spark, sf_dir):
    return rounded(C.centre_topics(Ctx(spark, sf_dir).model), "m")


@register("topic_similarity", "WITH " + _DENSE + " SELECT topic_1, topic_2, round(similarity, 6) AS similarity FROM sim")
def q_topic_similarity(spark, sf_dir):
    return rounded(_sim(Ctx(spark, sf_dir)), "similarity")


@register("similarity_matrix", "WITH " + _DENSE + """
SELECT CAST(topic_1 AS VARCHAR) AS name_1, """ + ", ".join(
    f"round(first(similarity) FILTER (WHERE topic_2 = {i}), 6) AS \"{i}\"" for i in range(6)) + """
FROM sim GROUP BY topic_1""")
def q_similarity_matrix(spark, sf_dir):
    m = C.similarity_matrix(_sim(Ctx(spark, sf_dir)), order=[str(i) for i in range(6)])
    return rounded(m, *[str(i) for i in range(6)])


_WORDS = """
tw AS (SELECT model, topic, string_agg(word, ' ' ORDER BY rank) AS words FROM (
         SELECT model, topic, word, row_number() OVER (PARTITION BY model, topic ORDER BY prob DESC, word_id DESC) AS rank
         FROM fx_model QUALIFY rank <= 10) GROUP BY model, topic)"""

SIMILAR_THRESHOLD = 0.5
UNIQUE_THRESHOLD = 0.25


def _words(c: Ctx, model: int):
    tw = T.top_words_static(c.model.filter(F.col("model") == model), n=10, with_prob=False, keys=("topic",))
    return tw.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))),
                                                            lambda x: x["word"]), " ").alias("words"))


@register("similar_topics", "WITH " + _DENSE + "," + _WORDS + f"""
SELECT sim.topic_1, sim.topic_2, round(sim.similarity, 6) AS similarity, a.words AS words_1, b.words AS words_2
FROM sim JOIN tw a ON a.model = 0 AND a.topic = sim.topic_1 JOIN tw b ON b.model = 1 AND b.topic = sim.topic_2
WHERE sim.similarity > {SIMILAR_THRESHOLD}""")
def q_similar_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(C.similar_topics(_sim(c), _words(c, 0), _words(c, 1), SIMILAR_THRESHOLD), "similarity")


@register("unique_topics", "WITH " + _DENSE + "," + _WORDS + f""",
u AS (SELECT 1 AS side, topic_1 AS topic, max(similarity) AS max_sim FROM sim GROUP BY topic_1
      UNION ALL SELECT 2, topic_2, max(similarity) FROM sim GROUP BY topic_2)
SELECT u.side, u.topic, round(u.max_sim, 6) AS max_sim, tw.words FROM u JOIN tw ON tw.model = u.side - 1 AND tw.topic = u.topic
WHERE u.max_sim <= {UNIQUE_THRESHOLD}""")
def q_unique_topics(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    u = C.unique_topics(_sim(c), UNIQUE_THRESHOLD)
    w = _words(c, 0).withColumn("side", F.lit(1)).unionByName(_words(c, 1).withColumn("side", F.lit(2)))
    return rounded(u.join(w, ["side", "topic"]), "max_sim")


@register("compare_all_models", """
WITH md AS (SELECT * FROM fx_model3),
pairs AS (SELECT a.model AS model_1, b.model AS model_2 FROM (SELECT DISTINCT model FROM md) a, (SELECT DISTINCT model FROM md) b
          WHERE a.model < b.model),
w AS (SELECT DISTINCT p.model_1, p.model_2, md.word FROM pairs p JOIN md ON md.model IN (p.model_1, p.model_2)),
t AS (SELECT DISTINCT p.model_1, p.model_2, md.model, md.topic FROM pairs p JOIN md ON md.model IN (p.model_1, p.model_2)),
dense AS (SELECT t.model_1, t.model_2, t.model, t.topic, w.word, coalesce(md.prob, 0.0) AS x
          FROM t JOIN w USING (model_1, model_2) LEFT JOIN md ON md.model = t.model AND md.topic = t.topic AND md.word = w.word),
mean AS (SELECT model_1, model_2, word, avg(x) AS mu FROM dense GROUP BY ALL),
c AS (SELECT d.model_1, d.model_2, d.model, d.topic, d.word, d.x - mean.mu AS x FROM dense d JOIN mean USING (model_1, model_2, word)),
dot AS (SELECT a.model_1, a.model_2, a.topic AS topic_1, b.topic AS topic_2, sum(a.x * b.x) AS d
        FROM c a JOIN c b ON a.model_1 = b.model_1 AND a.model_2 = b.model_2 AND a.word = b.word
        WHERE a.model = a.model_1 AND b.model = b.model_2 GROUP BY ALL),
nrm AS (SELECT model_1, model_2, model, topic, sqrt(sum(x * x)) AS n FROM c GROUP BY ALL)
SELECT dot.model_1, dot.model_2, topic_1, topic_2, round(d / (n1.n * n2.n), 6) AS similarity FROM dot
JOIN nrm n1 ON n1.model_1 = dot.model_1 AND n1.model_2 = dot.model_2 AND n1.model = dot.model_1 AND n1.topic = topic_1
JOIN nrm n2 ON n2.model_1 = dot.model_1 AND n2.model_2 = dot.model_2 AND n2.model = dot.model_2 AND n2.topic = topic_2""")
def q_compare_all_models(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    return rounded(C.compare_all_models(c.model3), "similarity")


@register("vector_similarity", """
WITH lvec AS (SELECT 'l' || CAST(label AS VARCHAR) AS xid, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
                     unnest(embedding) AS v FROM embeddings),
x AS (SELECT xid, dim, avg(v) AS v FROM lvec GROUP BY ALL),
y AS (SELECT CAST(floor(vec_id / 50) AS INTEGER) AS yid, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
             unnest(embedding) AS v FROM embeddings),
yv AS (SELECT yid, dim, avg(v) AS v FROM y GROUP BY ALL),
nx AS (SELECT xid, sqrt(sum(v * v)) AS n FROM x GROUP BY ALL),
ny AS (SELECT yid, sqrt(sum(v * v)) AS n FROM yv GROUP BY ALL)
SELECT x.xid, yv.yid, round(sum(x.v * yv.v) / (nx.n * ny.n), 6) AS similarity
FROM x JOIN yv USING (dim) JOIN nx USING (xid) JOIN ny USING (yid) GROUP BY x.xid, yv.yid, nx.n, ny.n""")
def q_vector_similarity(spark, sf_dir):
    """X: mean embedding per label; Y: mean embedding per block of 50 ids."""
    e = Ctx(spark, sf_dir).t("embeddings")
    x = e.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("xid"), F.posexplode("embedding").alias("dim", "v")) \
        .groupBy("xid", "dim").agg(F.avg("v").alias("v"))
    y = e.select(F.floor(F.col("vec_id") / 50).cast("int").alias("yid"), F.posexplode("embedding").alias("dim", "v")) \
        .groupBy("yid", "dim").agg(F.avg("v").alias("v"))
    return rounded(C.vector_similarity(x, y), "similarity")
