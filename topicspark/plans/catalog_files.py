"""Registered queries for the readers and writers: their line
formats, on lines made from the given tables. The files themselves are covered
by round-trip tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from topicspark.operators import steps as S
from topicspark.operators import thesaurus as H
from topicspark.operators import vocab as V
from topicspark.operators.match import measure_space
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import Ctx, register
from topicspark.plans.catalog_compare import _MERGE_CAT, _normalised
from topicspark.plans.catalog_text import _MATCH_SQL, _VOCAB_SQL, _vocab_ctx, plural_lemmas
from topicspark.sources import files as R
from topicspark.sources import sinks as W


def _line(df, line, value, path: str = "file"):
    return df.select(F.lit(path).alias("file_path"), F.expr(line).cast("long").alias("line"), F.expr(value).alias("value"))


# ------------------------------------------------------------------ 2.1 readers

@register("read_corpus", "SELECT doc_id, text, lang, source FROM documents")
def q_read_corpus(spark, sf_dir):
    d = Ctx(spark, sf_dir).t("documents").select("doc_id", "text", "lang", "source")
    rec = F.to_csv(F.struct(*d.columns), {"escape": '"', "quoteAll": "true"})
    return R.parse_corpus(d.select(rec.alias("value")), "doc_id bigint, text string, lang string, source string")


@register("read_whitelist", "SELECT DISTINCT lower(p_type) AS label FROM part")
def q_read_whitelist(spark, sf_dir):
    p = Ctx(spark, sf_dir).t("part").select(F.concat(F.lit("  "), F.upper("p_type"), F.lit(" ")).alias("value")).distinct()
    return R.parse_whitelist(p.unionByName(spark.range(1).select(F.lit("  ").alias("value"))))


@register("read_ngrams", "SELECT p_name AS ngram FROM part")
def q_read_ngrams(spark, sf_dir):
    return R.parse_ngrams(Ctx(spark, sf_dir).t("part").select(F.concat("p_name", F.lit(" ")).alias("value")))


@register("read_vocab", "SELECT word_id, word, cnt FROM fx_vocab")
def q_read_vocab(spark, sf_dir):
    return R.parse_vocab(_line(Ctx(spark, sf_dir).vocab, "word_id", "concat(word, '\\t', cnt)"))


@register("read_doc_steps", "SELECT doc_id AS doc_idx, step FROM fx_corpus")
def q_read_doc_steps(spark, sf_dir):
    return R.parse_doc_steps(_line(Ctx(spark, sf_dir).corpus, "doc_id", "concat(step, ' ')"))


@register("read_step_counts", """
SELECT CAST(row_number() OVER (ORDER BY step) - 1 AS INTEGER) AS step_idx, count(*) AS n_docs FROM fx_corpus GROUP BY step""")
def q_read_step_counts(spark, sf_dir):
    counts = V.step_counts(Ctx(spark, sf_dir).corpus)  # one row per step
    body = _line(counts.withColumn("i", F.row_number().over(Window.orderBy("step"))), "i", "cast(n_docs as string)")
    head = _line(counts.agg(F.count(F.lit(1)).alias("n")), "0", "cast(n as string)")
    return R.parse_step_counts(head.unionByName(body))


@register("read_doc_topic", "SELECT doc_id AS doc_idx, topic, weight FROM fx_doc_topic")
def q_read_doc_topic(spark, sf_dir):
    lines = _line(Ctx(spark, sf_dir).doc_topic, f"doc_id * {fx.N_TOPICS} + topic", "cast(weight as string)")
    return R.parse_doc_topic(lines, fx.N_TOPICS)


@register("read_topic_term", """
WITH st AS (SELECT step, CAST(row_number() OVER (ORDER BY step) - 1 AS INTEGER) AS step_idx FROM (SELECT DISTINCT step FROM fx_corpus))
SELECT topic, word_id, step_idx, round(prob, 11) AS prob FROM fx_topic_term JOIN st USING (step)""")
def q_read_topic_term(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    steps = c.corpus.select("step").distinct().withColumn("i", F.row_number().over(Window.orderBy("step")) - 1)
    tt = c.topic_term.join(steps, "step")
    lines = tt.select(F.format_string("run/lda-seq/topic-%03d-var-e-log-prob.dat", "topic").alias("file_path"),
                      (F.col("word_id") * 23 + F.col("i")).alias("line"), F.log("prob").cast("string").alias("value"))
    # exp(ln(x)) may differ from x in the last place
    return R.parse_topic_term(lines, 23).withColumn("prob", F.round("prob", 11))


#: Ids of the documents that are packed together.
_NPY_IDS = 4096


@register("read_npy", """
SELECT 'theta-' || CAST(step AS VARCHAR) AS file, row_number() OVER (PARTITION BY step, topic ORDER BY doc_id) - 1 AS row, topic AS col, weight AS value
FROM fx_doc_topic""")
def q_read_npy(spark, sf_dir):
    """One theta matrix per step, its documents in order of id, packed in blocks
    of the documents of ``_NPY_IDS`` successive ids."""
    def pack(pdf):
        import io

        import numpy as np
        import pandas as pd
        out = io.BytesIO()
        np.save(out, pdf.pivot(index="doc_id", columns="topic", values="weight").sort_index().to_numpy())
        return pd.DataFrame({"path": [f"theta-{pdf['step'].iloc[0]}"], "first_row": [pdf["first_row"].iloc[0]], "content": [out.getvalue()]})
    dt = Ctx(spark, sf_dir).doc_topic.withColumn("part", F.floor(F.col("doc_id") / _NPY_IDS))
    before = Window.partitionBy("step").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dt.groupBy("step", "part", "doc_id").count().groupBy("step", "part").agg(F.count(F.lit(1)).alias("n")) \
        .select("step", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first_row"))
    files = dt.join(parts, ["step", "part"]).groupBy("step", "part").applyInPandas(pack, "path string, first_row long, content binary")
    return R.parse_npy(files)


@register("read_bow", _VOCAB_SQL + """
SELECT doc_id AS doc_idx, CAST(sum(cnt) AS BIGINT) AS n, rtrim(string_agg(repeat(word || ' ', cnt), '' ORDER BY cnt DESC, first_pos)) AS tokens
FROM fdtc JOIN voc USING (word_id) GROUP BY doc_id""".replace("voc USING", "(SELECT word_id, word FROM voc) v USING"))
def q_read_bow(spark, sf_dir):
    _, tok, voc = _vocab_ctx(spark, sf_dir)
    rows = V.bow_rows(V.filter_docs(V.doc_term_counts(tok, voc)))
    back = R.parse_bow(_line(rows, "doc_id", "bow"), voc)
    return back.select("doc_idx", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@register("read_word_vectors", """
SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, unnest(embedding) AS v FROM embeddings""")
def q_read_word_vectors(spark, sf_dir):
    e = Ctx(spark, sf_dir).t("embeddings")
    lines = _line(e, "vec_id", "concat_ws(' ', concat('w', vec_id), cast(embedding as array<string>))")
    return R.parse_word_vectors(lines).select("word", F.posexplode("vec").alias("dim", "v"))


@register("discover_models", """
SELECT DISTINCT 'k' || CAST(p_size AS VARCHAR) || '_a0.1_var0.05' AS run, CAST(p_size AS INTEGER) AS k, 0.1::DOUBLE AS alpha, 0.05::DOUBLE AS var
FROM part WHERE p_size IN (1, 2, 3, 5, 8, 13, 21, 34)""")
def q_discover_models(spark, sf_dir):
    p = Ctx(spark, sf_dir).t("part")
    paths = p.select(F.expr("concat('/models/k', p_size, '_a0.1_var0.05/out/info-', p_partkey, '.dat')").alias("path"))
    return R.parse_run_dirs(paths.unionByName(p.select(F.concat(F.lit("/models/other/"), "p_name").alias("path"))), ks=[1, 2, 3, 5, 8, 13, 21, 34])


# ------------------------------------------------------------------ 2.2 writers

@register("write_vocab", "SELECT word_id, word || chr(9) || CAST(cnt AS VARCHAR) AS value FROM fx_vocab")
def q_write_vocab(spark, sf_dir):
    return W.format_vocab(Ctx(spark, sf_dir).vocab)


@register("write_dataset", _VOCAB_SQL + """,
rows AS (SELECT doc_id, CAST(count(*) AS VARCHAR) || ' ' || string_agg(CAST(word_id AS VARCHAR) || ':' || CAST(cnt AS VARCHAR), ' '
                ORDER BY cnt DESC, first_pos) AS bow FROM fdtc GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY d.step, d.doc_id) - 1 AS idx, rows.bow AS mult, CAST(d.step AS VARCHAR) AS year
FROM rows JOIN fx_corpus d USING (doc_id)""")
def q_write_dataset(spark, sf_dir):
    c, tok, voc = _vocab_ctx(spark, sf_dir)
    rows = V.bow_rows(V.filter_docs(V.doc_term_counts(tok, voc))).join(c.corpus.select("doc_id", "step"), "doc_id")
    return W.format_dataset(rows, order="doc_id")


@register("write_step_map", """
WITH m AS (SELECT DISTINCT CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month FROM orders),
r AS (SELECT month, CAST(floor((row_number() OVER (ORDER BY month) - 1) / 3) AS INTEGER) AS step FROM m)
SELECT '{' || string_agg('"' || CAST(month AS VARCHAR) || '":' || CAST(step AS VARCHAR), ',' ORDER BY month) || '}' AS value FROM r""")
def q_write_step_map(spark, sf_dir):
    mapping = S.present_month_mapping(Ctx(spark, sf_dir).t("orders"), "o_orderdate", "mapped")
    return W.format_step_map(mapping, "month")


@register("write_theme_counts", _MATCH_SQL.replace("FROM documents),", "FROM fx_null_text),", 1) + """,
c AS (SELECT doc_id, '{' || string_agg('"' || theme || '":' || CAST(n AS VARCHAR), ',' ORDER BY theme) || '}' AS counts
      FROM (SELECT doc_id, theme, count(*) AS n FROM kept GROUP BY ALL) GROUP BY doc_id),
t AS (SELECT doc_id, '{' || string_agg('"' || term || '":' || CAST(n AS VARCHAR), ',' ORDER BY term) || '}' AS terms
      FROM (SELECT doc_id, term, count(*) AS n FROM kept GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.counts, '{}') AS theme_counts, coalesce(t.terms, '{}') AS theme_terms
FROM fx_null_text d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""")
def q_write_theme_counts(spark, sf_dir):
    ms = measure_space(fx.fx_null_text(spark, sf_dir), Ctx(spark, sf_dir).themes, lemmas=plural_lemmas(spark, sf_dir))
    return W.format_theme_counts(ms).select("doc_id", "theme_counts", "theme_terms")


@register("write_ngrams", "SELECT DISTINCT -length(p_name) AS place, p_name AS value FROM part")
def q_write_ngrams(spark, sf_dir):
    return W.format_ngrams(Ctx(spark, sf_dir).t("part").select(F.col("p_name").alias("ngram")).distinct())


@register("write_merge_steps", _MERGE_CAT + """
SELECT iteration, '{"iteration":' || CAST(iteration AS VARCHAR) || ',"merged_into":"' || merged_into || '","label":"' || label || '"}' AS value FROM steps""")
def q_write_merge_steps(spark, sf_dir):
    return W.format_merge_steps(H.merge_by_category(_normalised(spark, sf_dir, remap=False), "MT"))

