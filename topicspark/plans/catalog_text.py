"""Registered queries for time steps, text, vocabulary and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicspark.functions import LETTER_SPLIT, MATCH_PATTERN, TOKEN_PATTERN, ordered_index, year_month, year_of_date
from topicspark.operators import match as M
from topicspark.operators import steps as S
from topicspark.operators import text as X
from topicspark.operators import vocab as V
from topicspark.plans import fixtures as fx
from topicspark.plans.catalog import Ctx, register


def _sqlq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(words) -> str:
    return ", ".join(_sqlq(w) for w in words)


# ------------------------------------------------------------------ 2.3 steps

@register("drop_null_text", "SELECT doc_id, text, lang, source, n_chars FROM fx_null_text WHERE text IS NOT NULL")
def q_drop_null_text(spark, sf_dir):
    return S.drop_null_text(fx.fx_null_text(spark, sf_dir))


@register("date_to_step", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month FROM orders""")
def q_date_to_step(spark, sf_dir):
    o = Ctx(spark, sf_dir).t("orders")
    o = S.date_to_step(o, "o_orderdate", year_of_date, "year")
    o = S.date_to_step(o, "o_orderdate", year_month, "month")
    return o.select("o_orderkey", "year", "month")


@register("batch_years", """
WITH y AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)
SELECT o_orderkey, year, CAST(floor((year - (SELECT min(year) FROM y)) / 3) AS INTEGER) AS batch FROM y""")
def q_batch_years(spark, sf_dir):
    o = S.date_to_step(Ctx(spark, sf_dir).t("orders"), "o_orderdate", year_of_date, "year")
    return S.batch_years(o, "year", 3).select("o_orderkey", "year", "batch")


_MONTH_SQL = """
WITH m AS (SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS month FROM orders),
map AS (SELECT month, CAST(floor((dense_rank() OVER (ORDER BY month) - 1) / 3) AS INTEGER) AS step
        FROM (SELECT DISTINCT month FROM m))
"""


@register("bucket_present_months", _MONTH_SQL + "SELECT m.o_orderkey, map.step FROM m JOIN map USING (month)")
def q_bucket_present_months(spark, sf_dir):
    o = Ctx(spark, sf_dir).t("orders").select("o_orderkey", "o_orderdate")
    return S.bucket_present_months(o, "o_orderdate").select("o_orderkey", "step")


@register("apply_step_map", """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(strftime(l_shipdate, '%Y%m') AS INTEGER) AS month FROM lineitem),
map AS (SELECT month, CAST(floor((dense_rank() OVER (ORDER BY month) - 1) / 3) AS INTEGER) AS step FROM (SELECT DISTINCT month FROM l))
SELECT l.l_orderkey, l.l_linenumber, map.step FROM l LEFT JOIN map USING (month)""")
def q_apply_step_map(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    mapping = S.present_month_mapping(c.t("lineitem"), "l_shipdate", "mapped").withColumnRenamed("month", "step")
    li = c.t("lineitem").select("l_orderkey", "l_linenumber", year_month(F.col("l_shipdate")).alias("step"))
    return S.apply_step_map(li, mapping, "step", "mapped").select("l_orderkey", "l_linenumber", "step")


@register("step_range", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS step FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1999""")
def q_step_range(spark, sf_dir):
    o = S.date_to_step(Ctx(spark, sf_dir).t("orders"), "o_orderdate", year_of_date, "step")
    return S.step_range(o, 1996, 1999).select("o_orderkey", "step")


@register("sample_docs", f"""
SELECT doc_id, lang, source, n_chars FROM documents
ORDER BY md5('{S.SEED}:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def q_sample_docs(spark, sf_dir):
    d = Ctx(spark, sf_dir).t("documents")
    return S.sample_docs(d, 100).select("doc_id", "lang", "source", "n_chars")


# ------------------------------------------------------------------ 2.4 text

_SENT_SQL = rf"""
WITH sents AS (
  SELECT doc_id, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS si, unnest(ss) AS s
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(
                 regexp_replace(text, {_sqlq(X.URL_PATTERN)}, ' ', 'g'), {_sqlq(X.SENTENCE_SPLIT)}),
               lambda x: trim(x) <> '') AS ss
        FROM documents)),
toks AS (SELECT doc_id, si, list_filter(regexp_split_to_array(lower(s), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> '') AS t
         FROM sents)
"""

_KEEP_SQL = (rf"NOT regexp_matches(x, '\p{{N}}') AND x NOT IN ({_sql_list(X.NUMBER_WORDS)}) "
             rf"AND x NOT IN ({_sql_list(X.default_stopwords())}) AND length(x) > 1")


def _sent_out(df):
    ex = df.select("doc_id", F.posexplode("sents").alias("si", "t"))
    return ex.select("doc_id", "si", F.size("t").alias("n"), F.array_join("t", " ").alias("toks"))


@register("tokenize_sentences", _SENT_SQL + """
SELECT doc_id, si, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS toks FROM toks""")
def q_tokenize_sentences(spark, sf_dir):
    return _sent_out(X.tokenize_sentences(Ctx(spark, sf_dir).t("documents")))


_FILT_SQL = _SENT_SQL + f", ft AS (SELECT doc_id, si, list_filter(t, lambda x: {_KEEP_SQL}) AS t FROM toks)\n"


@register("filter_tokens", _FILT_SQL + """
SELECT doc_id, si, CAST(len(t) AS INTEGER) AS n, array_to_string(t, ' ') AS toks FROM ft""")
def q_filter_tokens(spark, sf_dir):
    return _sent_out(X.filter_tokens(X.tokenize_sentences(Ctx(spark, sf_dir).t("documents"))))


def plural_lemmas(spark, sf_dir):
    """Lemma table derived from the corpus: ``<stem>s`` -> ``<stem>`` when the stem is a word too."""
    d = Ctx(spark, sf_dir).t("documents")
    # an outer explode, as the other one has its array computed once more to filter on its size
    words = d.select(F.explode_outer(F.array_distinct(F.split(F.lower("text"), TOKEN_PATTERN))).alias("w")).where("w <> ''")
    # each word, and a word on -s once more as its stem: both meet in one aggregate
    stem = F.expr("substring(w, 1, length(w) - 1)")
    own = F.struct(F.col("w").alias("k"), F.lit(1).alias("word"), F.lit(0).alias("stem"))
    cut = F.struct(stem.alias("k"), F.lit(0).alias("word"), F.lit(1).alias("stem"))
    both = words.select(F.explode(F.when(F.col("w").endswith("s") & (F.length("w") > 3), F.array(own, cut)).otherwise(F.array(own))).alias("e"))
    met = both.groupBy("e.k").agg(F.max("e.word").alias("word"), F.max("e.stem").alias("stem")).where("word = 1 and stem = 1")
    return met.select(F.concat("k", F.lit("s")).alias("form"), F.col("k").alias("lemma"))


_LEM_CTE = rf"""
words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> '')) AS w
          FROM documents),
lem AS (SELECT w AS form, substr(w, 1, length(w) - 1) AS lemma FROM words
        WHERE suffix(w, 's') AND length(w) > 3 AND substr(w, 1, length(w) - 1) IN (SELECT w FROM words))"""

_LEMMA_SQL = "," + _LEM_CTE + """,
lt AS (SELECT doc_id, si, list(coalesce(lem.lemma, x.tok) ORDER BY x.ti) FILTER (WHERE x.tok IS NOT NULL) AS t
       FROM (SELECT doc_id, si, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS tok,
                    unnest(CASE WHEN len(t) = 0 THEN [0] ELSE range(len(t)) END) AS ti FROM ft) x
       LEFT JOIN lem ON lem.form = x.tok GROUP BY doc_id, si)
"""


@register("lemmatize", _FILT_SQL + _LEMMA_SQL + """
SELECT doc_id, si, CAST(coalesce(len(t), 0) AS INTEGER) AS n, coalesce(array_to_string(t, ' '), '') AS toks FROM lt""")
def q_lemmatize(spark, sf_dir):
    d = X.filter_tokens(X.tokenize_sentences(Ctx(spark, sf_dir).t("documents")))
    return _sent_out(X.lemmatize(d, plural_lemmas(spark, sf_dir)))


_BLACKLIST = ["ing", "tion", "ere"]


@register("drop_terms", _FILT_SQL + f"""
SELECT doc_id, si, CAST(len(list_filter(t, lambda x: x <> '' AND x NOT IN ({_sql_list(_BLACKLIST)}))) AS INTEGER) AS n,
       array_to_string(list_filter(t, lambda x: x <> '' AND x NOT IN ({_sql_list(_BLACKLIST)})), ' ') AS toks FROM ft""")
def q_drop_terms(spark, sf_dir):
    d = X.filter_tokens(X.tokenize_sentences(Ctx(spark, sf_dir).t("documents")))
    return _sent_out(X.drop_terms(d, blacklist=_BLACKLIST))


_DOC_SQL = _FILT_SQL + ", dt AS (SELECT doc_id, flatten(list(t ORDER BY si)) AS t FROM ft GROUP BY doc_id)\n"


@register("merge_sentences", _DOC_SQL + """
SELECT d.doc_id, CAST(coalesce(len(dt.t), 0) AS INTEGER) AS n, coalesce(array_to_string(dt.t, ' '), '') AS tokens
FROM documents d LEFT JOIN dt USING (doc_id)""")
def q_merge_sentences(spark, sf_dir):
    d = X.filter_tokens(X.tokenize_sentences(Ctx(spark, sf_dir).t("documents")))
    m = X.merge_sentences(d)
    return m.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@register("merge_docs", _DOC_SQL + """
SELECT doc_id, array_to_string(t, ' ') AS doc FROM dt WHERE array_to_string(t, ' ') <> ''""")
def q_merge_docs(spark, sf_dir):
    d = X.filter_tokens(X.tokenize_sentences(Ctx(spark, sf_dir).t("documents")))
    return X.merge_docs(d).select("doc_id", "doc")


# surface rules before the lemma, length and digit rules on the lemma
_PRE_SQL = (_SENT_SQL + f""", ft AS (SELECT doc_id, si, list_filter(t, lambda x: NOT regexp_matches(x, '^\\p{{N}}+$')
  AND x NOT IN ({_sql_list(X.NUMBER_WORDS)}) AND x NOT IN ({_sql_list(X.default_stopwords())})) AS t FROM toks)
""" + _LEMMA_SQL + """, kt AS (SELECT doc_id, si, list_filter(coalesce(t, []), lambda x: NOT regexp_matches(x, '\\p{N}') AND length(x) > 1) AS t FROM lt)
""")


@register("preprocess", _PRE_SQL + f""",
dt AS (SELECT doc_id, flatten(list(list_filter(t, lambda x: x <> '' AND x NOT IN ({_sql_list(_BLACKLIST)})) ORDER BY si)) AS t
       FROM kt GROUP BY doc_id)
SELECT doc_id, array_to_string(t, ' ') AS doc FROM dt WHERE array_to_string(t, ' ') <> ''""")
def q_preprocess(spark, sf_dir):
    d = Ctx(spark, sf_dir).t("documents")
    p = X.preprocess(d, lemmas=plural_lemmas(spark, sf_dir), blacklist=_BLACKLIST)
    return X.merge_docs(p).select("doc_id", "doc")


@register("build_ngram_list", rf"""
WITH s AS (SELECT p_partkey, list_filter(regexp_split_to_array(
             regexp_replace(p_name, {_sqlq(X.URL_PATTERN)}, ' ', 'g'), {_sqlq(X.SENTENCE_SPLIT)}), lambda x: trim(x) <> '') AS ss
           FROM part),
t AS (SELECT p_partkey, flatten(list_transform(ss, lambda y: list_filter(
         list_filter(regexp_split_to_array(lower(y), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> ''),
         lambda x: {_KEEP_SQL}))) AS t FROM s)
SELECT array_to_string(t, ' ') AS ngram FROM t WHERE array_to_string(t, ' ') <> ''""")
def q_build_ngram_list(spark, sf_dir):
    p = Ctx(spark, sf_dir).t("part").select(F.col("p_name").alias("value"))
    return X.build_ngram_list(p)


@register("lemmatize_text", rf"""
WITH words AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> '')) AS w
               FROM documents),
lem AS (SELECT w AS form, substr(w, 1, length(w) - 1) AS lemma FROM words
        WHERE suffix(w, 's') AND length(w) > 3 AND substr(w, 1, length(w) - 1) IN (SELECT w FROM words)),
sents AS (SELECT doc_id, generate_subscripts(ss, 1) AS si, unnest(ss) AS s
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, {_sqlq(X.SENTENCE_SPLIT)}), lambda x: trim(x) <> '') AS ss
                FROM documents)),
tk AS (SELECT doc_id, si, unnest(t) AS tok, unnest(range(len(t))) AS ti
       FROM (SELECT doc_id, si, list_filter(regexp_split_to_array(lower(s), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> '') AS t FROM sents))
SELECT d.doc_id, coalesce(x.lemma_text, '') AS lemma_text FROM documents d LEFT JOIN
  (SELECT doc_id, string_agg(coalesce(lem.lemma, tok), ' ' ORDER BY si, ti) AS lemma_text
   FROM tk LEFT JOIN lem ON lem.form = tk.tok GROUP BY doc_id) x USING (doc_id)""")
def q_lemmatize_text(spark, sf_dir):
    d = Ctx(spark, sf_dir).t("documents")
    return X.lemmatize_text(d, plural_lemmas(spark, sf_dir)).select("doc_id", "lemma_text")


@register("sort_keywords", "WITH" + _LEM_CTE + rf""",
kt AS (SELECT p_name, unnest(t) AS tok, unnest(range(len(t))) AS i
       FROM (SELECT DISTINCT p_name, list_filter(regexp_split_to_array(lower(p_name), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> '') AS t FROM part)),
kl AS (SELECT p_name, string_agg(coalesce(lem.lemma, tok), ' ' ORDER BY i) AS kw FROM kt LEFT JOIN lem ON lem.form = tok GROUP BY p_name)
SELECT p_type AS theme, string_agg(kw, '|' ORDER BY length(kw) DESC, kw) AS keywords FROM part JOIN kl USING (p_name) GROUP BY p_type""")
def q_sort_keywords(spark, sf_dir):
    """Themes are the part types, their keywords the part names."""
    themes = Ctx(spark, sf_dir).t("part").select(F.col("p_type").alias("theme"), F.col("p_name").alias("keyword"))
    s = X.sort_keywords(themes, lemmas=plural_lemmas(spark, sf_dir))
    return s.select("theme", F.array_join("keywords", "|").alias("keywords"))


@register("join_ngrams", _FILT_SQL + rf""",
ps AS (SELECT list_filter(regexp_split_to_array(regexp_replace(p_name, {_sqlq(X.URL_PATTERN)}, ' ', 'g'), {_sqlq(X.SENTENCE_SPLIT)}), lambda x: trim(x) <> '') AS ss FROM part),
ng AS (SELECT DISTINCT key FROM (SELECT array_to_string(flatten(list_transform(ss, lambda y: list_filter(
         list_filter(regexp_split_to_array(lower(y), {_sqlq(TOKEN_PATTERN)}), lambda x: x <> ''), lambda x: {_KEEP_SQL}))), ' ') AS key FROM ps)
       WHERE contains(key, ' ')),
nl AS (SELECT DISTINCT len(string_split(key, ' ')) AS n FROM ng),
win AS (SELECT doc_id, si, CAST(i AS INTEGER) AS s, CAST(i + nl.n AS INTEGER) AS e, array_to_string(t[i + 1 : i + nl.n], ' ') AS key
        FROM ft, nl, unnest(range(0, len(t) - nl.n + 1)) AS r(i)),
-- the longest text first, then leftmost; a span that meets one already taken is passed over
taken AS (
  SELECT doc_id, si, list_reduce(list({{'s': s, 'e': e, 'k': key}} ORDER BY length(key) DESC, s, e),
    lambda acc, m: CASE WHEN len(list_filter(acc, lambda k: m.s < k.e AND k.s < m.e)) = 0 THEN list_append(acc, m) ELSE acc END,
    []::STRUCT(s INTEGER, e INTEGER, k VARCHAR)[]) AS spans
  FROM win JOIN ng USING (key) GROUP BY doc_id, si),
sp AS (SELECT doc_id, si, k.s AS s, k.e AS e, k.k AS key FROM (SELECT doc_id, si, unnest(spans) AS k FROM taken)),
tk AS (SELECT doc_id, si, unnest(t) AS tok, unnest(range(len(t))) AS i FROM ft),
w AS (SELECT tk.doc_id, tk.si, tk.i, CASE WHEN sp.s IS NULL THEN tk.tok WHEN sp.s = tk.i THEN replace(sp.key, ' ', '_') END AS w
      FROM tk LEFT JOIN sp ON sp.doc_id = tk.doc_id AND sp.si = tk.si AND tk.i >= sp.s AND tk.i < sp.e)
SELECT d.doc_id, coalesce(string_agg(w.w, ' ' ORDER BY w.si, w.i) FILTER (w.w IS NOT NULL), '') AS doc
FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""")
def q_join_ngrams(spark, sf_dir):
    """n-grams = the two-word part names, joined inside the preprocessed documents."""
    c = Ctx(spark, sf_dir)
    ng = X.build_ngram_list(c.t("part").select(F.col("p_name").alias("value"))).distinct()
    d = X.filter_tokens(X.tokenize_sentences(c.t("documents")))
    j = X.join_ngrams(d, ng)
    return X.merge_docs(j, keep_empty=True).select("doc_id", "doc")


# ------------------------------------------------------------------ 2.5 vocab

_TOK_ALL = "fx_tokens"


@register("split_tokens", rf"""
SELECT doc_id, CAST(len(list_filter(string_split(array_to_string(
  list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> ''), ' '), ' '), lambda x: x <> '')) AS INTEGER) AS n
FROM documents""")
def q_split_tokens(spark, sf_dir):
    d = Ctx(spark, sf_dir).t("documents")
    s = d.select("doc_id", F.array_join(F.filter(F.split(F.lower("text"), LETTER_SPLIT), lambda x: x != ""), " ").alias("t"))
    return V.split_tokens(s, "t").select("doc_id", F.size("tokens").alias("n"))


@register("word_counts", "SELECT w, count(*) AS cnt FROM fx_tokens GROUP BY w")
def q_word_counts(spark, sf_dir):
    return V.word_counts(Ctx(spark, sf_dir).tokens)


_VOCAB_SQL = """
WITH voc AS (
  SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS word_id, w AS word, cnt
  FROM (SELECT w, count(*) AS cnt, min(doc_id * 1000000 + pos) AS f FROM fx_tokens GROUP BY w HAVING count(*) > 20)),
dtc AS (
  SELECT t.doc_id, v.word_id, count(*) AS cnt, CAST(min(t.pos) AS INTEGER) AS first_pos
  FROM fx_tokens t JOIN voc v ON v.word = t.w GROUP BY t.doc_id, v.word_id),
ok AS (SELECT doc_id FROM dtc GROUP BY doc_id HAVING sum(cnt) > 15 AND count(*) > 5),
fdtc AS (SELECT * FROM dtc WHERE doc_id IN (SELECT doc_id FROM ok))
"""


def _vocab_ctx(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    tok = c.tokens.withColumn("doc_order", F.col("doc_id"))
    voc = V.vocab(tok, min_freq=20)
    return c, tok, voc


@register("vocab", _VOCAB_SQL + "SELECT word_id, word, cnt FROM voc")
def q_vocab(spark, sf_dir):
    return _vocab_ctx(spark, sf_dir)[2]


@register("doc_term_counts", _VOCAB_SQL + "SELECT doc_id, word_id, cnt, first_pos FROM dtc")
def q_doc_term_counts(spark, sf_dir):
    _, tok, voc = _vocab_ctx(spark, sf_dir)
    return V.doc_term_counts(tok, voc).select("doc_id", "word_id", "cnt", "first_pos")


@register("filter_docs", _VOCAB_SQL + "SELECT doc_id, word_id, cnt FROM fdtc")
def q_filter_docs(spark, sf_dir):
    _, tok, voc = _vocab_ctx(spark, sf_dir)
    return V.filter_docs(V.doc_term_counts(tok, voc)).select("doc_id", "word_id", "cnt")


@register("bow_rows", _VOCAB_SQL + """
SELECT doc_id, CAST(count(*) AS INTEGER) AS ntypes,
       CAST(count(*) AS VARCHAR) || ' ' || string_agg(CAST(word_id AS VARCHAR) || ':' || CAST(cnt AS VARCHAR), ' '
                                                     ORDER BY cnt DESC, first_pos) AS bow
FROM fdtc GROUP BY doc_id""")
def q_bow_rows(spark, sf_dir):
    _, tok, voc = _vocab_ctx(spark, sf_dir)
    return V.bow_rows(V.filter_docs(V.doc_term_counts(tok, voc)))


@register("order_docs", _VOCAB_SQL + """
SELECT d.doc_id, d.step, CAST(row_number() OVER (ORDER BY d.step, d.doc_id) - 1 AS BIGINT) AS idx
FROM fx_corpus d WHERE d.doc_id IN (SELECT doc_id FROM ok)""")
def q_order_docs(spark, sf_dir):
    c, tok, voc = _vocab_ctx(spark, sf_dir)
    kept = V.filter_docs(V.doc_term_counts(tok, voc)).select("doc_id").distinct()
    docs = c.corpus.join(kept, "doc_id", "left_semi").select("doc_id", "step")
    return ordered_index(docs, [F.col("step"), F.col("doc_id")], "idx")


@register("step_counts", _VOCAB_SQL + """
SELECT d.step, count(*) AS n_docs FROM fx_corpus d WHERE d.doc_id IN (SELECT doc_id FROM ok) GROUP BY d.step""")
def q_step_counts(spark, sf_dir):
    c, tok, voc = _vocab_ctx(spark, sf_dir)
    kept = V.filter_docs(V.doc_term_counts(tok, voc)).select("doc_id").distinct()
    return V.step_counts(c.corpus.join(kept, "doc_id", "left_semi"))


# ------------------------------------------------------------------ 2.6 matching

_MT = _sqlq(MATCH_PATTERN)
# tokens include punctuation; documents and keywords match by lemma, the surface text is the term
_MATCH_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {_MT}) AS toks
              FROM documents),""" + _LEM_CTE + rf""",
dt AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM docs),
dl AS (SELECT dt.doc_id, list(coalesce(lem.lemma, dt.tok) ORDER BY i) AS lems, list(dt.tok ORDER BY i) AS toks
       FROM dt LEFT JOIN lem ON lem.form = dt.tok GROUP BY dt.doc_id),
kt AS (SELECT keyword, unnest(t) AS tok, unnest(range(len(t))) AS i
       FROM (SELECT DISTINCT keyword, regexp_extract_all(lower(keyword), {_MT}) AS t FROM fx_themes)),
kl AS (SELECT keyword, string_agg(coalesce(lem.lemma, tok), ' ' ORDER BY i) AS key FROM kt LEFT JOIN lem ON lem.form = tok GROUP BY keyword),
kw AS (SELECT DISTINCT theme, key FROM fx_themes JOIN kl USING (keyword)),
kwl AS (SELECT DISTINCT len(string_split(key, ' ')) AS n FROM kw),
win AS (SELECT d.doc_id, CAST(i AS INTEGER) AS s, CAST(i + kwl.n AS INTEGER) AS e,
               array_to_string(d.lems[i + 1 : i + kwl.n], ' ') AS lkey, array_to_string(d.toks[i + 1 : i + kwl.n], ' ') AS key
        FROM dl d, kwl, unnest(range(0, len(d.toks) - kwl.n + 1)) AS r(i)),
matches AS (SELECT win.doc_id, kw.theme, win.s, win.e, win.key FROM win JOIN kw ON kw.key = win.lkey),
""" + r"""ded AS (
  SELECT doc_id, theme, list_reduce(list({'s': s, 'e': e, 'k': key} ORDER BY s, e, key),
    lambda acc, m: {'kept': CASE WHEN acc.prev IS NULL OR m.s > acc.prev.e THEN list_append(acc.kept, m)
                                 WHEN m.s = acc.prev.s THEN list_append(acc.kept[1:len(acc.kept) - 1], m)
                                 WHEN m.s < acc.prev.e AND m.e > acc.prev.e THEN list_append(acc.kept, m)
                                 ELSE acc.kept END,
                    'prev': m},
    {'kept': []::STRUCT(s INTEGER, e INTEGER, k VARCHAR)[], 'prev': NULL::STRUCT(s INTEGER, e INTEGER, k VARCHAR)}).kept AS kept
  FROM matches GROUP BY doc_id, theme),
kept AS (SELECT doc_id, theme, k.s AS s, k.e AS e, k.k AS term FROM (SELECT doc_id, theme, unnest(kept) AS k FROM ded))
"""


def _matches(spark, sf_dir):
    docs = Ctx(spark, sf_dir).t("documents").select("doc_id", M.match_tokens("text").alias("toks"))
    return M.phrase_match(docs, Ctx(spark, sf_dir).themes, "toks", lemmas=plural_lemmas(spark, sf_dir))


def _kept(spark, sf_dir, mode="fold"):
    return M.dedupe_matches(_matches(spark, sf_dir), mode)


@register("phrase_match", _MATCH_SQL + "SELECT doc_id, theme, s AS start, e AS \"end\", key AS term FROM matches")
def q_phrase_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@register("dedupe_matches", _MATCH_SQL + "SELECT doc_id, theme, s AS start, e AS \"end\", term FROM kept")
def q_dedupe_matches(spark, sf_dir):
    return _kept(spark, sf_dir)


@register("reduce_matches", _MATCH_SQL + r""",
red AS (
  SELECT doc_id, list_reduce(list({'s': s, 'e': e, 'k': key || chr(1) || theme} ORDER BY s, e, key || chr(1) || theme),
    lambda acc, m: {'kept': CASE WHEN acc.prev IS NULL OR m.s > acc.prev.e THEN list_append(acc.kept, m)
                                 WHEN m.s < acc.prev.e AND m.e > acc.prev.e THEN list_append(acc.kept, m)
                                 ELSE acc.kept END,
                    'prev': m},
    {'kept': []::STRUCT(s INTEGER, e INTEGER, k VARCHAR)[], 'prev': NULL::STRUCT(s INTEGER, e INTEGER, k VARCHAR)}).kept AS kept
  FROM matches GROUP BY doc_id)
SELECT doc_id, string_split(k.k, chr(1))[2] AS theme, k.s AS start, k.e AS "end", string_split(k.k, chr(1))[1] AS term
FROM (SELECT doc_id, unnest(kept) AS k FROM red)""")
def q_reduce_matches(spark, sf_dir):
    return M.reduce_matches(_matches(spark, sf_dir))


@register("theme_counts", _MATCH_SQL + "SELECT doc_id, theme, count(*) AS cnt FROM kept GROUP BY doc_id, theme")
def q_theme_counts(spark, sf_dir):
    return M.theme_counts(_kept(spark, sf_dir))


@register("term_counts", _MATCH_SQL + "SELECT doc_id, term, count(*) AS cnt FROM kept GROUP BY doc_id, term")
def q_term_counts(spark, sf_dir):
    return M.term_counts(_kept(spark, sf_dir))


@register("measure_space", _MATCH_SQL.replace("FROM documents),", "FROM fx_null_text),", 1) + """,
c AS (SELECT doc_id, string_agg(theme || '=' || CAST(n AS VARCHAR), ',' ORDER BY theme || '=' || CAST(n AS VARCHAR)) AS counts
      FROM (SELECT doc_id, theme, count(*) AS n FROM kept GROUP BY ALL) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(term || '=' || CAST(n AS VARCHAR), ',' ORDER BY term || '=' || CAST(n AS VARCHAR)) AS terms
      FROM (SELECT doc_id, term, count(*) AS n FROM kept GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, d.text IS NULL AS null_text, coalesce(c.counts, '') AS counts, coalesce(t.terms, '') AS terms
FROM fx_null_text d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""")
def q_measure_space(spark, sf_dir):
    d = fx.fx_null_text(spark, sf_dir)
    ms = M.measure_space(d, Ctx(spark, sf_dir).themes, lemmas=plural_lemmas(spark, sf_dir))

    def flat(m):
        return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(
            e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return ms.select("doc_id", F.col("text").isNull().alias("null_text"),
                     flat("theme_counts").alias("counts"), flat("theme_terms").alias("terms"))


@register("theme_trend", _MATCH_SQL + """
SELECT d.source, k.theme, count(*) AS cnt FROM kept k JOIN documents d USING (doc_id) GROUP BY d.source, k.theme""")
def q_theme_trend(spark, sf_dir):
    c = Ctx(spark, sf_dir)
    ms = M.measure_space(c.t("documents"), c.themes, lemmas=plural_lemmas(spark, sf_dir))
    return M.theme_trend(ms, by="source")
