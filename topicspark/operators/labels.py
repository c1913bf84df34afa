"""Automatic topic labelling.

Inputs:
  thesaurus  <pos, phrase, label>       (pos keeps the thesaurus order)
  top words  <topic, [step,] word, prob>
  vectors    <word, vec array<float>>

Vectors are averaged in long form <key, dim, v>: grouped sums, so a label with a
third of all phrases is aggregated partially on every executor instead of being
collected into one task. Phrases and words match by lemma where a <form, lemma>
table is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import TOKEN_PATTERN, bounded_broadcast, strip_label_code, unjoin_terms
from topicspark.operators.vectors import cosines, paired_in_blocks


def _toks(c, pattern):
    return F.filter(F.split(F.lower(c), pattern), lambda x: x != "")


def read_thesaurus(df: DataFrame, phrase_col: str = "phrase", label_col: str = "label",
                   order_col: str = "pos") -> DataFrame:
    """Phrase -> label table with its position column ``pos`` (the thesaurus order;
    rows of a table have none of their own, so a column must give it)."""
    out = df.select(F.col(order_col).cast("long").alias("pos"), F.col(phrase_col).alias("phrase"),
                    F.col(label_col).alias("label"))
    return out


def thesaurus_from_dict(spark, mapping: dict) -> DataFrame:
    rows = [(i, p, lb) for i, (p, lb) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "pos long, phrase string, label string")


def preprocess_thesaurus(thes: DataFrame, **kw) -> DataFrame:
    """Run the text pipeline on the phrases (Q4: tokenised first); empties kept."""
    from topicspark.operators.text import merge_docs, preprocess
    base = thes.withColumnRenamed("pos", "doc_id").withColumnRenamed("phrase", "text")
    pre = merge_docs(preprocess(base, **kw), keep_empty=True)
    return pre.select(F.col("doc_id").alias("pos"), F.col("doc").alias("phrase"), "label")


def _lemma_toks(df: DataFrame, text: str, pattern: str, lemmas: DataFrame | None, out: str) -> DataFrame:
    """``df`` with the tokens (lemmas) of a text column."""
    if lemmas is None:
        return df.withColumn(out, _toks(F.col(text), pattern))
    from topicspark.operators.text import lemmatize
    words = df.select(F.col(text).alias("_w")).distinct().withColumn(out, F.array(_toks(F.col("_w"), pattern)))
    words = lemmatize(words, lemmas, out, "_w").withColumn(out, F.flatten(out))
    return df.join(words, F.col(text).eqNullSafe(F.col("_w")), "left").drop("_w")


def term_keys(top_words: DataFrame, pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """Top words with their match key: ``greenhouse_gas`` -> ``greenhouse gas`` tokens (lemmas)."""
    t = _lemma_toks(top_words.withColumn("_text", unjoin_terms("word")), "_text", pattern, lemmas, "_toks")
    return t.withColumn("term", F.array_join("_toks", " ")).drop("_text", "_toks")


#: Thesaurus positions that share a chunk when token offsets are summed up.
CHUNK = 4096


def label_docs(thes: DataFrame, pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None):
    """Tokens of each (lowercased) label's concatenated phrases with their place:
    (<label, g, tok>, <label, doc_len>).

    A phrase's offset is the sum over its label's earlier chunks of positions
    plus the sum within its chunk, so no label is one task's work.
    """
    t = _lemma_toks(thes.select("pos", F.lower("label").alias("label"), "phrase"), "phrase", pattern, lemmas, "toks")
    t = t.select("pos", "label", "toks", F.size("toks").alias("_n"), F.floor(F.col("pos") / CHUNK).alias("_c"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    chunks = t.groupBy("label", "_c").agg(F.sum("_n").alias("_s"))
    chunks = chunks.withColumn("_first", F.coalesce(F.sum("_s").over(before("label").orderBy("_c")), F.lit(0))).drop("_s")
    t = t.withColumn("_in", F.coalesce(F.sum("_n").over(before("label", "_c").orderBy("pos")), F.lit(0)))
    tok = t.join(chunks, ["label", "_c"]).select("label", (F.col("_first") + F.col("_in")).alias("_off"), F.posexplode("toks").alias("ti", "tok")) \
        .select("label", (F.col("_off") + F.col("ti")).alias("g"), "tok")
    return tok, t.groupBy("label").agg(F.sum("_n").alias("doc_len"))


def label_window_matches(tok: DataFrame, terms: DataFrame) -> DataFrame:
    """<label, term, start> for every window of a label document equal to a
    ``term`` of ``terms``. Only the distinct term lengths come to the driver.

    Each token is copied to the window starts it belongs to (at most the
    longest term length), windows are assembled per (label, start): groups of
    bounded size, spread over all positions, so a label holding a third of the
    thesaurus is still split across tasks. Windows may cross phrase borders (Q2).
    """
    terms = terms.select("term").filter(F.col("term") != "").distinct()
    lengths = sorted(r[0] for r in terms.select(F.size(F.split("term", " "))).distinct().collect())
    if not lengths:
        return tok.select("label", F.lit("").alias("term"), F.col("g").alias("start")).limit(0)
    copies = tok.select("label", "tok", "g", F.explode(F.sequence(F.lit(0), F.lit(lengths[-1] - 1))).alias("k")) \
        .select("label", (F.col("g") - F.col("k")).alias("start"), "k", "tok").filter(F.col("start") >= 0)
    win = copies.groupBy("label", "start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "tok"))), lambda x: x["tok"]).alias("w"))
    keys = F.filter(F.array(*[F.when(F.size("w") >= n, F.array_join(F.slice("w", 1, n), " ")) for n in lengths]),
                    lambda x: x.isNotNull())
    return win.select("label", "start", F.explode(keys).alias("term")).join(bounded_broadcast(terms), "term", "left_semi")


def term_label_tfidf(terms: DataFrame, thes: DataFrame, pattern: str = TOKEN_PATTERN,
                     lemmas: DataFrame | None = None) -> DataFrame:
    """<term, label, cnt, tfidf>: tf = matches / label doc length, idf = ln(#labels / #labels matching).

    ``terms`` has a ``term`` column (distinct over all topics: tf and idf do not
    depend on the topic, Q3).
    """
    tok, lens = label_docs(thes, pattern, lemmas)
    m = label_window_matches(tok, terms)
    cnt = m.groupBy("term", "label").agg(F.count(F.lit(1)).alias("cnt"))
    n_labels = lens.select(F.count(F.lit(1))).scalar()
    nd = cnt.groupBy("term").agg(F.count(F.lit(1)).alias("_nd"))
    j = cnt.join(nd, "term").join(lens, "label")
    tfidf = (F.col("cnt") / F.col("doc_len")) * F.log(n_labels / F.col("_nd"))
    return j.select("term", "label", "cnt", tfidf.alias("tfidf"))


def label_scores_tfidf(top_words: DataFrame, thes: DataFrame, keys=("topic",),
                       pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """<keys..., label, score> of every key and every label: sum over matches of
    word weight x tfidf (c matches add c x, Q3), 0 without a match."""
    tw = term_keys(top_words, pattern, lemmas)
    tf = term_label_tfidf(tw.select("term").distinct(), thes, pattern, lemmas)
    found = tw.join(tf, "term").select(*keys, "label", (F.col("prob") * F.col("cnt") * F.col("tfidf")).alias("s"))
    zero = paired_in_blocks(top_words.select(*keys).distinct(), thes.select(F.lower("label").alias("label")).distinct())
    return found.unionByName(zero.withColumn("s", F.lit(0.0))).groupBy(*keys, "label").agg(F.sum("s").alias("score"))


# ------------------------------------------------------------------ vectors

def vectors_long(vectors: DataFrame, *keys: str) -> DataFrame:
    return vectors.select(*(keys or ("word",)), F.posexplode("vec").alias("dim", "v"))


def phrase_vectors(thes: DataFrame, vectors: DataFrame, pattern: str = TOKEN_PATTERN,
                   lemmas: DataFrame | None = None) -> DataFrame:
    """<pos, label, dim, v>: mean vector of a phrase's in-vocabulary tokens (lemmas;
    phrases without any are absent). Words meet whole vectors; dimensions are
    taken apart after the join."""
    t = _lemma_toks(thes.select("pos", F.lower("label").alias("label"), "phrase"), "phrase", pattern, lemmas, "_t")
    t = t.select("pos", "label", F.explode("_t").alias("word"))
    j = t.join(bounded_broadcast(vectors.select("word", "vec")), "word")
    return vectors_long(j, "pos", "label").groupBy("pos", "label", "dim").agg(F.avg("v").alias("v"))


def label_phrase_map(thes: DataFrame, vectors: DataFrame, pattern: str = TOKEN_PATTERN,
                     lemmas: DataFrame | None = None) -> DataFrame:
    """<label, phrase>: phrases of each label that have a vector."""
    t = _lemma_toks(thes.select("pos", F.lower("label").alias("label"), F.lower("phrase").alias("phrase")), "phrase", pattern, lemmas, "_t")
    t = t.select("pos", "label", "phrase", F.explode("_t").alias("word"))
    has = t.join(vectors.select("word"), "word", "left_semi")
    return has.select("label", "pos", "phrase").distinct()


def label_vectors(pvec: DataFrame) -> DataFrame:
    """<label, dim, v>: mean of a label's phrase vectors."""
    return pvec.groupBy("label", "dim").agg(F.avg("v").alias("v"))


def topic_vectors(top_words: DataFrame, vectors: DataFrame, keys=("topic",), pattern: str = TOKEN_PATTERN) -> DataFrame:
    """<keys..., dim, v>: mean over found top words of prob x word vector
    (a word's vector is the mean of its tokens')."""
    t = top_words.select(*keys, "word", "prob", F.explode(_toks(unjoin_terms("word"), pattern)).alias("tok"))
    j = t.join(bounded_broadcast(vectors.select(F.col("word").alias("tok"), "vec")), "tok")
    wv = vectors_long(j, *keys, "word", "prob").groupBy(*keys, "word", "prob", "dim").agg(F.avg("v").alias("wv"))
    return wv.groupBy(*keys, "dim").agg(F.avg(F.col("prob") * F.col("wv")).alias("v"))


def label_scores_embedding(top_words: DataFrame, thes: DataFrame, vectors: DataFrame, keys=("topic",),
                           pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """<keys..., label, score>: cosine of the topic vector and each label vector."""
    tv = topic_vectors(top_words, vectors, keys, pattern)
    lv = label_vectors(phrase_vectors(thes, vectors, pattern, lemmas))
    return cosines(tv, lv, list(keys), ["label"])


# ------------------------------------------------------------------ ranking

def top_labels(scores: DataFrame, labels: DataFrame, n: int = 4, keys=("topic",), rnd: int = 2,
               missing: str = "zero", key_rows: DataFrame | None = None) -> DataFrame:
    """Best n labels per key: score desc, label asc (Q14); score rounded to ``rnd``.

    Labels absent from ``scores`` score 0 (``missing='zero'``) or NULL and rank
    last (embedding, ``missing='null'``, Q16); they are added for the keys of
    ``key_rows``, or of ``scores``.
    """
    key_rows = (scores if key_rows is None else key_rows).select(*keys).distinct()
    fill = paired_in_blocks(key_rows, labels.select(F.lower("label").alias("label")).distinct())
    fill = fill.withColumn("score", F.lit(0.0) if missing == "zero" else F.lit(None).cast("double"))
    cand = scores.select(*keys, "label", "score").unionByName(fill).groupBy(*keys, "label").agg(F.max("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col("label"))
    ranked = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select(*keys, "rank", "label", F.round("score", rnd).alias("score"))


def label_topics(top_words: DataFrame, thes: DataFrame, vectors: DataFrame | None = None, top_n: int = 1,
                 score_type: str = "embedding", raw: bool = False, keys=("topic",),
                 pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """Public entry: labels for any number of topics given as <keys..., word, prob>.

    A topic without any vector gets no embedding label (Q16); by TF-IDF every
    topic gets labels, also of score 0.
    """
    if score_type == "tfidf":
        scores = label_scores_tfidf(top_words, thes, keys, pattern, lemmas)
    elif score_type == "embedding":
        if vectors is None:
            raise ValueError("embedding labels need word vectors")
        scores = label_scores_embedding(top_words, thes, vectors, keys, pattern, lemmas)
    else:
        raise ValueError("score_type must be tfidf or embedding")
    if raw:
        return scores
    if score_type == "tfidf":
        return top_labels(scores, thes.select("label"), top_n, keys, key_rows=top_words)
    return top_labels(scores, thes.select("label"), top_n, keys, missing="null")


def label_model_topics(topic_term: DataFrame, share: DataFrame, thes: DataFrame, vectors: DataFrame | None = None,
                       score_type: str = "tfidf", n_words: int = 10, top_n: int = 4, raw: bool = False,
                       pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """Labels of all topics of a dynamic model: share-weighted top words, best 4."""
    from topicspark.operators.topics import top_words
    tw = top_words(topic_term, share, n=n_words)
    return label_topics(tw, thes, vectors, top_n, score_type, raw, pattern=pattern, lemmas=lemmas)


def label_static_topics(static: DataFrame, thes: DataFrame, vectors: DataFrame | None = None,
                        score_type: str = "tfidf", n_words: int = 10, top_n: int = 4, keys=("topic",),
                        raw: bool = False, pattern: str = TOKEN_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """Same for static models: top 10 words by prob, best n labels."""
    from topicspark.operators.topics import top_words_static
    tw = top_words_static(static, n=n_words, keys=keys)
    return label_topics(tw, thes, vectors, top_n, score_type, raw, keys=keys, pattern=pattern, lemmas=lemmas)


def label_share_over_time(topic_term: DataFrame, thes: DataFrame, vectors: DataFrame, n: int = 10,
                          normalised: bool = True, step: str = "step", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Embedding score of every label per (topic, step), raw or divided by the
    (topic, step) score sum (Q15: may be <= 0; try_divide). <topic, step, label, value>."""
    from topicspark.operators.topics import top_words_over_time
    tw = top_words_over_time(topic_term, n=n, step=step)
    s = label_scores_embedding(tw, thes, vectors, ("topic", step), pattern)
    if not normalised:
        return s.withColumnRenamed("score", "value")
    tot = F.sum("score").over(Window.partitionBy("topic", step))
    return s.select("topic", step, "label", F.try_divide(F.col("score"), tot).alias("value"))


def label_share_views(label_share: DataFrame, labels: list[str] | None = None, step: str = "step") -> dict:
    """The two other return types: ``map`` (<topic, step, scores map<label, value>>)
    and ``matrix`` (one column per label, in label order; pass ``labels`` to
    skip the distinct-values job)."""
    as_map = label_share.groupBy("topic", step).agg(
        F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("scores"))
    matrix = label_share.groupBy("topic", step).pivot("label", sorted(labels) if labels else None).agg(F.first("value"))
    return {"map": as_map, "matrix": matrix}


def chosen_labels_over_time(label_share: DataFrame, labels: list[str], step: str = "step") -> DataFrame:
    """(topic, step, label without code, value) for the chosen labels."""
    chosen = [x.lower() for x in labels]
    return label_share.filter(F.col("label").isin(chosen)).select(
        "topic", step, strip_label_code("label", r"\d{4} ").alias("label"), "value")
