"""End-to-end plans built from the operators: dataset building, model report,
comparison report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators import compare as C
from topicspark.operators import labels as L
from topicspark.operators import steps as S
from topicspark.operators import text as X
from topicspark.operators import topics as T
from topicspark.operators import vocab as V
from topicspark.session import ensure_checkpoint_dir


def build_dataset(corpus: DataFrame, text: str = "text", date_col: str = "date", date_fn=None,
                  min_freq: int = 150, min_tokens: int = 15, min_unique: int = 5, limit: int | None = None,
                  shuffle: bool = True, steps: list | None = None, step_map: DataFrame | None = None,
                  preprocessed: bool = True, **pre_kw) -> dict[str, DataFrame]:
    """Corpus -> dataset frames: <doc_id, step, doc_order, bow>, vocabulary, step counts.

    drop null text -> date to step -> keep the steps of ``steps`` (Q10) -> seeded
    order (and optional limit) -> tokens (split on spaces when already
    preprocessed, else the text pipeline) -> vocabulary -> per-doc counts ->
    document filter -> step map, ``steps`` order (``step_rank``) -> rows.
    """
    from topicspark.functions import year_of_date
    df = S.drop_null_text(corpus, text)
    df = S.date_to_step(df, date_col, date_fn or year_of_date, "step")
    if steps is not None:
        df = df.filter(F.col("step").isin(list(steps)))
    df = S.sample_docs(df, limit, shuffle=shuffle)
    if preprocessed:
        df = V.split_tokens(df, text, "tokens")
    else:
        df = X.merge_sentences(X.preprocess(df, text, **pre_kw), "sents", "tokens")
    tok = V.tokens_long(df, "tokens", keep=("doc_order",))
    voc = V.vocab(tok, min_freq)
    dtc = V.filter_docs(V.doc_term_counts(tok, voc), min_tokens, min_unique)
    docs = df.select("doc_id", "step", "doc_order")
    if steps is not None:
        place = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("step"))
        docs = docs.withColumn("step_rank", place - 1)
    rows = V.bow_rows(dtc).join(docs, "doc_id")
    if step_map is not None:
        rows = S.apply_step_map(rows, step_map, "step", "mapped")
    return {"bow": rows, "vocab": voc, "step_counts": V.step_counts(rows)}


def model_report(topic_term: DataFrame, share: DataFrame, thes: DataFrame, vectors: DataFrame | None = None,
                 n_words: int = 10, n_words_step: int = 30, model: str | None = None, keys=("topic",)) -> dict[str, DataFrame]:
    """Per topic: both label lists and top words; per (topic, step): share
    (3 decimals) and top words.

    The topics' top words feed three parts: they are made once and written
    (checkpoint), so that the model's table is read once for them and once for
    the words of the steps.
    """
    ensure_checkpoint_dir(topic_term.sparkSession)
    keys = list(keys)
    tw = T.top_words(topic_term, share, n=n_words, keys=keys).checkpoint(eager=True)
    words = tw.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))),
                                                           lambda x: x["word"]), " ").alias("top_words"))

    def label_list(lab):
        return lab.groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "label", "score"))),
            lambda x: F.concat(x["label"], F.lit(":"), x["score"].cast("string"))), ", ").alias("labels"))
    tfidf = label_list(L.label_topics(tw, thes, top_n=4, score_type="tfidf", keys=keys)).withColumnRenamed("labels", "tfidf_labels")
    topics = words.join(tfidf, keys, "left")
    if vectors is not None:
        emb = label_list(L.label_topics(tw, thes, vectors, top_n=4, score_type="embedding", keys=keys))
        topics = topics.join(emb.withColumnRenamed("labels", "emb_labels"), keys, "left")
    frame = T.top_words_frame(topic_term, n=n_words_step, keys=keys)
    steps = share.join(frame, [*keys, "step"], "left").select(
        *keys, "step", F.format_string("%05.3f", F.col("share")).alias("share"),
        F.array_join(F.coalesce("top_words", F.array()), " ").alias("top_words"))
    if model is not None:
        topics = topics.withColumn("model", F.lit(model))
        steps = steps.withColumn("model", F.lit(model))
    return {"topics": topics, "topic_steps": steps}


def grid_report(topic_term: DataFrame, share: DataFrame, thes: DataFrame, vectors: DataFrame | None = None,
                **kw) -> dict[str, DataFrame]:
    """``model_report`` of all runs of a grid as one plan, whatever their number:
    the tables of the runs (``discover_models``) have their names in ``model``."""
    return model_report(topic_term, share, thes, vectors, keys=("model", "topic"), **kw)


def compare_report(models: DataFrame, m1, m2, similar: float = 0.75, unique: float = 0.25,
                   n_words: int = 10, thes: DataFrame | None = None, lemmas: DataFrame | None = None) -> dict[str, DataFrame]:
    """Similar and unique topics of one model pair with their top words, and with
    their best label where a thesaurus is given; the heatmap's axes bear the
    labels' names then. The similarities and the best labels are made once and
    written (checkpoint)."""
    ensure_checkpoint_dir(models.sparkSession)
    sim = C.topic_similarity(models, m1, m2).checkpoint(eager=True)
    best = None
    if thes is not None:
        both = models.filter(F.col("model").isin([m1, m2]))
        best = L.label_static_topics(both, thes, top_n=1, n_words=n_words, keys=("model", "topic"), lemmas=lemmas).checkpoint(eager=True)

    def words(m):
        tw = T.top_words_static(models.filter(F.col("model") == m), n=n_words, with_prob=False)
        out = tw.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))),
                                                               lambda x: x["word"]), " ").alias("words"))
        return out if best is None else out.join(best.filter(F.col("model") == m).select("topic", "label"), "topic", "left")
    pair = f"{m1}_{m2}"
    w1, w2 = words(m1), words(m2)
    names = [None, None] if best is None else [C.topic_names(best.filter(F.col("model") == m)) for m in (m1, m2)]
    own = w1.withColumn("side", F.lit(1)).unionByName(w2.withColumn("side", F.lit(2)))
    return {
        "similar_topics": C.similar_topics(sim, w1, w2, similar).withColumn("pair", F.lit(pair)),
        "unique_topics": C.unique_topics(sim, unique).join(own, ["side", "topic"], "left").withColumn("pair", F.lit(pair)),
        "heatmap": C.similarity_matrix(sim, *names).withColumn("pair", F.lit(pair)),
    }
