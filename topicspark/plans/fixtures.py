"""Model-shaped tables derived from the driver tables (FIXTURES.md section 4).

Each one is a plain Spark expression with a DuckDB twin in
``topicspark.plans.oracle`` so the two engines can be compared.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicspark.functions import LETTER_SPLIT, measured_broadcast, ordered_index, tokens
from topicspark.functions.ids import BROADCAST_BYTES, measured_bytes
from topicspark.functions.runs import together

N_TOPICS = 6
VOCAB_MIN_COUNT = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + step: 23 steps 1997..2020 with 1998 absent."""
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 23
    step = (F.lit(1997) + m + F.when(m >= 1, 1).otherwise(0)).cast("int")
    return d.select("doc_id", "text", "lang", "source", step.alias("step"))


def fx_tokens(corpus: DataFrame) -> DataFrame:
    """One row per token: lower(text) split on non-letters, 0-based pos."""
    arr = tokens("text", LETTER_SPLIT)
    # an outer explode, as the other one has its array computed once more to filter on its size
    return corpus.select("doc_id", "lang", "source", "step", F.posexplode_outer(arr).alias("pos", "w")).where("pos is not null")


def fx_vocab(tok: DataFrame, min_count: int = VOCAB_MIN_COUNT) -> DataFrame:
    """Words with count > min_count; word_id by count desc, word asc."""
    counts = tok.groupBy("w").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > min_count)
    ids = ordered_index(counts, [F.desc("cnt"), F.asc("w")], name="word_id")
    return ids.select("word_id", F.col("w").alias("word"), "cnt")


def _listed(batches):
    """<doc_id, step, tokens> of rows <_row, doc_id, step, w>, a row's next to each other."""
    for rows, starts in together(batches, "_row"):
        offsets = pa.array([*starts, rows.num_rows], pa.int32())
        own = rows.select(["doc_id", "step"]).take(starts).combine_chunks()
        listed = pa.ListArray.from_arrays(offsets, rows.column("w").combine_chunks())
        yield from pa.table([*own.columns, listed], ["doc_id", "step", "tokens"]).to_batches()


def fx_vocab_docs(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """<doc_id, step, tokens>: each document's vocabulary words in their order. Rows of
    one doc_id are one document; documents without such words are left out.

    A vocabulary of bounded size is broadcast, and a row's words stay in its task. Only
    documents whose doc_id repeats are gathered by it."""
    words = vocab.select(F.col("word").alias("w"))

    def gathered(rows, words):
        return fx_tokens(rows).join(words, "w").groupBy("doc_id").agg(
            F.first("step").alias("step"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("tokens"))
    if measured_bytes(words) > BROADCAST_BYTES:
        return gathered(corpus, words)
    words = F.broadcast(words)
    again = corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")).checkpoint(eager=True)
    some, again = not again.isEmpty(), measured_broadcast(again)
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    once = corpus.join(again, same, "left_anti") if some else corpus
    once = once.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "step", "text")
    each = once.select("_row", "doc_id", "step", F.explode_outer(tokens("text", LETTER_SPLIT)).alias("w")).join(words, "w")
    kind = corpus.schema["doc_id"].dataType.simpleString()
    docs = each.select("_row", "doc_id", "step", "w").mapInArrow(_listed, f"doc_id {kind}, step int, tokens array<string>")
    return docs.unionByName(gathered(corpus.join(again, same, "left_semi"), words)) if some else docs


def topic_of_source(source="source") -> F.Column:
    return (F.substring(F.col(source), 4, 100).cast("int") % N_TOPICS).cast("int")


def fx_doc_topic(corpus: DataFrame) -> DataFrame:
    """documents x topics 0..5 with weight ((doc_id*31 + topic*17) % 97 + 1) / 10."""
    d = corpus.select("doc_id", "step", F.explode(F.sequence(F.lit(0), F.lit(N_TOPICS - 1))).alias("topic"))
    w = ((F.col("doc_id") * 31 + F.col("topic") * 17) % 97 + 1).cast("double") / 10.0
    return d.select("doc_id", "step", "topic", w.alias("weight"))


def _word_shares(words: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """<keys, word_id, word, prob>: each vocabulary word's share of its group's words ``w``."""
    # other words than the vocabulary's are dropped before they are counted, and words are counted by their ids
    v = measured_broadcast(vocab.select("word_id", F.col("word").alias("w")))
    c = words.join(v, "w").groupBy(*keys, "word_id").agg(F.count(F.lit(1)).alias("c"))
    tot = F.sum("c").over(Window.partitionBy(*keys))
    return c.select(*keys, "word_id", (F.col("c") / tot).alias("prob")).join(v, "word_id").select(*keys, "word_id", F.col("w").alias("word"), "prob")


def fx_topic_term(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """Per (topic, step): prob of each vocabulary word = count / total."""
    return _word_shares(tok.select(topic_of_source().alias("topic"), "step", "w"), vocab, ["topic", "step"])


def fx_model(tok: DataFrame, vocab: DataFrame, n_models: int = 2) -> DataFrame:
    """Static models: model = floor(doc_id / 20) % n_models, prob per (model, topic)."""
    own = tok.select(
        (F.floor(F.col("doc_id") / 20) % n_models).cast("int").alias("model"), topic_of_source().alias("topic"), "w")
    return _word_shares(own, vocab, ["model", "topic"])


def fx_word_vec(spark: SparkSession, sf_dir: str, vocab: DataFrame) -> DataFrame:
    """A vector for every vocabulary word: word_id modulo the number of embeddings = vec_id."""
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.count(F.lit(1))).scalar()
    keyed = vocab.withColumn("_v", F.pmod("word_id", n))
    return keyed.join(e, F.col("_v") == F.col("vec_id")).select("word", F.col("embedding").alias("vec"))


def fx_vec_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding row is a phrase (its id) of label ``L<label>``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("phrase"),
                    F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"),
                    F.col("embedding").alias("vec"))


# Fixed test values: a small thesaurus whose phrases occur in the English
# prose of ``documents`` (position, phrase, label).
THESAURUS_ROWS = [
    (0, "the", "6611 A"),
    (1, "of the", "6611 A"),
    (2, "the and", "6616 B"),
    (3, "and", "6616 B"),
    (4, "to", "6621 C"),
    (5, "for the", "6621 C"),
    (6, "in", "0821 D"),
    (7, "and the", "0821 D"),
    (8, "is", "2016 E"),
    (9, "with", "2016 E"),
    (10, "on the", "6626 F"),
    (11, "the of", "6626 F"),
    (12, "by", "7621 G"),
]

# Fixed test values: theme -> keywords, with nested phrases in one theme.
THEMES = {
    "alpha": ["the", "of the", "the of", "the of the"],
    "beta": ["and", "and the", "the and"],
    "gamma": ["for", "for the", "to"],
    "delta": ["in", "is", "with the"],
}


def fx_thesaurus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THESAURUS_ROWS, "pos long, phrase string, label string")


def fx_themes(spark: SparkSession) -> DataFrame:
    rows = [(t, k) for t, ks in THEMES.items() for k in ks]
    return spark.createDataFrame(rows, "theme string, keyword string")


def fx_part_thesaurus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("phrase")).agg(F.min("p_type").alias("label"))


def fx_null_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("text")))


# Fixed test values: thesaurus labels by part type (MT) and size (domain);
# several need the remapping / correction tables, two share a category.
EUROVOC_MT = [
    ("STANDARD", 25, "2016 Trade"),
    ("STANDARD", 50, "2006 Trade policy"),
    ("ECONOMY", 25, "1621 Economic structure"),
    ("ECONOMY", 50, "1606 Economic policy"),
    ("MEDIUM", 50, "6626 Soft energy"),
    ("PROMO", 50, "6616 Oil industry"),
    ("LARGE", 50, "6621 Electrical and nuclear industries"),
    ("SMALL", 50, "0821 Defence"),
]


def eurovoc_mt(p_type="p_type", p_size="p_size") -> F.Column:
    e = None
    for t, max_size, label in EUROVOC_MT:
        cond = (F.col(p_type) == t) & (F.col(p_size) <= max_size)
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return e


def fx_eurovoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EuroVoc-shaped thesaurus from ``part``: <pos, phrase, MT, domain>."""
    p = table(spark, sf_dir, "part")
    domain = F.when(F.col("p_size") % 2 == 0, F.lit("2026 Consumption")).otherwise(F.lit("6606 Energy policy"))
    return p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("phrase"),
                    eurovoc_mt().alias("MT"), domain.alias("domain"))
