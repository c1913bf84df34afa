"""Text preprocessing.

Documents become ``sents array<array<string>>``. All rules are array
higher-order functions evaluated inside the row (no UDF, no shuffle); lookups
against word lists use ``IN`` lists, which Catalyst turns into hash sets.
Tables of bounded size (lemmas, n-grams) are compiled into the expression, so
documents stay where they are. Of a larger lemma table each document asks for
its different forms only; a larger list of n-grams meets the windows in a join.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions import TOKEN_PATTERN, ordered_index
from topicspark.functions.tables import bounded_rows, fits, let, lookup

SENTENCE_SPLIT = r"[.!?]+\s+|\n+"
URL_PATTERN = r"(https?://|www\.)\S+"

# Number words treated like numbers by the token filter.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
    "hundred", "thousand", "million", "billion", "trillion",
]


_STOP_FILE = os.path.join(os.path.dirname(__file__), "..", "functions", "english_stopwords.txt")


def default_stopwords() -> list[str]:
    """Spark ML's default English stopword list (same as
    ``StopWordsRemover.loadDefaultStopWords('english')``), kept as a file so no
    JVM is needed to read it."""
    with open(_STOP_FILE, encoding="utf-8") as fh:
        return [w for w in fh.read().split("\n") if w]


def by_doc(df: DataFrame, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Hash-partition documents once by id; later per-document regrouping and
    joins on the id then reuse this partitioning (no further exchange)."""
    return df.repartition(partitions, key) if partitions else df.repartition(key)


def tokenize_sentences(df: DataFrame, text: str = "text", out: str = "sents",
                       pattern: str = TOKEN_PATTERN, sentence_split: str = SENTENCE_SPLIT,
                       strip_urls: bool = True) -> DataFrame:
    """Document -> sentences -> lowercase tokens. Null text -> no sentences."""
    t = F.coalesce(F.col(text), F.lit(""))
    if strip_urls:
        t = F.regexp_replace(t, URL_PATTERN, " ")
    sents = F.filter(F.split(t, sentence_split), lambda s: F.trim(s) != "")
    toks = F.transform(sents, lambda s: F.filter(F.split(F.lower(s), pattern), lambda x: x != ""))
    return df.withColumn(out, toks)


def filter_surface(df: DataFrame, col: str = "sents", stopwords: list[str] | None = None) -> DataFrame:
    """Rules on the surface form: drop numbers (all digits, or number words) and stopwords."""
    sw = default_stopwords() if stopwords is None else stopwords
    keep = lambda x: (~x.rlike(r"^\p{N}+$")) & (~x.isin(NUMBER_WORDS)) & (~x.isin(sw))
    return df.withColumn(col, F.transform(col, lambda s: F.filter(s, keep)))


def filter_lemmas(df: DataFrame, col: str = "sents") -> DataFrame:
    """Rules on the lemma: drop those that hold a digit or have length <= 1."""
    keep = lambda x: (~x.rlike(r"\p{N}")) & (F.length(x) > 1)
    return df.withColumn(col, F.transform(col, lambda s: F.filter(s, keep)))


def filter_tokens(df: DataFrame, col: str = "sents", stopwords: list[str] | None = None) -> DataFrame:
    """Both sets of rules on tokens that are their own lemmas. With a lemma table
    the surface rules come before it and the lemma rules after (``preprocess``)."""
    return filter_lemmas(filter_surface(df, col, stopwords), col)


def lemma_entries(lemmas: DataFrame) -> dict[str, str] | None:
    """<form, lemma> as a dictionary of what changes: lemmas in lower case, with
    '_' for spaces; of a form's lemmas the smallest. None for a table too large."""
    rows = bounded_rows(_changes(lemmas))
    known = None if rows is None else {r["form"]: r["lemma"] for r in rows}
    return known if known is not None and fits(known) else None


def _normal(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit(" "), F.lit("_"))


def _changes(lemmas: DataFrame) -> DataFrame:
    own = lemmas.select("form", _normal(F.col("lemma")).alias("lemma")).where("form is not null and lemma is not null")
    return own.groupBy("form").agg(F.min("lemma").alias("lemma")).where("form <> lemma")


def lemmatize(df: DataFrame, lemmas: DataFrame | None, col: str = "sents", key: str = "doc_id") -> DataFrame:
    """Lemma (from a <form, lemma> table; identity if missing), lowercase, inner space -> '_'.

    A table of bounded size is looked up inside the row, without an exchange.
    Of a larger one each document asks for its different forms: these are
    joined, and what they found is handed back to the document (``key``) once.
    """
    if lemmas is None:
        return df.withColumn(col, F.transform(col, lambda s: F.transform(s, _normal)))
    known = lemma_entries(lemmas)
    if known is not None:
        found = lookup(known) if known else None
        of = (lambda x: F.coalesce(found(x), _normal(x))) if known else _normal
        return df.withColumn(col, F.transform(col, lambda s: F.transform(s, of)))
    asked = df.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(F.flatten(col))).alias("form"))
    entries = asked.join(_changes(lemmas), "form").groupBy(key).agg(F.collect_set(F.struct("form", "lemma")).alias("_known"))
    both = df.join(entries, key, "left")
    # a document's entries by checksum, a map of about eight for each
    n = F.coalesce(F.ceil(F.size("_known") / 8), F.lit(1)).cast("int")
    place = lambda x: F.pmod(F.crc32(x.cast("binary")), n).cast("int")
    maps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.map_from_entries(F.filter("_known", lambda e: place(e["form"]) == i)))
    both = both.withColumn("_maps", F.when(F.col("_known").isNotNull(), maps))
    of = lambda x: F.coalesce(F.element_at(F.get("_maps", place(x)), x), _normal(x))
    return both.withColumn(col, F.transform(col, lambda s: F.transform(s, of))).select(*df.columns)


def drop_terms(df: DataFrame, col: str = "sents", blacklist: list[str] | None = None) -> DataFrame:
    """Remove blacklisted and empty tokens, keeping duplicates and order."""
    bl = blacklist or []
    return df.withColumn(col, F.transform(col, lambda s: F.filter(s, lambda x: (x != "") & ~x.isin(bl))))


def merge_sentences(df: DataFrame, col: str = "sents", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, F.flatten(col))


def merge_docs(df: DataFrame, col: str = "sents", out: str = "doc", keep_empty: bool = False) -> DataFrame:
    """One space-joined string per document; empty documents dropped unless keep_empty."""
    text = F.array_join(F.flatten(col), " ")
    if keep_empty:
        return df.withColumn(out, text)
    # a filter on a plain column is pushed below what makes it, and the whole text work is done twice
    return df.select(*[c for c in df.columns if c != out], F.explode_outer(F.array(text)).alias(out)).filter(F.col(out) != "")


def join_ngrams(df: DataFrame, ngrams: DataFrame, col: str = "sents") -> DataFrame:
    """Replace known n-grams by ``a_b_c`` inside each sentence (Q5, fixed semantics).

    The n-gram of longest text first, then leftmost; spans never overlap.
    ``ngrams`` is a one-column frame ``ngram`` of space-separated phrases. A
    sentence is rebuilt from the stretches between its spans, each cut out once.
    A list of bounded size is compiled into the expression, and documents stay
    where they are; a larger one meets the windows of all sentences in a join.
    """
    from topicspark.operators.match import chosen_spans, compiled_spans, select_spans, window_matches
    ng = ngrams.select(F.trim(F.col("ngram")).alias("ngram")).filter(F.col("ngram").contains(" ")).distinct()
    rows = bounded_rows(ng)
    if rows is not None and fits(dict.fromkeys(r["ngram"] for r in rows)):
        if not rows:
            return df
        found = compiled_spans([r["ngram"] for r in rows])
        return df.withColumn(col, F.transform(col, lambda s: _joined(s, chosen_spans(found(s), F.size(s)))))
    ng = ng.select(F.col("ngram").alias("key"), F.col("ngram").alias("label"))
    flat = df.select("doc_id", F.posexplode(col).alias("si", "toks"))
    matches = window_matches(flat, ng, keys=["doc_id", "si"], toks="toks")
    kept = select_spans(matches, keys=["doc_id", "si"])
    j = flat.join(kept, ["doc_id", "si"], "left")
    per_sent = j.select("doc_id", "si", F.when(F.size("spans") > 0, _joined(F.col("toks"), F.col("spans"))).otherwise(F.col("toks")).alias("s"))
    per_doc = per_sent.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("si", "s"))), lambda x: x["s"]).alias("_s"))
    return df.drop(col).join(per_doc, "doc_id", "left").withColumnRenamed("_s", col).select(*df.columns)


def _joined(toks: Column, spans: Column) -> Column:
    """Tokens with each span, in order of start, as one word. A token goes where
    a span before it has not ended: at its start stands the span's text."""
    return let(spans, lambda own: _rebuilt(toks, own))


def _rebuilt(toks: Column, spans: Column) -> Column:
    none = F.lit(None).cast("string")
    # span i, then the tokens up to the next span; before the first there is an empty span at 0
    edge = lambda at, key: F.array(F.struct(at.cast("int").alias("start"), at.cast("int").alias("end"), key.alias("key")))
    at = F.concat(edge(F.lit(0), none), spans, edge(F.size(toks), none))

    def piece(span, i):
        here = F.when(span["key"].isNotNull(), F.array(F.replace(span["key"], F.lit(" "), F.lit("_")))).otherwise(F.array().cast("array<string>"))
        return F.concat(here, F.slice(toks, span["end"] + 1, F.coalesce(F.get(spans, i)["start"], F.size(toks)) - span["end"]))
    return F.flatten(F.transform(F.slice(at, F.lit(1), F.size(spans) + 1), piece))


def preprocess(df: DataFrame, text: str = "text", ngrams: DataFrame | None = None,
               lemmas: DataFrame | None = None, stopwords: list[str] | None = None,
               blacklist: list[str] | None = None, pattern: str = TOKEN_PATTERN,
               out: str = "sents") -> DataFrame:
    """The whole pipeline: tokenize, filter surface forms, lemmatize, filter lemmas,
    n-grams (optional), drop terms."""
    res = tokenize_sentences(df, text, out, pattern=pattern)
    res = filter_lemmas(lemmatize(filter_surface(res, out, stopwords), lemmas, out), out)
    if ngrams is not None:
        res = join_ngrams(res, ngrams, out)
    return drop_terms(res, out, blacklist)


def build_ngram_list(raw: DataFrame, col: str = "value", keep_empty: bool = False, **kw) -> DataFrame:
    """Preprocess raw n-grams into one clean phrase per row (Q6), longest first."""
    base = ordered_index(raw.select(F.col(col).alias("text")), ["text"], "doc_id")
    pre = preprocess(base, **kw)
    merged = merge_docs(pre, keep_empty=keep_empty)
    return merged.select(F.col("doc").alias("ngram")).orderBy(F.length("ngram").desc(), "ngram")


def lemmatize_text(df: DataFrame, lemmas: DataFrame | None = None, text: str = "text",
                   out: str = "lemma_text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """Lowercase text with lemmas, tokens joined by single spaces."""
    tok = tokenize_sentences(df, text, "_s", pattern=pattern, strip_urls=False)
    if lemmas is not None:
        tok = lemmatize(tok, lemmas, "_s")
    return tok.withColumn(out, F.array_join(F.flatten("_s"), " ")).drop("_s")


def sort_keywords(themes: DataFrame, reverse: bool = True, pattern: str = TOKEN_PATTERN,
                  lemmas: DataFrame | None = None) -> DataFrame:
    """Lemmatised keywords of each theme as an array sorted by length (longest first)."""
    toks = F.filter(F.split(F.lower("keyword"), pattern), lambda x: x != "")
    words = themes.select("keyword").distinct().withColumn("_t", F.array(toks))
    kw = lemmatize(words, lemmas, "_t", "keyword").select("keyword", F.array_join(F.flatten("_t"), " ").alias("kw"))
    g = themes.select("theme", "keyword").join(kw, "keyword").groupBy("theme").agg(F.collect_list("kw").alias("kws"))
    sign = -1 if reverse else 1

    def cmp(a, b):
        d = (F.length(a) - F.length(b)) * sign
        return F.when(d != 0, d).when(a < b, -1).when(a > b, 1).otherwise(0)
    return g.select("theme", F.array_sort("kws", cmp).alias("keywords"))
