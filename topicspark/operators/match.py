"""Phrase matching and theme counts.

Texts and phrases are cut into tokens by one pattern: words, and runs of
punctuation or newlines, which are tokens too and so separate words. Phrases
match by lemma where a <form, lemma> table is given, on both sides; the matched
surface text is carried along.

Plan for ``phrase_match``: a dictionary of bounded size is compiled into the
expression. A document's tokens are asked once each whether a phrase begins with
them (in any form of its lemma); only there windows are made, of the lengths of
those phrases, and only windows that equal a phrase leave the row. Nothing is
exchanged. A larger dictionary meets the windows of all documents in a shuffled
join. Overlaps are resolved in time linear in the matches, inside the row for
``measure_space`` and by windows over (document, theme) for a table of matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import MATCH_PATTERN
from topicspark.functions.tables import bounded_rows, fits, let, lookup, member


def match_tokens(text, pattern: str = MATCH_PATTERN) -> Column:
    """Lowercase tokens of a text, punctuation and newline runs included; null text has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def lemma_array(df: DataFrame, lemmas: DataFrame | None, col: str, key: str) -> DataFrame:
    """``df`` with the token array ``col`` replaced by lemmas."""
    if lemmas is None:
        return df
    from topicspark.operators.text import lemmatize
    return lemmatize(df.withColumn(col, F.array(col)), lemmas, col, key).withColumn(col, F.flatten(col))


# ---------------------------------------------------------------- compiled dictionaries

def compiled_spans(keys, lemma_of: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """A function from a token array to the spans that equal one of ``keys``
    (space-joined tokens or lemmas): array<struct<start, end, key>> by start and length.

    ``lemma_of`` maps the forms whose lemma is another word.
    """
    lemma_of = lemma_of or {}
    words = {w for k in keys for w in k.split(" ")}
    # forms of the dictionary's words; a form that means another word must not pass for its own
    forms = {f: lem for f, lem in lemma_of.items() if lem in words or f in words}
    lengths: dict[str, set[int]] = {}
    for k in keys:
        toks = k.split(" ")
        lengths.setdefault(toks[0], set()).add(len(toks))
    first = {w: sorted(n) for w, n in lengths.items() if forms.get(w, w) == w}
    first |= {f: sorted(lengths[lem]) for f, lem in forms.items() if lem in lengths}
    sizes, known = lookup(first, "array<int>"), member(keys)
    lemma = lookup(forms) if forms else None

    def spans_of(toks: Column) -> Column:
        def key_of(i, n):
            part = F.slice(toks, i + 1, n)
            return F.array_join(F.transform(part, lambda x: F.coalesce(lemma(x), x)) if lemma else part, " ")

        def at(i):
            return F.transform(sizes(F.get(toks, i)), lambda n: F.struct(
                i.alias("start"), (i + n).alias("end"), F.when(i + n <= F.size(toks), key_of(i, n)).alias("key")))
        begins = F.filter(F.transform(toks, lambda x, i: F.when(sizes(x).isNotNull(), i)), lambda i: i.isNotNull())
        return F.filter(F.flatten(F.transform(begins, at)), lambda m: m["key"].isNotNull() & known(m["key"]))
    return lambda toks: let(toks, spans_of)


_WORD = 60  # tokens that one number marks as taken


def chosen_spans(spans: Column, size: Column) -> Column:
    """Non-overlapping spans of array<struct<start, end, key>>: the longest text
    first, then leftmost; by start.

    Taken tokens are marks in an array of numbers (60 tokens each), so a span is
    checked in one or two places however many there are.
    """
    none = F.array().cast("array<struct<start:int,end:int,key:string>>")
    marks = F.transform(F.sequence(F.lit(0), (size / _WORD).cast("int")), lambda _: F.lit(0).cast("long"))

    def mask(m, k):
        lo, hi = F.greatest(m["start"] - k * _WORD, F.lit(0)), F.least(m["end"] - k * _WORD, F.lit(_WORD))
        one = F.lit(1).cast("long")
        return F.call_function("shiftleft", F.call_function("shiftleft", one, hi - lo) - 1, lo)

    def step(acc, m):
        first, last = (m["start"] / _WORD).cast("int"), ((m["end"] - 1) / _WORD).cast("int")
        free = F.forall(F.sequence(first, last), lambda k: F.get(acc["marks"], k).bitwiseAND(mask(m, k)) == 0)
        marked = F.transform(acc["marks"], lambda v, k: F.when((k >= first) & (k <= last), v.bitwiseOR(mask(m, k))).otherwise(v))
        taken = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["key"].alias("key"))
        return F.when(free, F.struct(marked.alias("marks"), F.array_append(acc["kept"], taken).alias("kept"))).otherwise(acc)
    def chosen(own):
        ranked = F.array_sort(F.transform(own, lambda m: F.struct((-F.length(m["key"])).alias("neg_len"), m["start"].alias("start"), m["end"].alias("end"), m["key"].alias("key"))))
        return F.when(F.size(own) < 2, own).otherwise(
            F.aggregate(ranked, F.struct(marks.alias("marks"), none.alias("kept")), step, lambda acc: F.array_sort(acc["kept"])))
    return let(spans, chosen)


class Dictionary:
    """A compiled dictionary: the matches of a token array, inside the row."""

    def __init__(self, labels: dict[str, list[str]], lemma_of: dict[str, str]):
        self.spans = compiled_spans(list(labels), lemma_of) if labels else None
        self.labels = lookup({k: sorted(v) for k, v in labels.items()}, "array<string>")

    def matches(self, toks: Column) -> Column:
        """array<struct<label, start, end, term>>: all spans that equal a phrase, for each of its labels; ``term`` is the surface text."""
        if self.spans is None:
            return F.array().cast("array<struct<label:string,start:int,end:int,term:string>>")

        def labelled(t, m):
            term = F.array_join(F.slice(t, m["start"] + 1, m["end"] - m["start"]), " ")
            return F.transform(self.labels(m["key"]), lambda lab: F.struct(lab.alias("label"), m["start"].alias("start"), m["end"].alias("end"), term.alias("term")))
        # bound, since a filter on the matches would be pushed below whatever makes the tokens
        return let(toks, lambda t: F.flatten(F.transform(self.spans(t), lambda m: labelled(t, m))))


def compile_phrases(phrases: DataFrame, phrase: str = "keyword", label: str = "theme",
                    pattern: str = MATCH_PATTERN, lemmas: DataFrame | None = None) -> Dictionary | None:
    """The dictionary of a <phrase, label> table; None where it, or the forms of its words, are too many.

    Phrases come to the driver as tokens, and of a lemma table the forms of
    their words (the whole table where that is bounded).
    """
    rows = bounded_rows(phrases.select(match_tokens(phrase, pattern).alias("t"), F.col(label).cast("string").alias("label")).where(F.size("t") > 0).distinct())
    if rows is None:
        return None
    lemma_of: dict[str, str] = {}
    if lemmas is not None and rows:
        lemma_of = _lemmas_of({w for r in rows for w in r["t"]}, lemmas)
        if lemma_of is None:
            return None
    labels: dict[str, list[str]] = {}
    for r in rows:
        if r["label"] is not None:
            own = labels.setdefault(" ".join(lemma_of.get(w, w) for w in r["t"]), [])
            if r["label"] not in own:
                own.append(r["label"])
    return Dictionary(labels, lemma_of) if fits(labels) else None


def _lemmas_of(words: set[str], lemmas: DataFrame) -> dict[str, str] | None:
    """What the lemma table says of the phrases' words and of all forms with the same lemmas."""
    from topicspark.operators.text import _changes, lemma_entries
    known = lemma_entries(lemmas)
    if known is None:
        if not fits(dict.fromkeys(words)):
            return None
        changes = _changes(lemmas)
        own = {r["form"]: r["lemma"] for r in changes.where(member(words)(F.col("form"))).collect()}
        named = member({own.get(w, w) for w in words})
        rows = bounded_rows(changes.where(named(F.col("lemma")) | named(F.col("form"))))
        known = None if rows is None else own | {r["form"]: r["lemma"] for r in rows}
        return known if known is not None and fits(known) else None
    return known


# ---------------------------------------------------------------- larger dictionaries

def phrase_keys(phrases: DataFrame, phrase: str = "keyword", label: str = "theme",
                pattern: str = MATCH_PATTERN, lemmas: DataFrame | None = None) -> DataFrame:
    """Dictionary <key, label, n>: phrase tokens (lemmas) joined by single spaces."""
    pairs = phrases.select(F.col(phrase).alias("_p"), F.col(label).alias("label")).distinct()
    toks = pairs.select("_p").distinct().withColumn("_t", match_tokens("_p", pattern))
    toks = lemma_array(toks, lemmas, "_t", "_p")
    keyed = pairs.join(toks, "_p") if lemmas is not None else pairs.withColumn("_t", match_tokens("_p", pattern))
    return (keyed.select(F.array_join("_t", " ").alias("key"), "label", F.size("_t").alias("n"))
            .filter(F.col("n") > 0).distinct())


def windows(toks: Column, lengths: list[int], surface: Column | None = None) -> Column:
    """All token windows of the given lengths: array<struct<start, end, key, surface>>."""
    surface = toks if surface is None else surface

    def win_of(n):
        return lambda i: F.struct(i.cast("int").alias("start"), (i + n).cast("int").alias("end"),
                                  F.array_join(F.slice(toks, i + 1, n), " ").alias("key"),
                                  F.array_join(F.slice(surface, i + 1, n), " ").alias("surface"))
    parts = []
    for n in sorted(set(lengths)):
        w = F.transform(F.sequence(F.lit(0), F.size(toks) - n), win_of(n))
        parts.append(F.when(F.size(toks) >= n, w).otherwise(
            F.array().cast("array<struct<start:int,end:int,key:string,surface:string>>")))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def window_matches(df: DataFrame, dictionary: DataFrame, keys, toks: str = "toks", surface: str | None = None) -> DataFrame:
    """<keys..., label, start, end, key, surface> for every window equal to a dictionary key.

    ``dictionary`` is <key, label> (key: space-joined tokens). Overlaps are
    kept. Only the distinct phrase lengths come to the driver.
    """
    d = dictionary.select("key", "label").distinct()
    lengths = [r[0] for r in d.select(F.size(F.split("key", " ")).alias("n")).distinct().collect()]
    if not lengths:
        return df.select(*keys, F.lit("").alias("label"), F.lit(0).alias("start"), F.lit(0).alias("end"),
                         F.lit("").alias("key"), F.lit("").alias("surface")).limit(0)
    wins = windows(F.col(toks), lengths, F.col(surface or toks))
    ex = df.select(*keys, F.explode(wins).alias("w")).select(*keys, "w.start", "w.end", "w.key", "w.surface")
    # neither side is broadcast: the plan's estimate knows nothing of the windows
    return ex.join(d.hint("merge"), "key").select(*keys, "label", "start", "end", "key", "surface")


def phrase_match(df: DataFrame, themes: DataFrame, toks: str = "toks", key: str = "doc_id",
                 phrase: str = "keyword", label: str = "theme", pattern: str = MATCH_PATTERN,
                 lemmas: DataFrame | None = None) -> DataFrame:
    """All spans whose tokens (or lemmas, given a table) equal a keyword's; overlaps included.

    ``toks`` holds the documents' surface tokens (``match_tokens``). Returns
    <key, theme, start, end, term>, term being the surface text.
    """
    compiled = compile_phrases(themes, phrase, label, pattern, lemmas)
    if compiled is not None:
        # an outer explode, as the other one has its array computed once more to filter on its size
        m = df.select(key, F.explode_outer(compiled.matches(F.col(toks))).alias("m")).where("m is not null")
        return m.select(key, F.col("m.label").alias(label), "m.start", "m.end", "m.term")
    docs = df.select(key, F.col(toks).alias("_s"), F.col(toks).alias("_l"))
    docs = lemma_array(docs, lemmas, "_l", key)
    m = window_matches(docs, phrase_keys(themes, phrase, label, pattern, lemmas), [key], "_l", "_s")
    return m.select(key, F.col("label").alias(label), "start", "end", F.col("surface").alias("term"))


# ---------------------------------------------------------------- dedupe folds

def dedupe_matches(matches: DataFrame, mode: str = "fold", key: str = "doc_id", label: str = "theme") -> DataFrame:
    """Per (document, theme) drop spans covered by a longer one.

    mode='fold' is the reference's exact fold (Q1) in (start, end, term) order:
    a span starting after the one before it ends, or overlapping it and ending
    later, is kept; one with the same start replaces the last kept; others are
    skipped. 'longest' keeps spans not contained in another of the same theme;
    'simple' is the older variant without theme grouping and without the
    same-start case.
    """
    m = matches.select(key, label, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "term")
    if mode == "longest":
        w = Window.partitionBy(key, label).orderBy("start", F.desc("end"), "term").rowsBetween(Window.unboundedPreceding, -1)
        seen = F.coalesce(F.max("end").over(w), F.lit(-1))
        return m.distinct().withColumn("_seen", seen).filter(F.col("end") > F.col("_seen")).drop("_seen")
    groups = [key] if mode == "simple" else [key, label]
    order = ["start", "end", "term", *([label] if mode == "simple" else [])]
    w = Window.partitionBy(*groups).orderBy(*order)
    ps, pe = F.lag("start").over(w), F.lag("end").over(w)
    overlaps = (F.col("start") < F.col("_pe")) & (F.col("end") > F.col("_pe"))
    apart = F.col("_pe").isNull() | (F.col("start") > F.col("_pe"))
    act = F.when(apart, "push")
    if mode == "fold":
        act = act.when(F.col("start") == F.col("_ps"), "replace")
    act = act.when(overlaps, "push").otherwise("skip")
    kept = m.withColumn("_ps", ps).withColumn("_pe", pe).withColumn("_a", act).filter(F.col("_a") != "skip")
    if mode == "fold":  # a replacing span takes the place of the one kept before it
        kept = kept.withColumn("_n", F.lead("_a").over(w)).filter(F.coalesce(F.col("_n"), F.lit("")) != "replace")
    return kept.select(key, label, "start", "end", "term")


def reduce_matches(matches: DataFrame, key: str = "doc_id", label: str = "theme") -> DataFrame:
    return dedupe_matches(matches, "simple", key, label)


def _in_order(m: Column, mode: str) -> Column:
    label, where = [m["label"].alias("label")], [m["start"].alias("start"), m["end"].alias("end"), m["term"].alias("term")]
    return F.struct(*where, *label) if mode == "simple" else F.struct(*label, *where)


def folded(matches: Column, mode: str = "fold") -> Column:
    """``dedupe_matches`` (modes 'fold' and 'simple') of one document's matches,
    an array in that order, inside the row: each is held against the one before it."""
    def act(m, i):
        before = F.get(matches, i - 1)
        apart = (i == 0) | (m["start"] > before["end"])
        if mode == "fold":
            apart = apart | (m["label"] != before["label"])
        overlaps = (m["start"] < before["end"]) & (m["end"] > before["end"])
        out = F.when(apart, "push")
        if mode == "fold":
            out = out.when(m["start"] == before["start"], "replace")
        return F.struct(out.when(overlaps, "push").otherwise("skip").alias("act"), m.alias("m"))
    def replaced(kept):  # a replacing span takes the place of the one kept before it
        def stays(x, i):
            after = F.get(kept, i + 1)
            return F.coalesce((after["act"] != "replace") | (after["m"]["label"] != x["m"]["label"]), F.lit(True))
        return F.filter(kept, stays)
    kept = F.filter(F.transform(matches, act), lambda x: x["act"] != "skip")
    return F.transform(let(kept, replaced) if mode == "fold" else kept, lambda x: x["m"])


def count_of(names: Column) -> Column:
    """map<name, n> of an array of names, in order of name."""
    def counted(ordered, begins):
        return F.transform(begins, lambda i, k: F.struct(F.get(ordered, i).alias("name"), (F.coalesce(F.get(begins, k + 1), F.size(ordered)) - i).cast("long").alias("n")))

    def begins(ordered):
        return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
    entries = let(F.array_sort(names), lambda ordered: let(begins(ordered), lambda at: counted(ordered, at)))
    return F.when(F.size(names) > 0, F.map_from_entries(entries)).otherwise(F.create_map().cast("map<string,bigint>"))


# ---------------------------------------------------------------- counts

def theme_counts(kept: DataFrame, key: str = "doc_id", label: str = "theme") -> DataFrame:
    return kept.groupBy(key, label).agg(F.count(F.lit(1)).alias("cnt"))


def term_counts(kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matched surface text (lowercase tokens) per document over all themes."""
    return kept.groupBy(key, "term").agg(F.count(F.lit(1)).alias("cnt"))


def measure_space(df: DataFrame, themes: DataFrame, text: str = "text", key: str = "doc_id",
                  prefix: str = "theme_", mode: str = "fold", pattern: str = MATCH_PATTERN,
                  lemmas: DataFrame | None = None) -> DataFrame:
    """Corpus enriched with ``<prefix>counts`` (theme -> n) and ``<prefix>terms``
    (surface text -> n). Null text counts as empty; the text column keeps its null."""
    if mode != "longest" and (compiled := compile_phrases(themes, pattern=pattern, lemmas=lemmas)) is not None:
        def measured(found):
            return let(folded(found, mode), lambda kept: F.struct(count_of(F.transform(kept, lambda m: m["label"])).alias("counts"),
                                                                  count_of(F.transform(kept, lambda m: m["term"])).alias("terms")))
        found = F.array_sort(F.transform(compiled.matches(match_tokens(text, pattern)), lambda m: _in_order(m, mode)))
        m = df.select("*", let(found, measured).alias("_m"))
        return m.select(*df.columns, F.col("_m.counts").alias(prefix + "counts"), F.col("_m.terms").alias(prefix + "terms"))
    docs = df.select(key, match_tokens(text, pattern).alias("toks"))
    kept = dedupe_matches(phrase_match(docs, themes, "toks", key, pattern=pattern, lemmas=lemmas), mode, key)
    # both counts in one frame, regrouped once per document; a map's entries are ready-made
    both = kept.select(key, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("theme").alias("name")),
                                              F.struct(F.lit(1).alias("k"), F.col("term").alias("name")))).alias("e"))
    counts = both.groupBy(key, "e.k", "e.name").agg(F.count(F.lit(1)).alias("n"))

    def count_map(k):
        entries = F.collect_list(F.when(F.col("k") == k, F.struct("name", "n")))
        return F.map_from_entries(F.array_sort(entries))
    maps = counts.groupBy(key).agg(count_map(0).alias(prefix + "counts"), count_map(1).alias(prefix + "terms"))
    empty = F.create_map().cast("map<string,bigint>")
    out = df.join(maps, key, "left")
    return (out.withColumn(prefix + "counts", F.coalesce(prefix + "counts", empty))
               .withColumn(prefix + "terms", F.coalesce(prefix + "terms", empty)))


def theme_trend(measured: DataFrame, by: str = "step", prefix: str = "theme_") -> DataFrame:
    """Theme counts summed per step (or per source): <by, theme, cnt>."""
    ex = measured.select(by, F.explode(prefix + "counts").alias("theme", "n"))
    return ex.groupBy(by, "theme").agg(F.sum("n").alias("cnt"))


def select_spans(matches: DataFrame, keys) -> DataFrame:
    """Non-overlapping spans per key group for n-gram joining (Q5): the longest
    text first, then leftmost. Returns <keys..., spans array<struct<start, end,
    key>>> in order of start."""
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("key").alias("key"))
    g = matches.groupBy(*keys).agg(F.collect_list(span).alias("_m"), F.max("end").alias("_end"))
    return g.select(*keys, chosen_spans(F.col("_m"), F.col("_end")).alias("spans"))
