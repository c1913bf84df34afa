"""Documents of vocabulary words, as fitting takes them."""

from topicspark.plans import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_of_vocabulary_words_are_not_exchanged_unless_ids_repeat(spark):
    schema = "doc_id long, text string, lang string, source string, step int"
    once = [(1, "A b; b x", "en", "src1", 2000), (2, "b-x a", "en", "src1", 2001), (3, "x", "en", "src1", 2002), (4, None, "en", "src1", 2003), (None, "a", "en", "src1", None)]
    voc = spark.createDataFrame([(0, "a"), (1, "b")], "word_id long, word string")
    df = fx.fx_vocab_docs(spark.createDataFrame(once, schema), voc)
    assert "Exchange hashpartitioning" not in _plan(df)
    want = {1: (2000, ["a", "b", "b"]), 2: (2001, ["b", "a"]), None: (None, ["a"])}
    assert {r.doc_id: (r.step, r.tokens) for r in df.collect()} == want
    twice = [*once, (1, "b a", "en", "src1", 2000), (None, "b b", "en", "src1", None)]
    rows = fx.fx_vocab_docs(spark.createDataFrame(twice, schema), voc).collect()
    assert len(rows) == 3
    assert {r.doc_id: (r.step, r.tokens) for r in rows} == want | {1: (2000, ["a", "b", "a", "b", "b"]), None: (None, ["a", "b", "b"])}
