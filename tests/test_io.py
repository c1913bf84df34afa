"""Sources and sinks: round trips on small files of the shapes in FIXTURES.md section 2."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import match as M
from topicspark.sources import files as R
from topicspark.sources import sinks as W


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def _cat(d):
    parts = sorted(p for p in os.listdir(d) if p.startswith("part-"))
    return "".join(open(os.path.join(d, p)).read() for p in parts)


def test_read_topic_term(spark, scratch):
    _write(f"{scratch}/lda-seq/topic-000-var-e-log-prob.dat", "\n".join(str(np.log(x)) for x in [.1, .2, .3, .4]) + "\n")
    _write(f"{scratch}/lda-seq/topic-001-var-e-log-prob.dat", "\n".join(str(np.log(x)) for x in [.5, .6, .7, .8]) + "\n")
    tt = R.read_topic_term(spark, f"{scratch}/lda-seq/topic-*-var-e-log-prob.dat", n_steps=2)
    got = sorted((r.topic, r.word_id, r.step_idx, round(r.prob, 6)) for r in tt.collect())
    assert got[:4] == [(0, 0, 0, 0.1), (0, 0, 1, 0.2), (0, 1, 0, 0.3), (0, 1, 1, 0.4)]
    assert got[4] == (1, 0, 0, 0.5)


def test_read_doc_topic_and_steps(spark, scratch):
    _write(f"{scratch}/gam.dat", "0.1\n0.9\n0.3\n0.7\n")
    dt = sorted((r.doc_idx, r.topic, r.weight) for r in R.read_doc_topic(spark, f"{scratch}/gam.dat", 2).collect())
    assert dt == [(0, 0, 0.1), (0, 1, 0.9), (1, 0, 0.3), (1, 1, 0.7)]
    _write(f"{scratch}/model-seq.dat", "2\n1\n1\n")
    sc = sorted((r.step_idx, r.n_docs) for r in R.read_step_counts(spark, f"{scratch}/model-seq.dat").collect())
    assert sc == [(0, 1), (1, 1)]
    _write(f"{scratch}/model-year.dat", "1997\n1999\n")
    ds = sorted((r.doc_idx, r.step) for r in R.read_doc_steps(spark, f"{scratch}/model-year.dat").collect())
    assert ds == [(0, 1997), (1, 1999)]


def test_vocab_round_trip(spark, scratch):
    voc = spark.createDataFrame([(1, "gas", 7), (0, "coal_mine", 9), (2, "sun", 5)], "word_id long, word string, cnt long")
    W.write_vocab(voc, f"{scratch}/vocab")
    assert _cat(f"{scratch}/vocab") == "coal_mine\t9\ngas\t7\nsun\t5\n"
    back = sorted((r.word_id, r.word, r.cnt) for r in R.read_vocab(spark, f"{scratch}/vocab").collect())
    assert back == [(0, "coal_mine", 9), (1, "gas", 7), (2, "sun", 5)]
    _write(f"{scratch}/static_vocab.txt", "coal\ngas\n")
    st = sorted((r.word_id, r.word, r.cnt) for r in R.read_vocab(spark, f"{scratch}/static_vocab.txt").collect())
    assert st == [(0, "coal", None), (1, "gas", None)]


def test_read_line_order_multi_block(spark, scratch):
    """Line numbers stay right when one file is read as several splits."""
    n = 20000
    _write(f"{scratch}/big.dat", "".join(f"{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = R.read_lines(spark, f"{scratch}/big.dat")
        bad = lines.filter(F.col("line") != F.col("value").cast("long")).count()
        assert lines.count() == n and bad == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_write_dataset(spark, scratch):
    bow = spark.createDataFrame([(10, 2001, 5, "2 0:1 1:1"), (11, 1999, 9, "1 0:3"), (12, 1999, 1, "1 1:2")],
                                "doc_id long, step int, doc_order long, bow string")
    W.write_dataset(bow, scratch)
    assert _cat(f"{scratch}/model-mult") == "1 1:2\n1 0:3\n2 0:1 1:1\n"
    assert _cat(f"{scratch}/model-year") == "1999\n1999\n2001\n"
    assert _cat(f"{scratch}/model-seq") == "2\n2\n1\n"


def test_read_bow(spark, scratch):
    _write(f"{scratch}/mult.dat", "2 0:2 1:1\n1 1:3\n")
    voc = spark.createDataFrame([(0, "coal"), (1, "gas")], "word_id long, word string")
    got = {r.doc_idx: r.tokens for r in R.read_bow(spark, f"{scratch}/mult.dat", voc).collect()}
    assert got == {0: ["coal", "coal", "gas"], 1: ["gas", "gas", "gas"]}


def test_step_map_json(spark, scratch):
    m = spark.createDataFrame([(201201, 0), (201202, 0), (201205, 1)], "step int, mapped int")
    W.write_step_map(m, f"{scratch}/map")
    assert json.loads(_cat(f"{scratch}/map")) == {"201201": 0, "201202": 0, "201205": 1}


def test_doc_topics_csv(spark, scratch):
    dt = spark.createDataFrame([(1, 2000, 0, 0.2), (1, 2000, 1, 0.8)], "doc_id long, step int, topic int, weight double")
    W.write_doc_topics(dt, f"{scratch}/wide", 2)
    back = spark.read.option("header", True).csv(f"{scratch}/wide").collect()[0]
    assert float(back["0"]) == 0.2 and float(back["1"]) == 0.8
    W.write_doc_topics(dt, f"{scratch}/arr", 2, split=False)
    back = spark.read.option("header", True).option("escape", '"').csv(f"{scratch}/arr").collect()[0]
    assert json.loads(back.topic_dist) == [0.2, 0.8]


def test_theme_counts_round_trip(spark, scratch):
    # "coal gas" touch: the exact fold drops a same-theme span starting where
    # the previous one ends (Q1), so the theme counts 2, not 3
    df = spark.createDataFrame([(1, "coal gas and coal"), (2, None)], "doc_id long, text string")
    themes = spark.createDataFrame([("fossil", "coal"), ("fossil", "gas")], "theme string, keyword string")
    ms = M.measure_space(df, themes)
    W.write_theme_counts(ms, f"{scratch}/pq")
    back = {r.doc_id: r.theme_counts for r in W.read_theme_counts(spark, f"{scratch}/pq").collect()}
    assert back == {1: {"fossil": 2}, 2: {}}
    W.write_theme_counts(ms, f"{scratch}/csv", fmt="csv")
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{scratch}/csv").collect()
    assert {r.doc_id: json.loads(r.theme_counts) for r in rows} == {"1": {"fossil": 2}, "2": {}}


def test_ngrams_round_trip(spark, scratch):
    ng = spark.createDataFrame([("coal mine",), ("new south wales",), ("gas",)], "ngram string")
    W.write_ngrams(ng, f"{scratch}/ng")
    assert _cat(f"{scratch}/ng").splitlines() == ["new south wales", "coal mine", "gas"]
    assert [r.ngram for r in R.read_ngrams(spark, f"{scratch}/ng").collect()] == ["new south wales", "coal mine", "gas"]


def test_merge_steps_json(spark, scratch):
    steps = spark.createDataFrame([(0, "b", "a"), (0, "b", "c")], "iteration int, merged_into string, label string")
    W.write_merge_steps(steps, f"{scratch}/steps")
    back = sorted((r.merged_into, r.label) for r in spark.read.json(f"{scratch}/steps").collect())
    assert back == [("b", "a"), ("b", "c")]


def test_read_npy(spark, scratch, monkeypatch):
    arr = np.arange(12, dtype="float64").reshape(3, 4) / 10
    np.save(f"{scratch}/beta.npy", arr)
    cells = {(r.row, r.col): r.value for r in R.read_npy(spark, f"{scratch}/beta.npy").collect()}
    assert len(cells) == 12 and cells[(2, 3)] == pytest.approx(1.1)
    np.save(f"{scratch}/theta.npy", np.asfortranarray(arr * 2))
    both = R.read_npy(spark, f"{scratch}/*.npy")
    assert {r.file.rsplit("/", 1)[1]: r.n for r in both.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"beta.npy": 12, "theta.npy": 12}
    assert {(r.row, r.col): r.value for r in both.filter("file like '%theta.npy'").collect()} == {k: 2 * v for k, v in cells.items()}


def test_read_word_vectors(spark, scratch):
    _write(f"{scratch}/glove.txt", "coal 0.1 0.2\ngas -0.5 1.0\n")
    got = {r.word: r.vec for r in R.read_word_vectors(spark, f"{scratch}/glove.txt").collect()}
    assert got["gas"] == pytest.approx([-0.5, 1.0])


def test_read_corpus_and_whitelist(spark, scratch):
    _write(f"{scratch}/c.csv", 'year,para_text,doc_id\n1997,"Coal, ""quoted""\nnext line",1\n2001,Gas,2\n')
    c = sorted((r.doc_id, r.year, r.para_text) for r in R.read_corpus(spark, f"{scratch}/c.csv").collect())
    assert c[0] == (1, 1997, 'Coal, "quoted"\nnext line')
    _write(f"{scratch}/c.tsv", "year\tpara_text\tdoc_id\n1999\tSun\t3\n")
    assert R.read_corpus(spark, f"{scratch}/c.tsv").collect()[0].para_text == "Sun"
    _write(f"{scratch}/wl.txt", " 6626 Renewable Energy \n0821 defence\n")
    assert sorted(r.label for r in R.read_whitelist(spark, f"{scratch}/wl.txt").collect()) == \
        ["0821 defence", "6626 renewable energy"]


def test_discover_models(spark, scratch):
    for run in ["k30_a0.01_var0.05", "k30_a0.01_var0.1", "k20_a0.01_var0.05"]:
        _write(f"{scratch}/{run}/lda-seq/info.dat", "NUM_TOPICS 30\n")
    got = sorted(r.run for r in R.discover_models(spark, scratch, ks=[30]).collect())
    assert got == ["k30_a0.01_var0.05", "k30_a0.01_var0.1"]


def test_report_written(spark, scratch):
    from topicspark.plans.catalog import Ctx
    from topicspark.plans.report import compare_report, model_report
    c = Ctx(spark, "/root/testdata/sf0.001")
    frames = model_report(c.topic_term, c.share, c.thesaurus, model="m0")
    W.write_report(frames, f"{scratch}/report")
    back = spark.read.json(f"{scratch}/report/topic_steps")
    assert back.count() == c.share.count()
    cr = compare_report(c.model, 0, 1)
    W.write_report(cr, f"{scratch}/compare", partition="pair")
    assert spark.read.json(f"{scratch}/compare/unique_topics").columns


def test_read_npy_by_ranges(spark, scratch, monkeypatch):
    """Files above the range size are dealt out; values equal the whole file's, in any layout."""
    rng = np.random.default_rng(3)
    want = {}
    for name, arr in {"c": rng.random((301, 7)), "f": np.asfortranarray(rng.random((53, 31))), "flat": rng.random(999).astype("float32"),
                      "ints": rng.integers(0, 9, (200, 11), dtype="int16"), "big_endian": rng.random((90, 5)).astype(">f8"),
                      "none": np.zeros((0, 4))}.items():
        np.save(f"{scratch}/{name}.npy", arr)
        full = arr.reshape(1, -1) if arr.ndim == 1 else arr
        want[name] = {(i, j): float(full[i, j]) for i in range(full.shape[0]) for j in range(full.shape[1])}
    monkeypatch.setattr(R, "NPY_CELLS", 50)
    got = {name: {} for name in want}
    rows = R.read_npy(spark, f"{scratch}/*.npy", range_bytes=1000).withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for r in rows:
        name = r.file.rsplit("/", 1)[1].removesuffix(".npy")
        assert (r.row, r.col) not in got[name]
        got[name][(r.row, r.col)] = r.value
        tasks.setdefault(name, set()).add(r.task)
    assert got == want
    assert len(tasks["c"]) > 1
    # the ranges of a large file are planned without its bytes
    plan = R.read_npy(spark, f"{scratch}/c.npy", range_bytes=1000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,1000)" in plan and "LessThanOrEqual(length,1000)" in plan


def test_parse_npy_blocks_of_rows(spark):
    arr = np.arange(20, dtype="float64").reshape(5, 4)
    blocks = []
    for first, part in ((0, arr[:2]), (2, arr[2:])):
        out = io.BytesIO()
        np.save(out, part)
        blocks.append(("m", first, bytearray(out.getvalue())))
    cells = R.parse_npy(spark.createDataFrame(blocks, "path string, first_row long, content binary")).collect()
    assert {(r.row, r.col): r.value for r in cells} == {(i, j): arr[i, j] for i in range(5) for j in range(4)}
