"""Fitting: documents stay in their tasks, the topic matrix comes by parts, sums are exchanged."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import chain, fit
from topicspark.session import ensure_checkpoint_dir, stored

RUNS = [{"topics": 2, "alpha": 0.1, "topic_var": 0.05}, {"topics": 3, "alpha": 0.01, "topic_var": 0.0}]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _cells(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def _docs(spark):
    rows = [(i, 2000 + i % 5, [f"w{(i * j) % 11}" for j in range(9)] + [f"own{i % 5}"] * (i % 3)) for i in range(40)]
    return spark.createDataFrame([*rows, (90, 2001, []), (91, None, ["w1"]), (None, 2003, ["w1", None, "w2"])], "doc_id long, step int, tokens array<string>")


def test_matrix_by_parts_gives_the_same_and_no_words_are_joined_to_it(spark, monkeypatch):
    want = [_cells(df) for df in fit.fit_topics_grid(_docs(spark), RUNS, max_iter=3, seed=2, step="step")]
    joined, packed = [], []
    asked, pack = fit._asked, fit._packed
    monkeypatch.setattr(fit, "_asked", lambda *a: joined.append(1) or asked(*a))
    monkeypatch.setattr(fit, "_packed", lambda *a: packed.append(a[2:]) or pack(*a))
    # two of the five steps' matrices of 16 words and three topics at once
    monkeypatch.setattr(fit, "BROADCAST_BYTES", 2 * 2 * 16 * 32)
    tt, dt = fit.fit_topics_grid(_docs(spark), RUNS, max_iter=3, seed=2, step="step")
    assert (0, 2) in packed and (2, 2) in packed and (4, 2) in packed
    # only for the documents' mixtures of a run, which are made when they are read
    assert len(joined) <= len(RUNS)
    for df, cells in zip((tt, dt), want):
        got = _cells(df)
        assert got.keys() == cells.keys() and all(got[k] == pytest.approx(cells[k], rel=1e-9) for k in got)


def test_a_round_exchanges_a_row_for_each_word_of_a_task(spark, monkeypatch):
    given = []
    held = fit.handed
    monkeypatch.setattr(fit, "handed", lambda df, one: given.append(df) or held(df, one))
    fit.fit_topics_grid(_docs(spark).coalesce(1), RUNS[:1], max_iter=2)
    docs = next(df for df in given if "word_ids" in df.columns)
    assert "Exchange" not in _plan(docs)
    matrix = spark.range(16).select(F.col("id").alias("word_id"), F.array(F.lit(0.1), F.lit(0.2)).alias("b"))
    rows = fit.handed(docs.coalesce(1), fit._packed(matrix, 2)).mapInArrow(fit._held_gifts(2, 16, 0.1, None), "step int, word_id long, n0 double, n1 double")
    assert "Exchange hashpartitioning" not in _plan(rows)
    got = [r.word_id for r in rows.collect()]
    assert len(got) == len(set(got))


def test_words_in_tasks_are_counted_without_another_exchange_of_cells(spark):
    tt, _ = fit.fit_topics_grid(_docs(spark), RUNS, max_iter=1, step="step")
    found = tt.groupBy("model", "topic", "step").agg(F.countDistinct("word").alias("n"), F.sum("prob").alias("s"))
    assert not [x for x in _plan(found).split("\n") if "Exchange hashpartitioning(model" in x and "word#" in x]
    rows = found.collect()
    assert len(rows) == 25 and {r.n for r in rows} == {16} and [r.s for r in rows] == pytest.approx([1.0] * 25)


def test_smoothed_rows_equal_the_column(spark):
    rng = np.random.default_rng(3)
    tokens, shares = [5.0, 0.0, 20.0, 1.0], rng.random((6, 4, 1))
    df = spark.createDataFrame([(x[:, 0].tolist(), tokens) for x in shares], "y array<double>, n array<double>")
    rows = df.select("y", chain.gains(F.col("n"), 0.05).alias("w")).select("w", chain.smoothed(F.col("y"), F.col("w")).alias("x")).collect()
    gain, back = (np.array([[z[c]] for z in rows[0].w]) for c in ("gain", "back"))
    assert chain.smoothed_rows(shares, gain, back)[:, :, 0] == pytest.approx(np.array([r.x for r in rows]))


def test_stored_tables_are_deleted(spark):
    df, drop = stored(spark.range(5))
    assert sorted(r.id for r in df.collect()) == list(range(5))
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    assert (made := [p for p in os.listdir(top) if p.startswith("stored-")])
    drop()
    assert len([p for p in os.listdir(top) if p.startswith("stored-")]) == len(made) - 1
