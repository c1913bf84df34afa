"""Topic models over steps: the chain against a plain smoother, the fit against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import chain, fit


def plain_smoother(n, y, chain_var, observation_var=chain.OBSERVATION_VAR):
    """Mean of the states given all steps, from their joint normal distribution."""
    n, y = np.array(n, float), np.array(y, float)
    seen = np.flatnonzero(n > 0)
    noise = observation_var * n.mean() / n[seen]
    # a random walk with an unknown start: minimise noise-weighted misses and steps
    size = len(n)
    a = np.zeros((size, size))
    b = np.zeros(size)
    for i, r in zip(seen, noise):
        a[i, i] += 1 / r
        b[i] += y[i] / r
    for i in range(size - 1):
        w = 1 / chain_var
        a[i, i] += w
        a[i + 1, i + 1] += w
        a[i, i + 1] -= w
        a[i + 1, i] -= w
    return np.linalg.solve(a, b)


@pytest.mark.parametrize("n", [[5, 9, 1, 40, 7], [0, 3, 0, 8, 0], [4], [0, 0, 6], [100, 1, 1, 1, 1, 1, 100]])
@pytest.mark.parametrize("chain_var", [0.05, 0.5, 3.0])
def test_chain_equals_the_joint_solution(spark, n, chain_var):
    rng = np.random.default_rng(len(n))
    y = np.where(np.array(n) > 0, rng.random(len(n)), 0.0).tolist()
    df = spark.createDataFrame([([float(x) for x in n], y)], "n array<double>, y array<double>").select("n", "y", chain.gains(F.col("n"), chain_var).alias("w"))
    got = df.select(chain.smoothed(F.col("y"), F.col("w"))).first()[0]
    assert got == pytest.approx(plain_smoother(n, y, chain_var).tolist(), abs=1e-9)


def test_no_variance_gives_the_pooled_share(spark):
    n, y = [5.0, 0.0, 20.0, 1.0], [0.2, 0.0, 0.5, 1.0]
    df = spark.createDataFrame([(n, y)], "n array<double>, y array<double>").select("y", chain.gains(F.col("n"), 0.0).alias("w"))
    got = df.select(chain.smoothed(F.col("y"), F.col("w"))).first()[0]
    assert got == pytest.approx([(1 + 10 + 1) / 26] * 4)


def corpus(spark):
    """Two themes; the words of the first one change from step to step."""
    rows = []
    for i in range(60):
        step = 2000 + i % 3
        own = [f"early{step - 2000}", "coal", "mine"] if i % 2 else ["sun", "solar", f"late{step - 2000}"]
        rows.append((i, step, own * 4 + ["the"]))
    rows += [(100, 2001, []), (101, None, ["coal"]), (102, 2002, None)]
    return spark.createDataFrame(rows, "doc_id long, step int, tokens array<string>")


def plain_fit(rows, topics, alpha, chain_var, max_iter, words, start):
    """The same rounds by loops over documents and words."""
    steps = sorted({s for _, s, _ in rows})
    matrix = {(s, w): start[w] for _, s, t in rows for w in t}
    for _ in range(max_iter):
        n = {(s, w): np.zeros(topics) for s in steps for w in words}
        for _, s, t in rows:
            own = sorted(set(t), key=words.index)
            _, given = fit.mixture(np.array([t.count(w) for w in own], float), np.array([matrix[s, w] for w in own]), alpha)
            for w, g in zip(own, given):
                n[s, w] += g
        total = {s: sum(n[s, w] for w in words) for s in steps}
        prior = fit.WORD_PRIOR * len(words) / 1e6
        for w in words:
            out = np.zeros((len(steps), topics))
            for k in range(topics):
                tokens, share = [total[s][k] for s in steps], [n[s, w][k] / total[s][k] if total[s][k] else 0 for s in steps]
                pooled = [sum(n[s, w][k] for s in steps) / sum(tokens)] * len(steps)
                out[:, k] = plain_smoother(tokens, share, chain_var) if chain_var else pooled
            for s, b in zip(steps, out):
                matrix[s, w] = (np.maximum(b, 0) + prior / len(words)) / (1 + prior)
    return matrix


@pytest.mark.parametrize("chain_var", [0.05, 0])
def test_fit_equals_plain_loops(spark, chain_var):
    df = corpus(spark)
    run = {"topics": 2, "alpha": 0.1, "topic_var": chain_var}
    tt, dt = fit.fit_topics_grid(df, [run], max_iter=3, seed=5, step="step")
    rows = [(r.doc_id, r.step, r.tokens) for r in df.collect() if r.tokens and r.step is not None]
    voc = {r.word: r.word_id for r in tt.select("word", "word_id").distinct().collect()}
    words = sorted(voc, key=voc.get)
    noise = spark.createDataFrame([(w,) for w in words], "word string").select(
        "word", F.array(*[F.pmod(F.xxhash64(F.lit(5), "word", F.lit(k)), F.lit(1000)) for k in range(2)]).alias("h")).collect()
    start = {r.word: (1 + np.array(r.h) / 1000) / (1.5 * len(words)) for r in noise}
    want = plain_fit(rows, 2, 0.1, chain_var, 3, words, start)
    got = {(r.step, r.word, r.topic): r.prob for r in tt.collect()}
    assert len(got) == 3 * len(words) * 2
    for (s, w, k), p in got.items():
        assert p == pytest.approx(want[s, w][k], rel=1e-6, abs=1e-12), (s, w, k)
    sums = [r.s for r in tt.groupBy("step", "topic").agg(F.sum("prob").alias("s")).collect()]
    assert len(sums) == 6 and sums == pytest.approx([1.0] * 6)
    assert {r.doc_id for r in dt.collect()} == {i for i, _, _ in rows}


def test_chain_variance_changes_the_result_and_none_is_static(spark):
    df = corpus(spark).where("step is not null")
    runs = [{"topics": 2, "alpha": 0.1, "topic_var": v} for v in (0, 0.5)]
    tt, _ = fit.fit_topics_grid(df, runs, max_iter=2, step="step")
    static, _ = fit.fit_topics_grid(df, runs[:1], max_iter=2)
    rows = {(r.model, r.step, r.topic, r.word): r.prob for r in tt.collect()}
    names = [fit.run_name(r) for r in runs]
    for r in static.collect():
        for s in (2000, 2001, 2002):
            assert rows[names[0], s, r.topic, r.word] == pytest.approx(r.prob, rel=1e-6)
    assert any(abs(rows[names[0], s, k, w] - p) > 1e-3 for (m, s, k, w), p in rows.items() if m == names[1])
