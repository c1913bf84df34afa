"""Smoothing of series along ordered steps by a state-space model.

A word's share of a topic is a random walk from step to step, with ``chain_var``
per step, seen through noise: a step's share is the less certain the fewer
tokens the topic has there. The forward and the backward pass are linear with
weights that depend on the topic's tokens alone, so these are computed once per
topic and applied to each word's series inside its row. The weights of a step
add up to one over all steps and are the same for all words: smoothed shares
still add up to one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicspark.functions.tables import let

#: Noise of a step with as many tokens as the topic's steps have on average.
OBSERVATION_VAR = 0.5
_FORWARD = "struct<at:array<struct<gain:double,variance:double>>,variance:double>"


def gains(tokens: Column, chain_var: float, observation_var: float = OBSERVATION_VAR) -> Column:
    """array<struct<gain, back>> of a topic's tokens per step, in order of step.

    ``gain`` is how far the forward pass moves to what a step shows, ``back``
    how far the backward pass moves to the step after it. Steps without tokens
    show nothing; before the first one that shows something there is no state.
    """
    def passes(n):
        mean = F.aggregate(n, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(n), F.lit(1))

        def step(acc, x):
            before = acc["variance"] + F.lit(float(chain_var))
            noise = F.lit(float(observation_var)) * mean / x
            gain = F.when(x <= 0, F.lit(0.0)).when(acc["variance"].isNull(), F.lit(1.0)).otherwise(before / (before + noise))
            after = F.when(x <= 0, before).when(acc["variance"].isNull(), noise).otherwise((1 - gain) * before)
            return F.struct(F.array_append(acc["at"], F.struct(gain.alias("gain"), after.alias("variance"))).alias("at"), after.alias("variance"))
        start = F.struct(F.array().cast("array<struct<gain:double,variance:double>>").alias("at"), F.lit(None).cast("double").alias("variance")).cast(_FORWARD)
        back = lambda g: F.when(g["variance"].isNull(), F.lit(1.0)).otherwise(g["variance"] / (g["variance"] + F.lit(float(chain_var))))
        return F.aggregate(n, start, step, lambda acc: F.transform(acc["at"], lambda g: F.struct(g["gain"].alias("gain"), back(g).alias("back"))))
    return let(F.transform(tokens, lambda x: x.cast("double")), passes)


def smoothed(shares: Column, weights: Column) -> Column:
    """A series of shares, one for each step, after the forward and the backward
    pass with its topic's ``gains``."""
    def forward(x):
        def step(acc, z):
            last = F.coalesce(F.element_at(acc, F.greatest(F.size(acc), F.lit(1))), F.lit(0.0))
            return F.array_append(acc, last + z["w"]["gain"] * (z["x"] - last))
        own = F.zip_with(x, weights, lambda a, w: F.struct(a.alias("x"), w.alias("w")))
        return F.aggregate(own, F.array().cast("array<double>"), lambda acc, z: F.when(F.size(acc) == 0, F.array(z["w"]["gain"] * z["x"])).otherwise(step(acc, z)))

    def backward(m):
        own = F.reverse(F.zip_with(m, weights, lambda a, w: F.struct(a.alias("m"), w["back"].alias("back"))))
        none = F.array().cast("array<double>")

        def step(acc, z):
            return F.when(F.size(acc) == 0, F.array(z["m"])).otherwise(F.array_append(acc, z["m"] + z["back"] * (F.element_at(acc, -1) - z["m"])))
        return F.reverse(F.aggregate(own, none, step))
    return let(let(shares, forward), backward)


def smoothed_rows(shares: np.ndarray, gain: np.ndarray, back: np.ndarray) -> np.ndarray:
    """``smoothed`` of many series at once (series x steps x topics), with the ``gains``
    of their topics (steps x topics)."""
    out = gain * shares
    for i in range(1, len(gain)):
        out[:, i] = out[:, i - 1] + gain[i] * (shares[:, i] - out[:, i - 1])
    for i in range(len(gain) - 2, -1, -1):
        out[:, i] += back[i] * (out[:, i + 1] - out[:, i])
    return out
