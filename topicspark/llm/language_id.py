"""Language identification by string kernels.

The kernel of two texts is the number of byte n-grams (n = 1, 2, 3 together: the
blended spectrum) present in both, over the geometric mean of their numbers.
A bounded sample of labelled texts is kept: some of them are Nystroem landmarks,
all of them fit a one-versus-rest kernel ridge regression in the landmarks'
feature space. Texts are scored in batches: presence matrix times landmark
matrix gives the kernel values, times the coefficients the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicspark.llm.common import fresh, row_slices, small_batches, written

#: Bound of the sample that the classifier is fitted on, for each language and in all, and of the landmarks in all.
TRAIN_PER_LANGUAGE, TRAIN_TOTAL, LANDMARKS = 300, 2400, 128
RIDGE, SEED, UNKNOWN = 0.1, 11, "und"

TRIGRAMS = 1 << 18
N_FEATURES = 256 + (1 << 16) + TRIGRAMS
_PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
# one byte for all that is no letter in ASCII, one case
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def ngrams(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted features present in the whole ``text``; ``seen`` is an all-false scratch of ``N_FEATURES``."""
    data = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    for s in range(0, len(data), _PIECE):
        b = data[s:s + _PIECE + 2].astype(np.uint32)
        seen[b] = True
        two = b[:-1] << 8 | b[1:]
        seen[two + 256] = True
        three = (two[:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(14)
        seen[three + (256 + (1 << 16))] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # feature -> column of the landmark matrix, or the last column
    landmarks: np.ndarray  # columns x landmarks, each landmark over the root of its number of features
    coefficients: np.ndarray  # landmarks x languages

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Kernel values (texts x landmarks)."""
        present = np.zeros((len(found), len(self.landmarks)), np.float32)
        for i, f in enumerate(found):
            present[i, self.column[f]] = 1
        return present @ self.landmarks / np.sqrt([max(1, len(f)) for f in found])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: a score of 0.5 is the border of
        the language's regression, 1 is what its own texts were fitted to."""
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        seen = np.zeros(N_FEATURES, bool)
        for s in range(0, len(known), 128):
            at = known[s:s + 128]
            raw = self.kernel([ngrams(texts[i], seen) for i in at]) @ self.coefficients
            best = raw.argmax(axis=1)
            scores[at] = np.clip((raw[np.arange(len(at)), best] + 1) / 2, 0, 1)
            for i, b in zip(at, best):
                languages[i] = self.languages[b]
        return languages, scores


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on (language, features) in a fixed order; each language's first samples are its landmarks."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Model([], np.zeros(N_FEATURES, np.int32), np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    each = max(1, landmarks // len(languages))
    marks = [f for lang in languages for f in [f for name, f in samples if name == lang][:each]]
    columns = np.unique(np.concatenate(marks))
    column = np.full(N_FEATURES, len(columns), np.int32)
    column[columns] = np.arange(len(columns))
    matrix = np.zeros((len(columns) + 1, len(marks)), np.float32)
    for k, f in enumerate(marks):
        matrix[column[f], k] = 1 / np.sqrt(len(f))
    model = Model(languages, column, matrix, np.zeros((len(marks), len(languages))))
    among = model.kernel(marks).astype(np.float64)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # kernel values -> Nystroem features
    features = model.kernel([f for _, f in samples]).astype(np.float64) @ root
    index = np.array([languages.index(lang) for lang, _ in samples])
    target = np.where(index[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(index, minlength=len(languages))[index]  # each language counts the same
    left = features.T @ (features * weight[:, None]) + ridge / len(samples) * np.eye(features.shape[1])
    model.coefficients = root @ np.linalg.solve(left, features.T @ (target * weight[:, None]))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _features(batches):
    """<lang, h, doc_id, f>: features as little-endian unsigned 32-bit integers; texts without a letter go."""
    seen = np.zeros(N_FEATURES, bool)
    for part in row_slices(batches):
        texts = part.column("text").to_pylist()
        keep = [i for i, t in enumerate(texts) if _LETTER.search(t)]
        found = [ngrams(texts[i], seen).astype("<u4").tobytes() for i in keep]
        own = part.select(["lang", "h", "doc_id"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, pa.binary())], ["lang", "h", "doc_id", "f"])


@F.udf(T.BooleanType(), useArrow=True)
def _lettered(text):
    return bool(text and _LETTER.search(text))


def train(docs: DataFrame) -> Model:
    """A classifier from ``docs`` <doc_id, text, lang>: languages are the labels
    of the rows that aren't held out. Of each, the rows with the smallest seeded
    hashes are taken, as many as the bounds allow; their features, never whole
    texts, come to the driver (at most ``N_FEATURES`` of each).

    Of rows that repeat an id, the one with the smallest label, then the
    smallest text, stands for it. The chosen rows are written with their texts
    first, so that features are computed for them alone.
    """
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    keys = own.select("doc_id", "lang", F.xxhash64(F.lit(SEED), "doc_id").alias("h"))
    n = max(1, keys.select("lang").distinct().count())
    per = max(2, min(TRAIN_PER_LANGUAGE, TRAIN_TOTAL // n))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = keys.withColumn("r", rank).where(F.col("r") <= per).select("doc_id", "h").distinct()
    # at most ``per`` ids for each language
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h").agg(F.min(F.struct("lang", "text")).alias("s"))
    rows = written(rows.select("doc_id", "h", "s.lang", "s.text"), "training")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_features, f"lang string, h bigint, doc_id {id_type}, f binary").collect()
    found.sort(key=lambda r: (r["lang"], r["h"], r["doc_id"]))
    return fit([(r["lang"], np.frombuffer(r["f"], "<u4").astype(np.int64)) for r in found])


def classify(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` with ``column`` struct<lang_pred, score>, from text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        lang, score = held.value.predict([t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn(column, predict(F.col("text")))


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` <doc_id, text, lang>: doc_id, held_out,
    lang_pred, score (0 to 1).

    ``und`` with score 0 for null text and text without a letter, and for all
    where no row is labelled. Rows are independent of each other once the
    classifier is fitted; repeated rows get the same result, and of rows that
    repeat an id the one with the smallest label and text is learned from. No
    rows: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    out = classify(docs.select("doc_id", "text"), train(docs), "_p")
    return out.select("doc_id", held_out().alias("held_out"), "_p.lang_pred", "_p.score")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with an identified language, with all their columns:
    ``und`` ones go, short texts with a low score stay. Where no row can be
    learned from, all texts with a letter stay."""
    small_batches(docs.sparkSession)
    model = train(docs)
    if not model.languages:
        return docs.where(_lettered("text"))
    p = fresh(docs, "_language")
    out = classify(docs, model, p)
    return out.where(F.col(p)["lang_pred"] != UNKNOWN).drop(p)
