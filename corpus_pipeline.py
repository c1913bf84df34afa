"""Five stages of a training-data pipeline over ``documents``.

``STAGES`` are (name, function): each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import exact_dedup, language_id, mixing, near_dedup, pieces
from topicspark.llm.common import table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without an identified language (null text, no letter) go."""
    return language_id.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of each group of near copies the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target takes it (not, once or twice)."""
    return mixing.apply_mix(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: doc_id, the ids of the best path, ``pieces`` with the N best
    paths and the sha256 of the text that the ids decode to; a row for each row of the mix."""
    encoded = pieces.encode(docs)
    digest = F.sha2(pieces.decoded(F.col("ids")), 256)
    return encoded.select("doc_id", "ids", F.struct("paths", digest.alias("decoded_sha256")).alias("pieces"))


STAGES = [("language_id", identified), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("pieces", segmented)]

#: The classifier, the min-max signatures and the lattice search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's rows are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
