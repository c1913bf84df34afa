"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import alignment, embedding_dedup, exact_dedup, fingerprints, hard_negatives, language_id, line_dedup, mixing, near_dedup, pieces, pii, token_files, warc
from topicspark.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_documents(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(pieces.encode(table(spark, sf_dir, "documents")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table's labels are topics of the vectors; every seventh row is moved to the next one, as the query asks
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_files, op3_exact_dedup, op4_embedding_dedup, op5_language_id, op6_pii, op7_near_dedup, op8_warc, op9_pieces, op10_line_dedup,
                                  op11_hard_negatives, op12_alignment, op13_fingerprints)}
SQL = {"op3_exact_dedup": exact_dedup.ORACLE, "op4_embedding_dedup": embedding_dedup.ORACLE, "op8_warc": warc.ORACLE, "op10_line_dedup": line_dedup.ORACLE,
       "op11_hard_negatives": hard_negatives.ORACLE}
