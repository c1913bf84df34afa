"""Writers.

Ordered text outputs are written from a range-sorted frame: part files are
named in partition order, so concatenating ``part-*`` gives the single file
the external tools expect, without funnelling the data through one task.
Only outputs bounded by the number of time units (step counts, step map)
are written as one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions import ordered_index
from topicspark.session import ensure_checkpoint_dir


def format_vocab(voc: DataFrame) -> DataFrame:
    """<word_id, value>: ``word\\tcount`` lines."""
    return voc.select("word_id", F.concat_ws("\t", "word", F.col("cnt").cast("string")).alias("value"))


def write_vocab(voc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vocabulary lines in word_id order, range-sorted over the part files."""
    format_vocab(voc).orderBy("word_id").select("value").write.mode(mode).text(path)


def format_dataset(bow: DataFrame, step: str = "step", order: str = "doc_order") -> DataFrame:
    """<idx, mult, year>: the aligned lines of the dataset files, ``idx`` giving their place."""
    idx = ordered_index(bow.select(step, order, "bow"), [F.col(step), F.col(order)], "idx")
    return idx.select("idx", F.col("bow").alias("mult"), F.col(step).cast("string").alias("year"))


def write_dataset(bow: DataFrame, root: str, step: str = "step", order: str = "doc_order",
                  frame: DataFrame | None = None, mode: str = "overwrite") -> None:
    """Three aligned outputs plus the reordered frame.

    bow: <doc_id, step, doc_order, bow>. Writes ``model-mult`` (bag of words),
    ``model-year`` (step per doc) from one checkpointed sort, so both have the
    same partitioning and order; ``model-seq`` (header + docs per non-empty
    step, Q9); and ``ordered`` (parquet of ``frame`` joined in dataset order).
    """
    ensure_checkpoint_dir(bow.sparkSession)
    srt = bow.orderBy(step, order).checkpoint(eager=True)
    srt.select("bow").write.mode(mode).text(f"{root}/model-mult")
    srt.select(F.col(step).cast("string")).write.mode(mode).text(f"{root}/model-year")
    counts = srt.groupBy(step).agg(F.count(F.lit(1)).alias("n")).orderBy(step)
    seq = counts.agg(F.concat_ws("\n", F.count(F.lit(1)).cast("string"),
                                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(step, "n"))),
                                                          lambda x: x["n"].cast("string")), "\n")).alias("value"))
    seq.coalesce(1).write.mode(mode).text(f"{root}/model-seq")
    if frame is not None:
        ordered = frame.join(srt.select("doc_id", step, order), "doc_id").orderBy(step, order)
        ordered.write.mode(mode).parquet(f"{root}/ordered")


def write_step_map(mapping: DataFrame, path: str, key: str = "step", value: str = "mapped",
                   mode: str = "overwrite") -> None:
    """The step mapping as one JSON object (bounded by the number of time units)."""
    format_step_map(mapping, key, value).coalesce(1).write.mode(mode).text(path)


def format_step_map(mapping: DataFrame, key: str = "step", value: str = "mapped") -> DataFrame:
    """One row <value>: the mapping as JSON in order of its keys."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return mapping.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].cast("string"), e["v"])))).alias("value"))


def doc_topics_wide(doc_topic: DataFrame, n_topics: int, step: str = "step") -> DataFrame:
    """One column per topic (``0``..``K-1``) plus step and doc_id."""
    return doc_topic.groupBy("doc_id", step).pivot("topic", list(range(n_topics))).agg(F.first("weight"))


def write_doc_topics(doc_topic: DataFrame, path: str, n_topics: int, split: bool = True,
                     step: str = "step", mode: str = "overwrite") -> None:
    """Doc-topic mixtures to CSV: wide (split) or one JSON array column."""
    if split:
        doc_topics_wide(doc_topic, n_topics, step).write.mode(mode).option("header", True).csv(path)
    else:
        arr = doc_topic.groupBy("doc_id", step).agg(F.to_json(F.transform(
            F.array_sort(F.collect_list(F.struct("topic", "weight"))), lambda x: x["weight"])).alias("topic_dist"))
        arr.write.mode(mode).option("header", True).csv(path)


def write_theme_counts(measured: DataFrame, path: str, fmt: str = "parquet", prefix: str = "theme_",
                       mode: str = "overwrite") -> None:
    """Enriched corpus: parquet keeps the maps; CSV stores them as JSON text."""
    if fmt == "parquet":
        measured.write.mode(mode).parquet(path)
        return
    out = format_theme_counts(measured, prefix)
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def format_theme_counts(measured: DataFrame, prefix: str = "theme_") -> DataFrame:
    """The two maps as JSON text, names in order."""
    def js(c):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return measured.withColumn(prefix + "counts", js(prefix + "counts")).withColumn(prefix + "terms", js(prefix + "terms"))


def read_theme_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_ngrams(ngrams: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One clean phrase per line (Q6), longest first."""
    format_ngrams(ngrams).orderBy("place", "value").select("value").write.mode(mode).text(path)


def format_ngrams(ngrams: DataFrame) -> DataFrame:
    """<place, value>: lines in order of ``place`` (minus the length), then text."""
    return ngrams.select((-F.length("ngram")).alias("place"), F.col("ngram").alias("value"))


def write_merge_steps(steps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Merge steps <iteration, merged_into, label> as JSON lines."""
    format_merge_steps(steps).orderBy("iteration", "value").select("value").write.mode(mode).text(path)


def format_merge_steps(steps: DataFrame) -> DataFrame:
    """<iteration, value>: one JSON object per step."""
    return steps.select("iteration", F.to_json(F.struct("iteration", "merged_into", "label")).alias("value"))


def write_report(frames: dict[str, DataFrame], root: str, partition: str | None = "model",
                 mode: str = "overwrite") -> None:
    """Write report frames as JSON lines, partitioned by model when present."""
    for name, df in frames.items():
        w = df.write.mode(mode)
        if partition and partition in df.columns:
            w = w.partitionBy(partition)
        w.json(f"{root}/{name}")
