"""Theme counting on a stream of documents.

Per-document theme counts need no state across documents: each micro-batch
is a plain DataFrame, so ``foreachBatch`` runs the batch operator
(``measure_space``) on it and appends the result to a table. The checkpoint
location makes the query restartable after executor or driver loss
(exactly-once with an idempotent, batch-id keyed sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions import MATCH_PATTERN
from topicspark.operators.match import measure_space


def stream_theme_counts(stream: DataFrame, themes: DataFrame, out_path: str, checkpoint: str,
                        text: str = "text", key: str = "doc_id", pattern: str = MATCH_PATTERN,
                        trigger_once: bool = True):
    """Start a streaming query writing <key, theme_counts, theme_terms, batch_id> as parquet."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = measure_space(batch.select(key, text), themes, text, key, pattern=pattern)
        # overwrite this batch's own partition: a replayed batch replaces itself
        (out.drop(text).withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id").parquet(out_path))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
