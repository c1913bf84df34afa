"""Dense, gap-free row ids in a distributed way.

``row_number()`` over an unpartitioned window sorts everything in one task.
``ordered_index`` instead range-sorts in parallel, counts rows per sorted
partition (one row per partition reaches the driver side of the plan as a tiny
table), turns the counts into offsets, and adds the offset to each row's
position inside its partition. This is ``zipWithIndex`` expressed with
DataFrame operators, so the rows never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import ensure_checkpoint_dir


def ordered_index(df: DataFrame, order_cols, name: str = "idx", start: int = 0) -> DataFrame:
    """Add ``name`` = 0-based (or ``start``-based) rank of each row in ``order_cols``.

    ``order_cols`` must define a total order (ties make ids arbitrary, as with
    any sort). The sorted frame is checkpointed to the shared checkpoint folder
    so the two passes see identical partitions even if executors are lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    sorted_df = (
        df.orderBy(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    # rows of partition p carry _mid = (p << 33) + position
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # offsets has one row per partition: its size is bounded by the partition count
    out = sorted_df.join(F.broadcast(offsets), "_pid")
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.withColumn(name, (F.col("_off") + pos + F.lit(start)).cast("long")).drop("_pid", "_mid", "_off")


def line_index(lines: DataFrame, name: str = "line") -> DataFrame:
    """0-based line numbers per file for a ``spark.read.text`` frame.

    File splits are packed into partitions by size, not in file order, so the
    number is built per block: rows of one block are contiguous and in line
    order inside a task, blocks of a file are ordered by their byte offset.
    One small row per block feeds the offsets (bounded by the block count).
    """
    # A file scan splits and orders rows the same way on every run, so the two
    # passes below (block counts, rows) agree without materialising the lines.
    tagged = (
        lines.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.col("_metadata.file_block_start").alias("_blk"))
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    blocks = tagged.groupBy("file_path", "_blk").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy("file_path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file_path", "_blk", "_first",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per block: left to AQE to broadcast when small
    out = tagged.join(offsets, ["file_path", "_blk"])
    return (out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long"))
            .drop("_blk", "_mid", "_first", "_off"))


BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` where its plan statistics bound its size; else
    leave the join strategy to Spark, which decides at run time from the real
    size. No action is run and nothing stays cached."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except ValueError:
        # estimates of joins multiply and outlive checkpoints: after some rounds they have
        # more digits than Python turns into a number
        return df
    return F.broadcast(df) if size <= max_bytes else df


def measured_bytes(df: DataFrame) -> int:
    """The real size of a table whose columns are numbers, strings or arrays of numbers,
    by one small aggregate: ``df`` should be stored (checkpointed, persisted or read from files)."""
    def width(c):
        kind = df.schema[c].dataType.typeName()
        own = F.octet_length(F.col(c)) if kind == "string" else F.size(F.col(c)) * 8 if kind == "array" else F.lit(0)
        return F.coalesce(own, F.lit(0)).cast("long") + 16
    return df.select(F.sum(sum((width(c) for c in df.columns), F.lit(0)))).first()[0] or 0


def measured_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``bounded_broadcast`` by the real size (``measured_bytes``): estimates of a table
    made by joins are far too large."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
