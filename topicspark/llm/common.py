"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that count as white space in the contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Rows and bytes of one Arrow batch handed to a Python worker; bounds its memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_MADE: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may
    go without the setting (tests): a scratch folder is made for it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="llm-shared-", dir="/tmp")
        sc.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; ``release`` deletes it."""
    path = f"{shared_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the
    lineage, and later passes read what the first one computed."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables and files that this application's operators wrote to
    the shared folder. Call it once their results have been used."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(conf).delete(p, True)
    return len(made)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def same(a, b):
    """Equality that also pairs null with null."""
    return F.col(a).eqNullSafe(F.col(b))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in one array and the offsets of
    its n + 1 row bounds; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_slices(batches, rows: int = 256):
    """The batches in slices of ``rows``, so that arrays over a slice's bytes stay
    small; at the task's end Arrow's unused memory goes back to the system, as
    the worker lives on."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)
    pa.default_memory_pool().release_unused()


def at_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    """Flags of the positions 0..n-1 where a non-empty row begins."""
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return first
