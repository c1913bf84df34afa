"""Binary files on any file system that Spark can write, by Spark's own commit
protocol: a task's files appear once, however often the task is tried.

A file is one row. Spark's text writer puts the row's bytes and then its line
separator into the file, so the format's last bytes (a magic number) are handed
over as the separator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(rows: DataFrame, column: str, magic: bytes, path: str) -> None:
    """Write each row's ``column`` (bytes) followed by ``magic`` to a file of its own under ``path``."""
    (rows.select(F.col(column).cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", magic.decode("latin-1"))
     .option("compression", "none").text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """<path, content> of the files under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
