"""Session helpers.

``get_spark`` is for local runs and tests. On a cluster the caller's session is
used as is; only ``spark.checkpoint.dir`` is read from it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", app: str = "topicspark", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with their frames
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local session (tests) may go
    without it: a fresh scratch folder is made and registered. On a cluster a
    machine-local folder would not be seen by all, so the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="topicspark-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", conf_dir)
        except Exception:  # core setting: some versions refuse runtime changes
            pass
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as Parquet to the checkpoint folder, and a function that deletes
    these files. For large tables that are read a few times: they take a fraction of a
    checkpoint's bytes, whose rows are neither coded nor compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path), drop


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints of frames that are gone: Spark deletes
    them when the driver's garbage is collected, which rounds of small plans seldom cause."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
