"""topicspark: topic and theme analytics over dated text corpora, on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame``. Matrices are kept
in long form (one row per cell) so they join, aggregate and partition like any
other table.
"""

from topicspark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
