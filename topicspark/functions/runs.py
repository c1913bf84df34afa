"""Rows that belong together, as a Python task reads them; one row handed to every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def together(batches, key: str):
    """(rows, starts) of Arrow batches whose rows of one ``key`` (a number) are next to
    each other: whole keys only, ``starts`` has the place of each one's first row."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        own = rows.column(key).to_numpy()
        starts = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
        # the last key may go on in the next batch
        held, whole = rows.slice(int(starts[-1])), starts[:-1]
        if len(whole):
            yield rows.slice(0, int(starts[-1])), whole
    if held is not None:
        yield held, np.zeros(1, int)


def handed(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of ``one``, a table of one row, which is broadcast: each
    partition's first row has them, the others null. No row is moved."""
    first = F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.lit(0))
    keyed = one.groupBy().agg(F.min(F.lit(0)).alias("_at"), *[F.first(c).alias(c) for c in one.columns])
    return df.withColumn("_at", first).join(F.broadcast(keyed), "_at", "left").drop("_at")
