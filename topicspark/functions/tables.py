"""Word tables compiled into an expression.

A small table is written into the plan as a literal array of maps, one map for
each value of a word's checksum, so a lookup reads one place of the array and
the few words of its map. Rows stay where they are: no join, no exchange.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest table that is compiled: entries, and characters of keys and values.
MAX_ENTRIES, MAX_CHARS = 100_000, 8 << 20


def fits(entries: Mapping[str, object]) -> bool:
    """Whether a table may be compiled."""
    return len(entries) <= MAX_ENTRIES and sum(len(k) + len(str(v)) for k, v in entries.items()) <= MAX_CHARS


def bounded_rows(df: DataFrame, most: int | None = None) -> list | None:
    """The rows of a frame of at most ``most`` rows; None for a larger one."""
    most = MAX_ENTRIES if most is None else most
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def lookup(entries: Mapping[str, object], value_type: str = "string") -> Callable[[Column], Column]:
    """A function from a string column to its entry's value, null where there is none.

    Values are what JSON holds of ``value_type``.
    """
    n = max(1, len(entries) // 2)
    places: list[dict] = [{} for _ in range(n)]
    for k, v in entries.items():
        places[zlib.crc32(k.encode()) % n][k] = v
    # a foldable expression: the optimizer turns it into one literal
    table = F.from_json(F.lit(json.dumps(places, ensure_ascii=False)), f"array<map<string,{value_type}>>")
    return lambda x: F.element_at(F.get(table, (F.crc32(x.cast("binary")) % n).cast("int")), x)


def member(words) -> Callable[[Column], Column]:
    """Whether a string column is one of ``words``."""
    found = lookup(dict.fromkeys(words, True), "boolean")
    return lambda x: found(x).isNotNull()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
