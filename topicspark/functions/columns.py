"""Scalar column expressions of built-in functions (no UDF). Those with array
lambdas are evaluated in the JVM but outside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default token rule of the library: runs of letters, digits and underscores
# (underscores keep joined n-grams such as ``coal_mine`` in one token).
TOKEN_PATTERN = r"[^\p{L}\p{N}_]+"
# Matching keeps punctuation and line ends as tokens of their own, so that no
# phrase matches across them.
MATCH_PATTERN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+|\n+"
# Letter-only rule used by the test fixtures (same expression in DuckDB).
LETTER_SPLIT = r"[^\p{L}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text, pattern: str = TOKEN_PATTERN, lower: bool = True) -> Column:
    """Split text into a token array; empty pieces are dropped (Q27)."""
    t = _c(text)
    if lower:
        t = F.lower(t)
    return F.filter(F.split(t, pattern), lambda x: x != "")


def strip_label_code(label, pattern: str = r"^\d{2,4} ") -> Column:
    """Drop a leading numeric label code such as ``6626 ``; unchanged without one (Q21)."""
    return F.regexp_replace(_c(label), pattern, "")


def unjoin_terms(term) -> Column:
    """``greenhouse_gas`` -> ``greenhouse gas``."""
    return F.regexp_replace(_c(term), "_", " ")


# ---- date -> step presets (the overridable hook of the dataset builder) ----

def year_of_date(c) -> Column:
    """Year of a ``YYYY-MM-DD`` string, date or timestamp."""
    return F.year(F.to_date(_c(c))).cast("int")


def year_of_int(c) -> Column:
    return _c(c).cast("int")


def year_month(c) -> Column:
    """``YYYYMM`` as an int, from a date or timestamp."""
    return F.date_format(_c(c), "yyyyMM").cast("int")


def identity_step(c) -> Column:
    return _c(c)


def ln_or_neg_inf(x) -> Column:
    """Natural log where ln(0) is -Infinity, as numpy gives (Q12)."""
    x = _c(x)
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def r6(x) -> Column:
    """Round to 6 decimals (only used when presenting results)."""
    return F.round(_c(x), 6)
