"""Column -> Column helpers and small DataFrame utilities shared by operators."""

from topicspark.functions.columns import (
    TOKEN_PATTERN,
    MATCH_PATTERN,
    LETTER_SPLIT,
    tokens,
    strip_label_code,
    unjoin_terms,
    year_of_date,
    year_of_int,
    year_month,
    identity_step,
    ln_or_neg_inf,
    r6,
)
from topicspark.functions.ids import bounded_broadcast, line_index, measured_broadcast, ordered_index

__all__ = [
    "TOKEN_PATTERN", "MATCH_PATTERN", "LETTER_SPLIT", "tokens", "strip_label_code", "unjoin_terms",
    "year_of_date", "year_of_int", "year_month", "identity_step", "ln_or_neg_inf", "r6",
    "ordered_index", "line_index", "bounded_broadcast", "measured_broadcast",
]
