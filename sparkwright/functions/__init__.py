"""Column-level building blocks: lenient casts, mixed-format dates, text cleaning, rounding."""

from sparkwright.functions.casts import (
    DATE_LAYOUTS,
    NUMBER_PATTERN,
    as_bool_flag,
    clean_text,
    dtype_of,
    is_numeric_type,
    is_string_type,
    exact,
    exact_sum,
    money,
    parse_dates,
    round_half_even,
    to_boolean,
    to_number,
)

__all__ = [
    "DATE_LAYOUTS",
    "NUMBER_PATTERN",
    "as_bool_flag",
    "clean_text",
    "dtype_of",
    "is_numeric_type",
    "is_string_type",
    "exact",
    "exact_sum",
    "money",
    "parse_dates",
    "round_half_even",
    "to_boolean",
    "to_number",
]
