"""Column functions: every one returns built-in Spark expressions."""

from .dates import day_gap, mean_date, parse_day
from .names import named, quoted
from .numbers import band, half_width, nonresponse_range, round_to, safe_ratio, standard_error, sum_policy
from .recode import collapse_other, null_tokens, recode, recode_frame
from .text import (
    decimal_comma,
    extract,
    nth_choice,
    range_label,
    replace_all,
    replace_first,
    split_label,
    survey_mode,
)

__all__ = [
    "band",
    "collapse_other",
    "day_gap",
    "decimal_comma",
    "extract",
    "half_width",
    "mean_date",
    "named",
    "nonresponse_range",
    "nth_choice",
    "null_tokens",
    "parse_day",
    "quoted",
    "range_label",
    "recode",
    "recode_frame",
    "replace_all",
    "replace_first",
    "round_to",
    "safe_ratio",
    "split_label",
    "standard_error",
    "sum_policy",
    "survey_mode",
]
