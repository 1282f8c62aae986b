"""Text cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match; the replacement is literal text.

    ``regexp_replace`` replaces every match, so the text is cut once at the
    pattern and joined again. The pattern must not match the empty string.
    """
    return F.when(text.isNotNull(), F.concat_ws(replacement, F.split(text, pattern, 2)))


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or NULL (not "") when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def split_label(label: Column, head_pattern: str, separator: str = ".") -> tuple[Column, Column]:
    """Cut ``head<separator>rest`` into its two parts."""
    return (
        extract(label, f"^{head_pattern}"),
        F.regexp_replace(label, f"^{head_pattern}{re.escape(separator)}", ""),
    )


def nth_choice(ranking: Column, place: int, separator: str = " | ") -> Column:
    """The ``place``-th (from 1) entry of a delimited ranking, NULL past its end."""
    return F.get(F.split(ranking, re.escape(separator)), place - 1)


def decimal_comma(text: Column) -> Column:
    """``"37,5"`` to 37.5; text that is not a number becomes NULL."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def range_label(low: Column, high: Column) -> Column:
    """Two shares as a whole-percent label, ``"31-35%"``."""
    return F.concat(
        F.round(low * 100).cast("long").cast("string"),
        F.lit("-"),
        F.round(high * 100).cast("long").cast("string"),
        F.lit("%"),
    )


# Marks in the published sample-size column and the mode each stands for.
MODE_MARKS = {"O • ": "online", "T • ": "telefon"}
MODE_UNKNOWN = "keineangabe"
POLL_MARKS = r" %|≈|O • |T • |[?]"


def survey_mode(sample_text: Column) -> Column:
    """Survey mode from the mark in front of the sample size."""
    mode = F.lit(MODE_UNKNOWN)
    for mark, label in reversed(MODE_MARKS.items()):
        mode = F.when(sample_text.contains(mark), label).otherwise(mode)
    return mode
