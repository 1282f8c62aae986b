"""Bands, ratios and error terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Z_95 = 1.96


def band(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the left-closed, right-open interval; NULL stays NULL.

    ``breaks`` are the inner boundaries, one fewer than ``labels``.
    """
    if len(labels) != len(breaks) + 1:
        raise ValueError("need one label more than breaks")
    chain = F.when(value.isNull(), None)
    for upper, label in zip(breaks, labels):
        chain = chain.when(value < upper, label)
    return chain.otherwise(labels[-1])


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(numerator, denominator)


def round_to(value: Column, digits: int, ties: str = "up") -> Column:
    """Round with ties away from zero (``"up"``) or to the even digit (``"even"``)."""
    if ties not in ("up", "even"):
        raise ValueError(f"unknown ties {ties!r}")
    return F.round(value, digits) if ties == "up" else F.bround(value, digits)


def sum_policy(value: Column, na_policy: str = "skip") -> Column:
    """Sum that skips NULL, or is NULL as soon as one input is (``"propagate"``)."""
    if na_policy == "skip":
        return F.sum(value)
    if na_policy == "propagate":
        return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))
    raise ValueError(f"unknown na_policy {na_policy!r}")


def standard_error(share: Column, size: Column) -> Column:
    """Standard error of a share from a simple random sample."""
    return F.sqrt(F.try_divide(share * (1 - share), size))


def half_width(share: Column, size: Column, z: float = Z_95) -> Column:
    """Half the width of the confidence interval of a share."""
    return z * standard_error(share, size)


def nonresponse_range(response_rate: Column, share: Column) -> tuple[Column, Column]:
    """Smallest and largest possible share when non-respondents are unknown."""
    return response_rate * share, response_rate * share + (1 - response_rate)
