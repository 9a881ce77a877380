"""Guarded arithmetic on money and counts. Money at rest is whole cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole * scale as a double, 0 where whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * F.lit(float(scale))).otherwise(F.lit(0.0))


def rate_pct(part: Column, whole: Column) -> Column:
    return safe_ratio(part, whole, 100.0)


def ecpm_dollars(spend_cents: Column, impressions: Column) -> Column:
    """Dollars per thousand impressions."""
    return safe_ratio(spend_cents, impressions, 10.0)


def to_cents(dollars: Column) -> Column:
    """Dollars to cents by truncation toward zero, never rounding; null if unreadable."""
    return (dollars.try_cast("double") * F.lit(100.0)).cast("bigint")


def to_dollars(cents: Column) -> Column:
    return cents / F.lit(100.0)


def nonzero_or(value: Column, other: Column) -> Column:
    """The value unless it is null or 0, else the other, else 0."""
    return F.coalesce(F.nullif(value, F.lit(0)), other, F.lit(0))


def labelled(name: Column, prefix: str, number: Column) -> Column:
    """The name, or prefix and number where it is missing."""
    return F.coalesce(name, F.concat(F.lit(prefix), number.cast("string")))
