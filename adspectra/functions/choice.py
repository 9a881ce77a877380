"""Choices by weight from draws between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 53


def draw(seed: int, *key: Column | str) -> Column:
    """A number from 0 up to 1 that the key and the seed decide, so that a repeated task draws it again."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << DRAW_BITS)) / F.lit(float(1 << DRAW_BITS))


def weighted(drawn: Column, weights: dict[str, float], default: str) -> Column:
    """The first value whose weights so far reach the draw; the default where none does."""
    out, so_far = None, 0.0
    for value, weight in weights.items():
        so_far += weight
        out = F.when(drawn <= so_far, value) if out is None else out.when(drawn <= so_far, value)
    return F.lit(default) if out is None else out.otherwise(default)


def nonce(injected: Column | None = None) -> Column:
    """A random id, or the one that a test gives."""
    return F.uuid() if injected is None else injected
