"""Short text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "..."


def shortened(text: Column, most: int) -> Column:
    """The text, or its first characters and an ellipsis, ``most`` characters in all."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - len(ELLIPSIS)), F.lit(ELLIPSIS))).otherwise(text)


def titled(text: Column) -> Column:
    """Every word with a capital first letter, words parted by underscores too."""
    return F.initcap(F.replace(F.lower(text), F.lit("_"), F.lit(" ")))
