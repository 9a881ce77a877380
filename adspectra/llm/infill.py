"""Fill-in-middle arrangements of documents, in Spark SQL functions alone.

``regexp_extract_all`` cuts a text into units (a run of Latin letters, or one other code point).  The digits of a
SHA-256 of the seed and the id, read by ``substring`` and ``conv``, give two cuts between units, and whether and how the text
is arranged; ``slice`` and ``array_join`` build prefix, middle and suffix.  ``restore`` parses the sentinels of an
arrangement and puts the text together again.

A text that holds a sentinel is left plain, so each sentinel stands once in an arrangement: none can arise where
parts meet, since a sentinel begins with ``<`` and ends with ``>`` and holds neither within.

Plan: one scan and one projection, no shuffle.  The units of a text are one array in the memory of one task, some 60 bytes a
unit, and are taken only from texts that are arranged or counted.

Defined cases: null text is empty; an empty text is plain, with no units; a null id draws like the empty string; rows that repeat
an id draw alike; texts of any length are cut whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = "[A-Za-z]+|[^A-Za-z]"
SEED = "1"
#: Of a hundred texts so many are arranged, and of a hundred arranged so many with the suffix first.
ARRANGED, SUFFIX_FIRST = 90, 20


def draw(digest: Column, n: int) -> Column:
    """The ``n``-th group of eight hexadecimal digits, from 1, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, seed: str = SEED, arranged: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain) and output of every row."""
    p, s, m = sentinels
    text, n = F.col("text"), F.col("n")
    read = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("digest"))
    units = read.withColumn("units", F.regexp_extract_all("text", F.lit(f"({UNIT})"), 0)).withColumn("n", F.size("units").cast("long"))
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in sentinels])
    plain = (n == 0) | marked | (draw(F.col("digest"), 3) % 100 >= arranged)
    form = F.when(plain, "plain").when(draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    first, second = (draw(F.col("digest"), i) % (n + 1) for i in (1, 2))
    cuts = units.select("doc_id", "text", "units", "n", form.alias("form"), F.least(first, second).cast("int").alias("from"), F.greatest(first, second).cast("int").alias("to"))

    def part(start: Column, stop: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start + 1, stop - start), ""))

    parts = cuts.select("doc_id", "text", "n", "form", part(F.lit(0), F.col("from")).alias("prefix"), part(F.col("from"), F.col("to")).alias("middle"), part(F.col("to"), F.size("units")).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    return parts.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text of an arrangement."""
    p, s, m = map(F.lit, sentinels)

    def after(x: Column, mark: Column) -> Column:
        return F.substring(x, F.instr(x, mark) + F.length(mark), F.length(x))

    def between(x: Column, a: Column, b: Column) -> Column:
        return F.substring(x, F.instr(x, a) + F.length(a), F.instr(x, b) - F.instr(x, a) - F.length(a))

    psm = F.concat(between(output, p, s), after(output, m), between(output, s, m))
    spm = F.concat(between(output, p, m), after(output, m), between(output, s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(arrangements: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The rows with ``restored``, made of ``output`` and ``form`` alone."""
    return arrangements.withColumn("restored", restored(F.col("output"), F.col("form"), sentinels))
