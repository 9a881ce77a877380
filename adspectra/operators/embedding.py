"""Vectors of texts by signed feature hashing, weighed by inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64
#: Words are hashed to so many features; this bounds the table of frequencies, whatever the texts.
FEATURES = 1 << 18


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " ")), " "), lambda w: w != "")


def feature(word: Column) -> Column:
    """A word's feature: the first 32 bits of its MD5, by remainder."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % FEATURES


def features(text: Column) -> Column:
    """The features of all words of a text; none of a null text."""
    return F.coalesce(F.transform(words(text), lambda w: feature(w).cast("int")), F.array().cast("array<int>"))


def _weights(held: DataFrame) -> DataFrame:
    """(feature, idf) of rows (features)."""
    counts = held.select(F.explode(F.array_distinct("features")).alias("feature")).withColumn("feature", F.col("feature").cast("bigint")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    all_texts = held.agg(F.count(F.lit(1)).alias("all"))
    return counts.crossJoin(all_texts).select("feature", (F.ln((F.col("all") + 1) / (F.col("n") + 1)) + 1).alias("idf"))


def frequencies(texts: DataFrame, text: str) -> DataFrame:
    """(feature, idf) over all texts, at most ``FEATURES`` rows: ln((1 + texts) / (1 + texts that have it)) + 1."""
    return _weights(texts.select(features(F.col(text)).alias("features")))


def embeddings(texts: DataFrame, key: str | list[str], text: str, idf: DataFrame | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding): for each text's words the sum of their features' weights, each on the feature's own dimension and with its own sign, of norm 1.

    Weights are those of ``idf`` (of the texts themselves if not given; a feature that it doesn't hold counts as 1, as one in every text).
    The table of weights has ``FEATURES`` rows at most, so it is broadcast.  Words are hashed once, and the features, a number for each word, are
    shuffled once, by the first column of the key: they are counted and summed up there, and the vectors stay dealt out by that column.  Null texts
    and those without words have a vector of zeros; rows of one key are one text; a null key is a key.
    """
    keys = [key] if isinstance(key, str) else key
    held = texts.select(*keys, features(F.col(text)).alias("features")).repartition(keys[0])
    weights = F.broadcast(idf if idf is not None else _weights(held))
    found = held.select(*keys, F.explode_outer("features").alias("feature")).withColumn("feature", F.col("feature").cast("bigint")).join(weights, "feature", "left")
    sign = F.when(F.floor(F.col("feature") / dimensions) % 2 == 0, 1).otherwise(-1)
    sums = found.groupBy(*keys, (F.col("feature") % dimensions).cast("int").alias("__d")).agg(F.sum(sign * F.coalesce("idf", F.lit(1.0))).alias("__x"))
    whole = sums.groupBy(*keys).agg(F.sqrt(F.sum(F.col("__x") * F.col("__x"))).alias("__norm"), F.map_from_entries(F.collect_list(F.when(F.col("__d").isNotNull(), F.struct("__d", "__x")))).alias("__m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.when(F.col("__norm") > 0, F.coalesce(F.element_at("__m", d) / F.col("__norm"), F.lit(0.0))).otherwise(F.lit(0.0)))
    return whole.select(*keys, dense.alias("embedding"))
