"""A keyed cache table that is read through: what it lacks or has held too long is loaded and written back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adspectra.operators import merge

#: Fixed value: the seconds that an entry lives.
TTL_SECONDS = 2_592_000
HIT, EXPIRED, MISS = "hit", "expired", "miss"


def fresh(cache: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> Column:
    """Whether an entry still lives: one of exactly the age ``ttl`` doesn't, nor one without a time."""
    return F.coalesce(F.col("stored_at") + F.make_interval(secs=F.lit(ttl)) > now, F.lit(False))


def newest(cache: DataFrame, key: str) -> DataFrame:
    """The entry (key, value, stored_at) stored last of each key; of equal times the greatest value."""
    return cache.groupBy(key).agg(F.max(F.struct("stored_at", "value")).alias("e")).select(key, "e.value", "e.stored_at")


def looked_up(keys: DataFrame, cache: DataFrame, key: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """(key, status, value) of each different key that isn't null; the value of hits only."""
    held = newest(cache, key).withColumn("__fresh", fresh(cache, now, ttl))
    status = F.when(F.col("__fresh"), HIT).when(F.col("__fresh").isNotNull(), EXPIRED).otherwise(MISS)
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return asked.join(held, key, "left").select(key, status.alias("status"), F.when(F.col("__fresh"), F.col("value")).alias("value"))


def filled(looked: DataFrame, load: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """(key, status, value, loaded): values of hits, and those that ``load`` finds (key, value; one row a key) for all other keys."""
    lacking = looked.where(F.col("status") != HIT).select(key)
    loaded = load(lacking).select(key, F.col("value").alias("__value"), F.lit(True).alias("__loaded"))
    both = looked.join(loaded.join(lacking, key, "left_semi"), key, "left")
    return both.select(key, "status", F.when(F.col("status") == HIT, F.col("value")).otherwise(F.col("__value")).alias("value"), F.coalesce("__loaded", F.lit(False)).alias("loaded"))


def written_back(cache: DataFrame, found: DataFrame, key: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """The cache after reading: entries that still live, and those just loaded, as of now. What couldn't be loaded isn't remembered."""
    living = newest(cache, key).where(fresh(cache, now, ttl))
    return living.unionByName(found.where("loaded").select(key, "value", now.alias("stored_at")))


class Cache:
    """A cache kept as versions of a table; a version counts only once it is written whole."""

    def __init__(self, spark: SparkSession, path: str, key: str, ttl: int = TTL_SECONDS):
        self.spark, self.path, self.key, self.ttl = spark, path, key, ttl

    def entries(self) -> DataFrame:
        return merge.read_together(self.spark, self.path, "entries")[0]

    def put(self, entries: DataFrame, version: int) -> None:
        """Writes the entries (key, value, stored_at) as the whole cache."""
        merge.written_together({"entries": entries}, self.path, version)

    def read_through(self, keys: DataFrame, load: Callable[[DataFrame], DataFrame], now: Column, version: int) -> DataFrame:
        """``filled`` for the keys; the cache goes on as ``version``. What was found is written first, so that nothing is loaded twice."""
        before = self.entries()
        at = f"{self.path}/found/{uuid.uuid4().hex}"
        filled(looked_up(keys, before, self.key, now, self.ttl), load, self.key).write.parquet(at)
        found = self.spark.read.parquet(at)
        self.put(written_back(before, found, self.key, now, self.ttl), version)
        return found
