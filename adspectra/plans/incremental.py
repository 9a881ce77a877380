"""Hourly rollups kept up to date from new batches alone.

A rollup's state are sums that can be added: counts and spend by hour and key, and for auctions counts by hour and winning bid, from which the median
follows.  ``refresh`` reads only the batches after the high-water mark (the sinks write facts by day and batch), and writes their state
as one more part of each day that they touch; late hours are just parts of older days.  Then it moves the mark.  ``measures`` adds up the parts.

A refresh that fails before the mark is moved is as if it hadn't been: parts above the mark aren't read, and the next refresh replaces
them.  ``merge_parts`` adds up the parts of each day into one, in a new folder that replaces the old one when it is whole.

Defined cases: an impression's id is unique (sinks replace a repeated batch); a refresh without new batches does nothing; an hour with clicks
alone has no row; empty facts give an empty rollup.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspectra.functions.ratios import ecpm_dollars, rate_pct
from adspectra.functions.timeutil import hour_of

NUMBERS = ("num_candidates", "num_filtered_budget", "num_filtered_targeting", "num_eligible")
NONE = -1


@dataclass(frozen=True)
class Rollup:
    """What a rollup keeps: ``state`` of facts by name, by ``keys`` of which all other columns are sums; ``measures`` of the added-up state."""

    facts: tuple[str, ...]
    keys: tuple[str, ...]
    state: Callable[[dict[str, DataFrame]], DataFrame]
    measures: Callable[[DataFrame], DataFrame]


def _delivery(group: tuple[str, ...], match: tuple[str, ...]) -> Rollup:
    """Impressions by ``group`` and clicks by ``match``; a click's row has no value in the rest of the group."""
    rest = tuple(g for g in group if g not in match)

    def state(facts: dict[str, DataFrame]) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        seen = facts["impressions"].groupBy(hour_of("event_time").alias("hour"), F.lit("seen").alias("kind"), *match, *rest).agg(F.count(F.lit(1)).alias("impressions"), zero.alias("clicks"), F.sum("price_cents").alias("spend_cents"))
        none = [F.lit(None).cast(facts["impressions"].schema[c].dataType).alias(c) for c in rest]
        clicked = facts["clicks"].groupBy(hour_of("event_time").alias("hour"), F.lit("clicked").alias("kind"), *match, *none).agg(zero.alias("impressions"), F.count(F.lit(1)).alias("clicks"), zero.alias("spend_cents"))
        return seen.unionByName(clicked)

    def measures(total: DataFrame) -> DataFrame:
        clicked = total.where("kind = 'clicked'").select("hour", *match, "clicks")
        joined = total.where("kind = 'seen'").drop("kind", "clicks").join(clicked, ["hour", *match], "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
        return joined.select("hour", *match, *rest, "impressions", "clicks", "spend_cents", ecpm_dollars(F.col("spend_cents"), F.col("impressions")).alias("avg_ecpm"), rate_pct(F.col("clicks"), F.col("impressions")).alias("avg_ctr"))

    return Rollup(("impressions", "clicks"), ("hour", "kind", *match, *rest), state, measures)


def _auction_state(facts: dict[str, DataFrame]) -> DataFrame:
    won = F.col("winner_ad_id").isNotNull()
    sums = [f(x).alias(f"{name}_{x}") for x in NUMBERS for name, f in (("sum", F.sum), ("known", F.count))]
    return facts["auctions"].groupBy(hour_of("event_time").alias("hour"), won.alias("won"), F.when(won, F.col("winning_bid_cents")).alias("bid")).agg(F.count(F.lit(1)).alias("auctions"), *sums)


def _auction_measures(total: DataFrame) -> DataFrame:
    bids = F.when(F.col("bid").isNotNull(), F.col("auctions"))
    rows = total.groupBy("hour").agg(
        F.sum("auctions").alias("total_auctions"),
        F.coalesce(F.sum(F.when(F.col("won"), F.col("auctions"))), F.lit(0)).alias("auctions_with_winner"),
        *((F.sum(f"sum_{x}") / F.nullif(F.sum(f"known_{x}"), F.lit(0))).alias(x.replace("num_", "avg_")) for x in NUMBERS),
        (F.sum(F.col("bid") * F.col("auctions")) / F.sum(bids)).alias("avg_winning_bid_cents"),
        F.percentile("bid", 0.5, F.coalesce(bids, F.lit(0))).alias("median_winning_bid_cents"),
    )
    return rows.withColumn("fill_rate_pct", rate_pct(F.col("auctions_with_winner"), F.col("total_auctions")))


AD_METRICS = _delivery(("ad_id", "campaign_id"), ("ad_id",))
CAMPAIGN_METRICS = _delivery(("campaign_id",), ("campaign_id",))
AUCTION_METRICS = Rollup(("auctions",), ("hour", "won", "bid"), _auction_state, _auction_measures)


def added(rollup: Rollup, states: DataFrame) -> DataFrame:
    """One row a key of several states."""
    return states.groupBy(*rollup.keys).agg(*(F.sum(c).alias(c) for c in states.columns if c not in (*rollup.keys, "event_date", "upto")))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def mark(spark: SparkSession, path: str) -> int:
    """The last batch that the rollup holds."""
    if not _exists(spark, f"{path}/marks"):
        return NONE
    return spark.read.schema("upto bigint").parquet(f"{path}/marks").agg(F.coalesce(F.max("upto"), F.lit(NONE))).first()[0]


def fresh(rollup: Rollup, facts: dict[str, DataFrame], after: int) -> dict[str, DataFrame]:
    """The facts of batches after the mark; ``batch_id`` is a folder's name, so other folders aren't read."""
    return {x: facts[x].where(F.col("batch_id") > after) for x in rollup.facts}


def refresh(rollup: Rollup, facts: dict[str, DataFrame], path: str) -> int:
    """Takes the new batches of the facts (with ``event_date`` and ``batch_id``) into the rollup; the mark after it."""
    spark = facts[rollup.facts[0]].sparkSession
    last = mark(spark, path)
    new = fresh(rollup, facts, last)
    upto = max((b for x in new.values() for b in [x.agg(F.max("batch_id")).first()[0]] if b is not None), default=None)
    if upto is None:
        return last
    whole = {x: df.where(F.col("batch_id") <= upto) for x, df in new.items()}
    parts = rollup.state(whole).withColumns({"event_date": F.to_date("hour"), "upto": F.lit(upto).cast("bigint")})
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "upto").parquet(f"{path}/parts")
    spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).coalesce(1).write.mode("append").parquet(f"{path}/marks")
    return upto


def state(rollup: Rollup, spark: SparkSession, path: str) -> DataFrame:
    """The added-up state up to the mark."""
    return added(rollup, spark.read.parquet(f"{path}/parts").where(F.col("upto") <= mark(spark, path)))


def measures(rollup: Rollup, spark: SparkSession, path: str) -> DataFrame:
    return rollup.measures(state(rollup, spark, path))


def merge_parts(rollup: Rollup, spark: SparkSession, path: str) -> None:
    """Leaves one part a day. The mark goes last, so that a copy without it is no rollup; a run that stops halfway is begun anew."""
    upto, new, old = mark(spark, path), f"{path}-merging", f"{path}-merged"
    if upto == NONE:
        return
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    at = spark._jvm.org.apache.hadoop.fs.Path
    files.delete(at(new), True)
    files.delete(at(old), True)
    state(rollup, spark, path).withColumns({"event_date": F.to_date("hour"), "upto": F.lit(upto).cast("bigint")}).repartition("event_date").write.partitionBy("event_date", "upto").parquet(f"{new}/parts")
    spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).coalesce(1).write.parquet(f"{new}/marks")
    files.rename(at(path), at(old))
    files.rename(at(new), at(path))
    files.delete(at(old), True)
