"""Hourly rollups of the fact tables.

Both sides are aggregated to their key before they meet, so the join has one row per key on each
side and nothing fans out.  Impressions drive: an hour with clicks alone has no row.  A table that
is partitioned by day refreshes by rewriting only the days that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspectra.functions.ratios import ecpm_dollars, rate_pct
from adspectra.functions.timeutil import hour_of


def _delivery(impressions: DataFrame, clicks: DataFrame, group: list[str], match: list[str]) -> DataFrame:
    seen = impressions.groupBy(hour_of("event_time").alias("hour"), *group).agg(F.countDistinct("id").alias("impressions"), F.sum("price_cents").alias("spend_cents"))
    clicked = clicks.groupBy(hour_of("event_time").alias("hour"), *match).agg(F.count(F.lit(1)).alias("clicks"))
    joined = seen.join(clicked, ["hour", *match], "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    return joined.select("hour", *match, *(g for g in group if g not in match), "impressions", "clicks", "spend_cents", ecpm_dollars(F.col("spend_cents"), F.col("impressions")).alias("avg_ecpm"), rate_pct(F.col("clicks"), F.col("impressions")).alias("avg_ctr"))


def ad_metrics_hourly(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Per hour, ad and campaign; clicks are matched by hour and ad."""
    return _delivery(impressions, clicks, ["ad_id", "campaign_id"], ["ad_id"])


def campaign_metrics_hourly(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    return _delivery(impressions, clicks, ["campaign_id"], ["campaign_id"])


def auction_metrics_hourly(auctions: DataFrame) -> DataFrame:
    won = F.col("winner_ad_id").isNotNull()
    bid = F.when(won, F.col("winning_bid_cents"))
    measures = auctions.groupBy(hour_of("event_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("total_auctions"),
        F.count("winner_ad_id").alias("auctions_with_winner"),
        *(F.avg(f"num_{x}").alias(f"avg_{x}") for x in ("candidates", "filtered_budget", "filtered_targeting", "eligible")),
        F.avg(bid).alias("avg_winning_bid_cents"),
        F.percentile(bid, 0.5).alias("median_winning_bid_cents"),
    )
    return measures.withColumn("fill_rate_pct", rate_pct(F.col("auctions_with_winner"), F.col("total_auctions")))


def refresh(rollup: DataFrame, path: str) -> None:
    """Writes a rollup by day, replacing only the days it has rows for."""
    dated = rollup.withColumn("event_date", F.to_date("hour"))
    dated.repartition("event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
