"""The business queries over fact tables and rollups.

Enrichment is by left joins, so rows without a dimension keep their numbers and get a fallback
label.  Facts are reduced to the grouping key before the dimensions are joined, which shuffles keys
and sums instead of rows; where dimensions repeat a key on purpose (several ad sets of a campaign)
the sums repeat with them.  Ordered results with a limit are top-k reports and take ids as last key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspectra.functions.ratios import ecpm_dollars, labelled, nonzero_or, rate_pct
from adspectra.functions.timeutil import bucket, half_open, hour_closed

TOP_ADVERTISERS, TIMESERIES_ROWS, BURNDOWN_ROWS = 20, 10_000, 5_000


def _campaign_label(c: Column, number: Column) -> Column:
    return labelled(c, "Campaign #", number)


def _advertiser_label(name: Column, number: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Advertiser #"), F.coalesce(number.cast("string"), F.lit("?"))))


def with_owner(df: DataFrame, campaigns: DataFrame, advertisers: DataFrame) -> DataFrame:
    """Adds campaign (name, total budget, status) and advertiser (id, name) columns by campaign_id."""
    c = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("c_name"), "advertiser_id", F.col("total_budget").alias("c_budget"), F.col("status").alias("c_status"))
    a = advertisers.select(F.col("id").alias("advertiser_id"), F.col("name").alias("a_name"))
    return df.join(c.join(a, "advertiser_id", "left"), "campaign_id", "left")


def kpi_summary(impressions: DataFrame, clicks: DataFrame, auctions: DataFrame, start, end) -> DataFrame:
    """One row of totals, also when a table has no rows in the range."""
    within = half_open("event_time", start, end)
    seen = impressions.where(within).agg(F.count(F.lit(1)).alias("total_impressions"), F.coalesce(F.sum("price_cents"), F.lit(0)).alias("total_spend_cents"))
    clicked = clicks.where(within).agg(F.count(F.lit(1)).alias("total_clicks"))
    held = auctions.where(within).agg(F.count(F.lit(1)).alias("total_auctions"), F.count("winner_ad_id").alias("auctions_filled"))
    one = seen.crossJoin(clicked).crossJoin(held)  # of one row each
    return one.withColumn("ctr_pct", rate_pct(F.col("total_clicks"), F.col("total_impressions"))).withColumn("fill_rate_pct", rate_pct(F.col("auctions_filled"), F.col("total_auctions")))


def active_campaigns_count(campaign_hours: DataFrame, start, end) -> DataFrame:
    """Campaigns with an impression in the range, whatever their status."""
    return campaign_hours.where(hour_closed("hour", start, end)).agg(F.countDistinct("campaign_id").alias("active_campaigns"))


def spend_over_time(impressions: DataFrame, start, end, seconds: int) -> DataFrame:
    rows = impressions.where(half_open("event_time", start, end)).groupBy(bucket("event_time", seconds).alias("bucket"))
    return rows.agg(F.sum("price_cents").alias("spend_cents"), F.count(F.lit(1)).alias("impressions")).orderBy("bucket")


def events_over_time(events: DataFrame, start, end, seconds: int, name: str) -> DataFrame:
    return events.where(half_open("event_time", start, end)).groupBy(bucket("event_time", seconds).alias("bucket")).agg(F.count(F.lit(1)).alias(name)).orderBy("bucket")


def fill_rate_over_time(auctions: DataFrame, start, end, seconds: int) -> DataFrame:
    rows = auctions.where(half_open("event_time", start, end)).groupBy(bucket("event_time", seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("total_auctions"), F.count("winner_ad_id").alias("filled_auctions"))
    return rows.withColumn("fill_rate_pct", rate_pct(F.col("filled_auctions"), F.col("total_auctions"))).orderBy("bucket")


def _campaign_sums(campaign_hours: DataFrame, start, end) -> DataFrame:
    return campaign_hours.where(hour_closed("hour", start, end)).groupBy("campaign_id").agg(*(F.sum(x).alias(x) for x in ("impressions", "clicks", "spend_cents")))


def spend_by_advertiser(campaign_hours: DataFrame, campaigns: DataFrame, advertisers: DataFrame, start, end, limit: int = TOP_ADVERTISERS) -> DataFrame:
    rows = with_owner(_campaign_sums(campaign_hours, start, end), campaigns, advertisers).groupBy("a_name", "advertiser_id").agg(F.sum("spend_cents").alias("spend_cents"), F.sum("impressions").alias("impressions"))
    return rows.select(labelled(F.col("a_name"), "Advertiser #", F.col("advertiser_id")).alias("advertiser_name"), "advertiser_id", "spend_cents", "impressions").orderBy(F.desc_nulls_first("spend_cents"), "advertiser_id").limit(limit)


def spend_by_pricing_model(ad_hours: DataFrame, ads: DataFrame, ad_sets: DataFrame, start, end) -> DataFrame:
    sums = ad_hours.where(hour_closed("hour", start, end)).groupBy("ad_id").agg(F.sum("spend_cents").alias("spend_cents"), F.sum("impressions").alias("impressions"))
    model = ads.select(F.col("id").alias("ad_id"), "ad_set_id").join(ad_sets.select(F.col("id").alias("ad_set_id"), "pricing_model"), "ad_set_id", "left").drop("ad_set_id")
    rows = sums.join(model, "ad_id", "left").groupBy("pricing_model").agg(F.sum("spend_cents").alias("spend_cents"), F.sum("impressions").alias("impressions"))
    return rows.withColumn("pricing_model", F.coalesce("pricing_model", F.lit("Unknown"))).orderBy(F.desc_nulls_first("spend_cents"))


def _with_daily_budget(sums: DataFrame, campaigns: DataFrame, advertisers: DataFrame, ad_sets: DataFrame, dedup_ad_sets: bool) -> DataFrame:
    """A campaign's sums for each of its daily budgets, times the ad sets that share it (once, with ``dedup_ad_sets``).

    Ad sets are matched to known campaigns only.
    """
    sets = ad_sets.groupBy("campaign_id", F.col("daily_budget_cents").alias("s_budget")).agg(F.count(F.lit(1)).alias("sets"))
    owned = with_owner(sums.join(campaigns.select(F.col("id").alias("campaign_id"), F.lit(True).alias("known")), "campaign_id", "left"), campaigns, advertisers)
    rows = owned.join(sets.withColumn("known", F.lit(True)), ["campaign_id", "known"], "left")
    times = F.lit(1) if dedup_ad_sets else F.coalesce("sets", F.lit(1))
    for x in ("impressions", "clicks", "spend_cents"):
        rows = rows.withColumn(x, F.col(x) * times)
    return rows.withColumn("daily_budget_cents", F.coalesce("s_budget", F.lit(0)))


def campaign_performance(campaign_hours: DataFrame, campaigns: DataFrame, advertisers: DataFrame, ad_sets: DataFrame, start, end, dedup_ad_sets: bool = False) -> DataFrame:
    rows = _with_daily_budget(_campaign_sums(campaign_hours, start, end), campaigns, advertisers, ad_sets, dedup_ad_sets)
    return rows.select(
        "campaign_id",
        _campaign_label(F.col("c_name"), F.col("campaign_id")).alias("campaign_name"),
        _advertiser_label(F.col("a_name"), F.col("advertiser_id")).alias("advertiser_name"),
        "impressions",
        "clicks",
        "spend_cents",
        rate_pct(F.col("clicks"), F.col("impressions")).alias("ctr_pct"),
        ecpm_dollars(F.col("spend_cents"), F.col("impressions")).alias("ecpm_dollars"),
        F.col("c_budget").alias("total_budget_cents"),
        "daily_budget_cents",
        F.col("c_status").alias("campaign_status"),
    ).orderBy(F.desc_nulls_first("spend_cents"), "campaign_id", "daily_budget_cents")


def top_campaigns_by_impressions(campaign_hours: DataFrame, campaigns: DataFrame, advertisers: DataFrame, ad_sets: DataFrame, start, end, limit: int, dedup_ad_sets: bool = False) -> DataFrame:
    rows = campaign_performance(campaign_hours, campaigns, advertisers, ad_sets, start, end, dedup_ad_sets).drop("clicks", "ctr_pct", "ecpm_dollars")
    return rows.orderBy(F.desc_nulls_first("impressions"), "campaign_id", "daily_budget_cents").limit(limit)


def ads_in_campaigns(ad_hours: DataFrame, ads: DataFrame, ad_sets: DataFrame, campaign_ids: list[int], start, end) -> DataFrame:
    sums = ad_hours.where(F.col("campaign_id").isin(campaign_ids) & hour_closed("hour", start, end)).groupBy("campaign_id", "ad_id").agg(*(F.sum(x).alias(x) for x in ("impressions", "clicks", "spend_cents")))
    about = ads.join(ad_sets.select(F.col("id").alias("ad_set_id"), "pricing_model", "bid_amount_cents"), "ad_set_id", "left").select(F.col("id").alias("ad_id"), "headline", "destination_url", "pricing_model", "bid_amount_cents")
    rows = sums.join(about, "ad_id", "left")
    return rows.select("campaign_id", "ad_id", labelled(F.col("headline"), "Ad #", F.col("ad_id")).alias("headline"), F.coalesce("destination_url", F.lit("")).alias("destination_url"), F.coalesce("pricing_model", F.lit("Unknown")).alias("pricing_model"), F.coalesce("bid_amount_cents", F.lit(0)).alias("bid_amount_cents"), "impressions", "clicks", "spend_cents", rate_pct(F.col("clicks"), F.col("impressions")).alias("ctr_pct")).orderBy("campaign_id", F.desc_nulls_first("spend_cents"), "ad_id")


def top_winning_ads(auctions: DataFrame, ads: DataFrame, campaigns: DataFrame, start, end, limit: int) -> DataFrame:
    won = auctions.where(F.col("winner_ad_id").isNotNull() & half_open("event_time", start, end)).groupBy(F.col("winner_ad_id").alias("ad_id"), F.col("winner_campaign_id").alias("campaign_id"))
    sums = won.agg(F.count(F.lit(1)).alias("auction_wins"), F.avg("winning_bid_cents").alias("avg_winning_bid_cents"), F.avg("winning_final_score").alias("avg_final_score"))
    rows = sums.join(ads.select(F.col("id").alias("ad_id"), "headline", "destination_url"), "ad_id", "left").join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("c_name")), "campaign_id", "left")
    return rows.select("ad_id", labelled(F.col("headline"), "Ad #", F.col("ad_id")).alias("headline"), F.coalesce("destination_url", F.lit("")).alias("destination_url"), "campaign_id", _campaign_label(F.col("c_name"), F.col("campaign_id")).alias("campaign_name"), "auction_wins", "avg_winning_bid_cents", "avg_final_score").orderBy(F.desc("auction_wins"), "ad_id", "campaign_id").limit(limit)


def _latest(pacing: DataFrame, tie: list[str], columns: list[str]) -> DataFrame:
    """Each campaign's last row: an aggregation, so no sort of its rows is needed."""
    return pacing.groupBy("campaign_id").agg(F.max_by(F.struct(*columns), F.struct("event_time", *tie)).alias("l")).select("campaign_id", *(F.col(f"l.{c}").alias(c) for c in columns))


def pacing_multiplier_timeseries(pacing: DataFrame, campaigns: DataFrame, campaign_ids: list[int], start, end, tie: list[str], limit: int = TIMESERIES_ROWS) -> DataFrame:
    rows = pacing.where(F.col("campaign_id").isin(campaign_ids) & half_open("event_time", start, end)).orderBy("event_time", *tie).limit(limit)
    named = rows.join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("c_name")), "campaign_id", "left")
    return named.withColumn("campaign_name", _campaign_label(F.col("c_name"), F.col("campaign_id"))).orderBy("event_time", *tie).drop("c_name", *tie)


def campaign_spend_burndown(pacing: DataFrame, campaigns: DataFrame, campaign_ids: list[int], start, end, tie: list[str], limit: int = BURNDOWN_ROWS) -> DataFrame:
    rows = pacing_multiplier_timeseries(pacing, campaigns, campaign_ids, start, end, tie, limit)
    return rows.select("event_time", "campaign_id", "campaign_name", "remaining_budget_cents", "total_budget_cents", "spent_today_cents", "daily_budget_cents")


def pacing_summary(pacing: DataFrame, campaigns: DataFrame, advertisers: DataFrame, start, end, limit: int, tie: list[str]) -> DataFrame:
    rows = pacing.where(half_open("event_time", start, end))
    money = ["spent_today_cents", "daily_budget_cents", "remaining_budget_cents", "total_budget_cents"]
    last = _latest(rows, tie, ["new_multiplier", "status", *money])
    m = "new_multiplier"
    stats = rows.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("pacing_updates"), F.avg(m).alias("avg_multiplier"), F.min(m).alias("min_multiplier"), F.max(m).alias("max_multiplier"), F.stddev_samp(m).alias("multiplier_stddev")).withColumn("multiplier_range", F.col("max_multiplier") - F.col("min_multiplier"))
    last = last.select("campaign_id", F.col(m).alias("latest_multiplier"), F.col("status").alias("latest_status"), *(F.col(x).alias(f"latest_{x}") for x in money))
    named = with_owner(stats.join(last, "campaign_id", "left"), campaigns, advertisers)
    spent = F.coalesce("c_budget", F.lit(0)) - F.coalesce("latest_remaining_budget_cents", F.lit(0))
    named = named.withColumn("campaign_name", _campaign_label(F.col("c_name"), F.col("campaign_id"))).withColumn("advertiser_name", _advertiser_label(F.col("a_name"), F.col("advertiser_id"))).withColumn("total_spend_cents", spent)
    return named.drop("c_name", "a_name", "advertiser_id", "c_budget", "c_status").orderBy(F.desc("pacing_updates"), "campaign_id").limit(limit)


def budget_exhausted_campaigns(pacing: DataFrame, campaigns: DataFrame, advertisers: DataFrame, start, end, tie: list[str]) -> DataFrame:
    rows = pacing.where((F.col("status") == "budget_exhausted") & half_open("event_time", start, end))
    last = _latest(rows, tie, ["event_time", "total_budget_cents", "remaining_budget_cents", "spent_today_cents", "daily_budget_cents"])
    named = with_owner(last, campaigns, advertisers)
    return named.select("campaign_id", _campaign_label(F.col("c_name"), F.col("campaign_id")).alias("campaign_name"), _advertiser_label(F.col("a_name"), F.col("advertiser_id")).alias("advertiser_name"), F.col("event_time").alias("exhausted_at"), nonzero_or(F.col("total_budget_cents"), F.col("c_budget")).alias("total_budget_cents"), "remaining_budget_cents", "spent_today_cents", "daily_budget_cents").orderBy("campaign_id")


def cumulative_spend(spend_buckets: DataFrame) -> DataFrame:
    """Running dollars over the buckets of a chart (a few hundred rows, one window)."""
    running = F.sum("spend_cents").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return spend_buckets.select("bucket", "spend_cents", (running / F.lit(100.0)).alias("cumulative_dollars"))


def budget_utilization(latest: DataFrame) -> DataFrame:
    """Share of the daily budget spent, in percent, and a progress of at most 1; null without a budget."""
    spent, daily = F.col("spent_today_cents"), F.col("daily_budget_cents")
    pct = F.when(daily > 0, spent / daily * 100.0)
    return latest.select("campaign_id", "spent_today_cents", "daily_budget_cents", pct.alias("utilization_pct"), F.least(pct / 100.0, F.lit(1.0)).alias("progress"))


def latest_pacing(pacing: DataFrame, start, end, tie: list[str]) -> DataFrame:
    return _latest(pacing.where(half_open("event_time", start, end)), tie, ["spent_today_cents", "daily_budget_cents"])


def spend_rate(spend_buckets: DataFrame) -> DataFrame:
    """Change from the bucket before, never below 0; null for the first."""
    before = F.lag("spend_cents").over(Window.orderBy("bucket"))
    change = F.col("spend_cents") - before
    return spend_buckets.select("bucket", "spend_cents", F.when(change < 0, 0).otherwise(change).alias("spend_rate_cents"))
