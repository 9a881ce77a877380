"""The registered business queries: rollups and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspectra.registry import query, rounded
from adspectra.sources.driver import Tables, with_tables

from . import dashboards as d
from . import incremental, rollups

START, END = "2024-01-05 06:30:00", "2024-01-20 18:45:00"
P_START, P_END = "1996-01-01", "1999-07-01"
CAMPAIGNS = [0, 1, 2, 3, 16, 17]
TIE = ["l_orderkey", "l_linenumber", "l_partkey"]
BUCKET = 3600

RANGE = f"event_time >= TIMESTAMP '{START}' AND event_time < TIMESTAMP '{END}'"
HOURS = f"hour BETWEEN date_trunc('hour', TIMESTAMP '{START}') AND date_trunc('hour', TIMESTAMP '{END}')"
P_RANGE = f"event_time >= TIMESTAMP '{P_START}' AND event_time < TIMESTAMP '{P_END}'"
CHOSEN = "campaign_id IN (" + ", ".join(map(str, CAMPAIGNS)) + ")"

AD_HOURS = """SELECT s.hour, s.ad_id, s.campaign_id, s.impressions, coalesce(k.n, 0) AS clicks, s.spend_cents
FROM (SELECT date_trunc('hour', event_time) AS hour, ad_id, campaign_id, count(DISTINCT id) AS impressions, CAST(sum(price_cents) AS BIGINT) AS spend_cents FROM impressions GROUP BY ALL) s
LEFT JOIN (SELECT date_trunc('hour', event_time) AS hour, ad_id, count(*) AS n FROM clicks GROUP BY ALL) k ON k.hour = s.hour AND k.ad_id = s.ad_id"""
CAMPAIGN_HOURS = """SELECT s.hour, s.campaign_id, s.impressions, coalesce(k.n, 0) AS clicks, s.spend_cents
FROM (SELECT date_trunc('hour', event_time) AS hour, campaign_id, count(DISTINCT id) AS impressions, CAST(sum(price_cents) AS BIGINT) AS spend_cents FROM impressions GROUP BY ALL) s
LEFT JOIN (SELECT date_trunc('hour', event_time) AS hour, campaign_id, count(*) AS n FROM clicks GROUP BY ALL) k ON k.hour = s.hour AND k.campaign_id = s.campaign_id"""
CTR = "round(coalesce(clicks::DOUBLE / nullif(impressions, 0) * 100, 0), 6)"
ECPM = "round(coalesce(spend_cents::DOUBLE / nullif(impressions, 0) * 10, 0), 6)"
BUCKETED = f"to_timestamp(floor(epoch(event_time) / {BUCKET}) * {BUCKET}) AT TIME ZONE 'UTC'"
OWNED = "LEFT JOIN campaigns c ON c.id = x.campaign_id LEFT JOIN advertisers v ON v.id = c.advertiser_id"
C_LABEL = "coalesce(c.name, 'Campaign #' || x.campaign_id)"
V_LABEL = "coalesce(v.name, 'Advertiser #' || coalesce(CAST(c.advertiser_id AS VARCHAR), '?'))"


def ad_hours(t: Tables) -> DataFrame:
    return rollups.ad_metrics_hourly(t.impressions, t.clicks)


def _of_batches(t: Tables, rollup: incremental.Rollup) -> DataFrame:
    batch = lambda k: {x: getattr(t, x).where(F.pmod(F.xxhash64("*"), F.lit(3)) == k) for x in rollup.facts}
    states = [rollup.state(batch(k)) for k in range(3)]
    return rollup.measures(incremental.added(rollup, states[0].unionByName(states[1]).unionByName(states[2])))


def campaign_hours(t: Tables) -> DataFrame:
    return rollups.campaign_metrics_hourly(t.impressions, t.clicks)


@query(with_tables(f"SELECT *, {ECPM} AS avg_ecpm, {CTR} AS avg_ctr FROM h", "impressions", "clicks", h=AD_HOURS))
def ad_metrics_hourly(t: Tables) -> DataFrame:
    return rounded(ad_hours(t))


@query(with_tables(f"SELECT *, {ECPM} AS avg_ecpm, {CTR} AS avg_ctr FROM h", "impressions", "clicks", h=AD_HOURS))
def ad_metrics_added(t: Tables) -> DataFrame:
    """As ``ad_metrics_hourly``, of states of three batches that are added up."""
    return rounded(_of_batches(t, incremental.AD_METRICS))


@query(with_tables(f"SELECT *, {ECPM} AS avg_ecpm, {CTR} AS avg_ctr FROM h", "impressions", "clicks", h=CAMPAIGN_HOURS))
def campaign_metrics_hourly(t: Tables) -> DataFrame:
    return rounded(campaign_hours(t))


@query(
    with_tables(
        """SELECT date_trunc('hour', event_time) AS hour, count(*) AS total_auctions, count(winner_ad_id) AS auctions_with_winner,
        round(avg(num_candidates), 6) AS avg_candidates, round(avg(num_filtered_budget), 6) AS avg_filtered_budget, round(avg(num_filtered_targeting), 6) AS avg_filtered_targeting, round(avg(num_eligible), 6) AS avg_eligible,
        round(avg(winning_bid_cents), 6) AS avg_winning_bid_cents, round(quantile_cont(winning_bid_cents::DOUBLE, 0.5), 6) AS median_winning_bid_cents, round(count(winner_ad_id)::DOUBLE / count(*) * 100, 6) AS fill_rate_pct
        FROM auctions GROUP BY 1""",
        "auctions",
    )
)
def auction_metrics_hourly(t: Tables) -> DataFrame:
    return rounded(rollups.auction_metrics_hourly(t.auctions))


@query(
    with_tables(
        """SELECT date_trunc('hour', event_time) AS hour, count(*) AS total_auctions, count(winner_ad_id) AS auctions_with_winner,
        round(avg(num_candidates), 6) AS avg_candidates, round(avg(num_filtered_budget), 6) AS avg_filtered_budget, round(avg(num_filtered_targeting), 6) AS avg_filtered_targeting, round(avg(num_eligible), 6) AS avg_eligible,
        round(avg(winning_bid_cents), 6) AS avg_winning_bid_cents, round(quantile_cont(winning_bid_cents::DOUBLE, 0.5), 6) AS median_winning_bid_cents, round(count(winner_ad_id)::DOUBLE / count(*) * 100, 6) AS fill_rate_pct
        FROM auctions GROUP BY 1""",
        "auctions",
    )
)
def auction_metrics_added(t: Tables) -> DataFrame:
    """As ``auction_metrics_hourly``, of states of three batches that are added up."""
    return rounded(_of_batches(t, incremental.AUCTION_METRICS))


@query(
    with_tables(
        f"""SELECT i.n AS total_impressions, coalesce(i.s, 0) AS total_spend_cents, k.n AS total_clicks, a.n AS total_auctions, a.w AS auctions_filled,
        round(coalesce(k.n::DOUBLE / nullif(i.n, 0) * 100, 0), 6) AS ctr_pct, round(coalesce(a.w::DOUBLE / nullif(a.n, 0) * 100, 0), 6) AS fill_rate_pct
        FROM (SELECT count(*) n, CAST(sum(price_cents) AS BIGINT) s FROM impressions WHERE {RANGE}) i, (SELECT count(*) n FROM clicks WHERE {RANGE}) k, (SELECT count(*) n, count(winner_ad_id) w FROM auctions WHERE {RANGE}) a""",
        "impressions",
        "clicks",
        "auctions",
    )
)
def kpi_summary(t: Tables) -> DataFrame:
    return rounded(d.kpi_summary(t.impressions, t.clicks, t.auctions, START, END))


@query(with_tables(f"SELECT count(DISTINCT campaign_id) AS active_campaigns FROM h WHERE {HOURS}", "impressions", "clicks", h=CAMPAIGN_HOURS))
def active_campaigns_count(t: Tables) -> DataFrame:
    return d.active_campaigns_count(campaign_hours(t), START, END)


@query(with_tables(f"SELECT {BUCKETED} AS bucket, CAST(sum(price_cents) AS BIGINT) AS spend_cents, count(*) AS impressions FROM impressions WHERE {RANGE} GROUP BY 1", "impressions"))
def spend_over_time(t: Tables) -> DataFrame:
    return d.spend_over_time(t.impressions, START, END, BUCKET)


@query(with_tables(f"SELECT {BUCKETED} AS bucket, count(*) AS impressions FROM impressions WHERE {RANGE} GROUP BY 1", "impressions"))
def impressions_over_time(t: Tables) -> DataFrame:
    return d.events_over_time(t.impressions, START, END, BUCKET, "impressions")


@query(with_tables(f"SELECT {BUCKETED} AS bucket, count(*) AS clicks FROM clicks WHERE {RANGE} GROUP BY 1", "clicks"))
def clicks_over_time(t: Tables) -> DataFrame:
    return d.events_over_time(t.clicks, START, END, BUCKET, "clicks")


@query(with_tables(f"SELECT {BUCKETED} AS bucket, count(*) AS total_auctions, count(winner_ad_id) AS filled_auctions, round(count(winner_ad_id)::DOUBLE / count(*) * 100, 6) AS fill_rate_pct FROM auctions WHERE {RANGE} GROUP BY 1", "auctions"))
def fill_rate_over_time(t: Tables) -> DataFrame:
    return rounded(d.fill_rate_over_time(t.auctions, START, END, BUCKET))


SUMS = f"SELECT campaign_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(spend_cents) AS BIGINT) AS spend_cents FROM h WHERE {HOURS} GROUP BY 1"


@query(
    with_tables(
        "SELECT coalesce(v.name, 'Advertiser #' || c.advertiser_id) AS advertiser_name, c.advertiser_id, CAST(sum(x.spend_cents) AS BIGINT) AS spend_cents, CAST(sum(x.impressions) AS BIGINT) AS impressions FROM x " + OWNED + " GROUP BY v.name, c.advertiser_id ORDER BY spend_cents DESC, advertiser_id LIMIT 20",
        "impressions",
        "clicks",
        "campaigns",
        "advertisers",
        h=CAMPAIGN_HOURS,
        x=SUMS,
    )
)
def spend_by_advertiser(t: Tables) -> DataFrame:
    return d.spend_by_advertiser(campaign_hours(t), t.campaigns, t.advertisers, START, END)


@query(
    with_tables(
        f"SELECT coalesce(s.pricing_model, 'Unknown') AS pricing_model, CAST(sum(spend_cents) AS BIGINT) AS spend_cents, CAST(sum(impressions) AS BIGINT) AS impressions FROM h LEFT JOIN ads a ON a.id = h.ad_id LEFT JOIN ad_sets s ON s.id = a.ad_set_id WHERE {HOURS} GROUP BY s.pricing_model",
        "impressions",
        "clicks",
        "ads",
        "ad_sets",
        h=AD_HOURS,
    )
)
def spend_by_pricing_model(t: Tables) -> DataFrame:
    return d.spend_by_pricing_model(ad_hours(t), t.ads, t.ad_sets, START, END)


PERFORMANCE = f"""SELECT x.campaign_id, {C_LABEL} AS campaign_name, {V_LABEL} AS advertiser_name, CAST(sum(x.impressions) AS BIGINT) AS impressions, CAST(sum(x.clicks) AS BIGINT) AS clicks, CAST(sum(x.spend_cents) AS BIGINT) AS spend_cents,
c.total_budget AS total_budget_cents, coalesce(s.daily_budget_cents, 0) AS daily_budget_cents, c.status AS campaign_status FROM x {OWNED} LEFT JOIN ad_sets s ON s.campaign_id = c.id GROUP BY x.campaign_id, c.name, v.name, c.advertiser_id, c.total_budget, c.status, s.daily_budget_cents"""
OWNERS = ("impressions", "clicks", "campaigns", "advertisers", "ad_sets")


@query(with_tables(f"SELECT *, {CTR} AS ctr_pct, {ECPM} AS ecpm_dollars FROM p", *OWNERS, h=CAMPAIGN_HOURS, x=SUMS, p=PERFORMANCE))
def campaign_performance(t: Tables) -> DataFrame:
    return rounded(d.campaign_performance(campaign_hours(t), t.campaigns, t.advertisers, t.ad_sets, START, END))


@query(with_tables("SELECT * EXCLUDE (clicks) FROM p ORDER BY impressions DESC, campaign_id, daily_budget_cents LIMIT 10", *OWNERS, h=CAMPAIGN_HOURS, x=SUMS, p=PERFORMANCE))
def top_campaigns_by_impressions(t: Tables) -> DataFrame:
    return d.top_campaigns_by_impressions(campaign_hours(t), t.campaigns, t.advertisers, t.ad_sets, START, END, 10)


@query(
    with_tables(
        f"""SELECT *, {CTR} AS ctr_pct FROM (SELECT h.campaign_id, h.ad_id, coalesce(a.headline, 'Ad #' || h.ad_id) AS headline, coalesce(a.destination_url, '') AS destination_url, coalesce(s.pricing_model, 'Unknown') AS pricing_model, coalesce(s.bid_amount_cents, 0) AS bid_amount_cents,
        CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(spend_cents) AS BIGINT) AS spend_cents FROM h LEFT JOIN ads a ON a.id = h.ad_id LEFT JOIN ad_sets s ON s.id = a.ad_set_id WHERE h.{CHOSEN} AND {HOURS} GROUP BY ALL)""",
        "impressions",
        "clicks",
        "ads",
        "ad_sets",
        h=AD_HOURS,
    )
)
def ads_in_campaigns(t: Tables) -> DataFrame:
    return rounded(d.ads_in_campaigns(ad_hours(t), t.ads, t.ad_sets, CAMPAIGNS, START, END))


@query(
    with_tables(
        f"""SELECT w.winner_ad_id AS ad_id, coalesce(a.headline, 'Ad #' || w.winner_ad_id) AS headline, coalesce(a.destination_url, '') AS destination_url, w.winner_campaign_id AS campaign_id, coalesce(c.name, 'Campaign #' || w.winner_campaign_id) AS campaign_name,
        count(*) AS auction_wins, round(avg(w.winning_bid_cents), 10) AS avg_winning_bid_cents, round(avg(w.winning_final_score), 10) AS avg_final_score
        FROM auctions w LEFT JOIN ads a ON a.id = w.winner_ad_id LEFT JOIN campaigns c ON c.id = w.winner_campaign_id WHERE w.winner_ad_id IS NOT NULL AND {RANGE} GROUP BY w.winner_ad_id, a.headline, a.destination_url, w.winner_campaign_id, c.name ORDER BY auction_wins DESC, ad_id, campaign_id LIMIT 20""",
        "auctions",
        "ads",
        "campaigns",
    )
)
def top_winning_ads(t: Tables) -> DataFrame:
    return rounded(d.top_winning_ads(t.auctions, t.ads, t.campaigns, START, END, 20), decimals=10)  # six decimals meet ties


@query(
    with_tables(
        f"""SELECT x.event_time, x.campaign_id, {C_LABEL} AS campaign_name, x.previous_multiplier, x.new_multiplier, round(x.error_normalized, 6) AS error_normalized, x.p_term, x.i_term, x.urgency, x.spent_today_cents, x.daily_budget_cents, x.remaining_budget_cents, x.total_budget_cents, x.status
        FROM (SELECT * FROM pacing WHERE {CHOSEN} AND {P_RANGE} ORDER BY event_time, l_orderkey, l_linenumber, l_partkey LIMIT 10000) x LEFT JOIN campaigns c ON c.id = x.campaign_id""",
        "pacing",
        "campaigns",
    )
)
def pacing_multiplier_timeseries(t: Tables) -> DataFrame:
    return rounded(d.pacing_multiplier_timeseries(t.pacing_history, t.campaigns, CAMPAIGNS, P_START, P_END, TIE), "error_normalized")


@query(
    with_tables(
        f"""SELECT x.event_time, x.campaign_id, {C_LABEL} AS campaign_name, x.remaining_budget_cents, x.total_budget_cents, x.spent_today_cents, x.daily_budget_cents
        FROM (SELECT * FROM pacing WHERE {CHOSEN} AND {P_RANGE} ORDER BY event_time, l_orderkey, l_linenumber, l_partkey LIMIT 5000) x LEFT JOIN campaigns c ON c.id = x.campaign_id""",
        "pacing",
        "campaigns",
    )
)
def campaign_spend_burndown(t: Tables) -> DataFrame:
    return d.campaign_spend_burndown(t.pacing_history, t.campaigns, CAMPAIGNS, P_START, P_END, TIE)


LATEST = f"SELECT * FROM pacing WHERE {P_RANGE} QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY event_time DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1"


@query(
    with_tables(
        f"""SELECT x.campaign_id, {C_LABEL} AS campaign_name, {V_LABEL} AS advertiser_name, x.n AS pacing_updates, round(x.a, 6) AS avg_multiplier, round(x.lo, 6) AS min_multiplier, round(x.hi, 6) AS max_multiplier, round(x.sd, 6) AS multiplier_stddev, round(x.hi - x.lo, 6) AS multiplier_range,
        round(l.new_multiplier, 6) AS latest_multiplier, l.status AS latest_status, l.spent_today_cents AS latest_spent_today_cents, l.daily_budget_cents AS latest_daily_budget_cents, l.remaining_budget_cents AS latest_remaining_budget_cents, l.total_budget_cents AS latest_total_budget_cents, coalesce(c.total_budget, 0) - coalesce(l.remaining_budget_cents, 0) AS total_spend_cents
        FROM (SELECT campaign_id, count(*) AS n, avg(new_multiplier) AS a, min(new_multiplier) AS lo, max(new_multiplier) AS hi, stddev_samp(new_multiplier) AS sd FROM pacing WHERE {P_RANGE} GROUP BY 1) x JOIN latest l ON l.campaign_id = x.campaign_id {OWNED} ORDER BY n DESC, x.campaign_id LIMIT 15""",
        "pacing",
        "campaigns",
        "advertisers",
        latest=LATEST,
    )
)
def pacing_summary(t: Tables) -> DataFrame:
    return rounded(d.pacing_summary(t.pacing_history, t.campaigns, t.advertisers, P_START, P_END, 15, TIE))


@query(
    with_tables(
        f"""SELECT x.campaign_id, {C_LABEL} AS campaign_name, {V_LABEL} AS advertiser_name, x.event_time AS exhausted_at, coalesce(nullif(x.total_budget_cents, 0), c.total_budget, 0) AS total_budget_cents, x.remaining_budget_cents, x.spent_today_cents, x.daily_budget_cents
        FROM (SELECT * FROM pacing WHERE status = 'budget_exhausted' AND {P_RANGE} QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY event_time DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1) x {OWNED}""",
        "pacing",
        "campaigns",
        "advertisers",
    )
)
def budget_exhausted_campaigns(t: Tables) -> DataFrame:
    return d.budget_exhausted_campaigns(t.pacing_history, t.campaigns, t.advertisers, P_START, P_END, TIE)


SPEND = f"SELECT {BUCKETED} AS bucket, CAST(sum(price_cents) AS BIGINT) AS spend_cents FROM impressions WHERE {RANGE} GROUP BY 1"


@query(with_tables("SELECT bucket, spend_cents, round(CAST(sum(spend_cents) OVER (ORDER BY bucket) AS BIGINT) / 100.0::DOUBLE, 6) AS cumulative_dollars FROM s", "impressions", s=SPEND))
def cumulative_spend(t: Tables) -> DataFrame:
    return rounded(d.cumulative_spend(d.spend_over_time(t.impressions, START, END, BUCKET)))


@query(with_tables("SELECT bucket, spend_cents, greatest(spend_cents - lag(spend_cents) OVER (ORDER BY bucket), CASE WHEN lag(spend_cents) OVER (ORDER BY bucket) IS NOT NULL THEN 0 END) AS spend_rate_cents FROM s", "impressions", s=SPEND))
def spend_rate_delta(t: Tables) -> DataFrame:
    return d.spend_rate(d.spend_over_time(t.impressions, START, END, BUCKET))


@query(with_tables("SELECT campaign_id, spent_today_cents, daily_budget_cents, round(u, 6) AS utilization_pct, round(least(u / 100, 1), 6) AS progress FROM (SELECT *, spent_today_cents::DOUBLE / nullif(daily_budget_cents, 0) * 100 AS u FROM latest)", "pacing", latest=LATEST))
def budget_utilization(t: Tables) -> DataFrame:
    return rounded(d.budget_utilization(d.latest_pacing(t.pacing_history, P_START, P_END, TIE)))
