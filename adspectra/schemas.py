"""Schemas of the logical tables and messages, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspectra.functions.ratios import to_cents

CAMPAIGNS = "id int, advertiser_id int, name string, status string, total_budget bigint, start_date timestamp_ntz, end_date timestamp_ntz, updated_at timestamp_ntz"
AD_SETS = "id int, campaign_id int, name string, bid_amount_cents bigint, daily_budget_cents bigint, pricing_model string, updated_at timestamp_ntz"
ADS = "id int, ad_set_id int, headline string, description string, destination_url string, creative_type string, status string, updated_at timestamp_ntz"
IMPRESSIONS = "id bigint, event_time timestamp_ntz, auction_id string, ad_id bigint, campaign_id bigint, publisher_id string, page_url string, price_cents bigint, device_type string, user_agent string, ip_address string"
CLICKS = IMPRESSIONS + ", click_url string"
AUCTIONS = "event_time timestamp_ntz, auction_id string, publisher_id string, page_url string, num_candidates bigint, num_filtered_budget bigint, num_filtered_targeting bigint, num_eligible bigint, winner_ad_id bigint, winner_campaign_id bigint, winning_bid_cents bigint, winning_effective_bid double, winning_final_score double, device_type string, user_agent string, ip_address string"
PAGE_CONTEXT = "page_url_hash string, keywords map<string,double>, entities array<struct<text:string,type:string>>, topics map<string,struct<name:string,iab_id:string,tier:int,score:double>>, page_embedding array<float>, chunk_context array<struct<content:string,embedding:array<float>,chunk_index:int>>"

#: Values that a column may take. Fixed values.
STATUSES = ("ACTIVE", "PAUSED", "ARCHIVED", "COMPLETED", "PENDING_ANALYSIS")
PRICING_MODELS = ("CPM", "CPC")
DEVICES = ("desktop", "mobile", "tablet")
CREATIVE_TYPES = ("banner", "native", "video")
ENTITY_TYPES = ("BRAND", "PRODUCT", "ORGANIZATION", "PERSON")
#: What a bulk request needs, in the order of its messages. Fixed values.
REQUIRED = ("campaign.name", "campaign.start_date", "creative.headline", "creative.landing_page_url")
NOT_EMPTY = ("targeting.keywords", "targeting.topics", "targeting.entities", "targeting.countries", "targeting.devices")
LEAST_BUDGET_CENTS, MOST_NAME = 1, 255


def problems(*rules: tuple[Column, str | Column]) -> Column:
    """The messages of the rules that a row breaks; a rule is broken where its condition isn't true."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules]))


def one_of(name: str, allowed: tuple[str, ...]) -> Column:
    """An allowed value in any case, or none."""
    return F.coalesce(F.upper(name), F.lit("")).isin("", *allowed)


def campaign_problems() -> Column:
    c = F.col
    return problems(
        ((F.length(F.trim("name")) > 0) & (F.length("name") <= MOST_NAME), "name is missing or too long"),
        (one_of("status", STATUSES), "status is unknown"),
        (c("total_budget") >= LEAST_BUDGET_CENTS, "total budget isn't positive"),
        (c("daily_budget_cents").isNull() | (c("daily_budget_cents") <= c("total_budget")), "daily budget is over the total"),
        (c("bid_amount_cents") > 0, "bid isn't positive"),
        (one_of("pricing_model", PRICING_MODELS), "pricing model is unknown"),
        (c("end_date").isNull() | (c("end_date") > c("start_date")), "end isn't after the start"),
    )


def normalized_campaigns(requests: DataFrame) -> DataFrame:
    """Requests (name, status, pricing_model, ad_set_name, creative_type, and amounts in dollars) as they are stored.

    Status and pricing model in capitals, missing ones with their defaults, amounts in cents, cut.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    default = lambda c, other: F.when(text(F.col(c)) == "", other).otherwise(F.col(c))
    return requests.withColumns(
        {
            "status": F.upper(default("status", F.lit("ACTIVE"))),
            "pricing_model": F.upper(text(F.col("pricing_model"))),
            "ad_set_name": default("ad_set_name", F.concat(F.col("name"), F.lit(" - Default Ad Set"))),
            "creative_type": default("creative_type", F.lit("banner")),
            **{f"{c}_cents": to_cents(F.col(c)) for c in ("budget", "bid_amount", "daily_budget")},
        }
    ).drop("budget", "bid_amount", "daily_budget")


def request_problems(position: Column) -> Column:
    """The messages of a bulk request (advertiser_id; campaign, creative, targeting and ad_set as structs), counted from 1."""
    unknown = lambda what, value: F.concat(F.lit(f"invalid {what} '"), F.coalesce(value, F.lit("None")), F.lit("'"))
    known = lambda what, path, allowed: (F.col(path).isin(*allowed), unknown(what, F.col(path)))
    given = [(F.length(F.col(c).cast("string")) > 0, f"missing {c}") for c in REQUIRED]
    listed = [(F.size(c) > 0, f"empty {c}") for c in NOT_EMPTY]
    strange = F.filter("targeting.entities", lambda e: ~F.coalesce(e["type"].isin(*ENTITY_TYPES), F.lit(False)))
    entities = F.coalesce(F.transform(strange, lambda e: unknown("entity type", e["type"])), F.array().cast("array<string>"))
    first = problems((F.col("advertiser_id") != 0, "missing advertiser_id"), *given, *listed)
    last = problems(known("pricing_model", "ad_set.pricing_model", PRICING_MODELS), known("creative_type", "creative.creative_type", CREATIVE_TYPES))
    return F.transform(F.concat(first, entities, last), lambda m: F.concat(F.lit("Request "), position.cast("string"), F.lit(": "), m))
