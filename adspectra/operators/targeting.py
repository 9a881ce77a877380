"""Targeting: nested ads, the inverted index and candidate selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspectra.operators import classes

INDEX = "dim string, key string, ad_id bigint"


def active_at(as_of: Column, status: str = "status", start: str = "start_date", end: str = "end_date", closed: bool = False) -> Column:
    """Active status (in any case), started, and not ended; without an end always open."""
    before = F.col(start) <= as_of if closed else F.col(start) < as_of
    return (F.upper(status) == "ACTIVE") & before & (F.col(end).isNull() | ((F.col(end) >= as_of) if closed else (F.col(end) > as_of)))


def active_ads(ads: DataFrame, ad_sets: DataFrame, campaigns: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Ads of ad sets of active campaigns, with what an auction needs; as_of: the campaign must also run at that moment."""
    running = F.upper("status") == "ACTIVE" if as_of is None else active_at(as_of)
    c = campaigns.where(running).select(F.col("id").alias("campaign_id"))
    s = ad_sets.select(F.col("id").alias("ad_set_id"), "campaign_id", "pricing_model", "bid_amount_cents")
    return ads.select(F.col("id").alias("ad_id"), "ad_set_id", "headline").join(s, "ad_set_id").join(c, "campaign_id")


def changed_since(ads: DataFrame, ad_sets: DataFrame, campaigns: DataFrame, moment: Column) -> DataFrame:
    """Ads of which the ad, its ad set or its campaign changed after a moment: one semi join on the ad's id."""
    fresh = lambda df: df.where(F.col("updated_at") > moment)
    by_set = ads.join(fresh(ad_sets).select(F.col("id").alias("ad_set_id")), "ad_set_id", "left_semi").select("id")
    sets = ad_sets.join(fresh(campaigns).select(F.col("id").alias("campaign_id")), "campaign_id", "left_semi").select(F.col("id").alias("ad_set_id"))
    by_campaign = ads.join(sets, "ad_set_id", "left_semi").select("id")
    return ads.join(fresh(ads).select("id").union(by_set).union(by_campaign), "id", "left_semi")


def nested_ads(ads: DataFrame, keywords: DataFrame, topics: DataFrame, entities: DataFrame, countries: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per ad with its targeting as sorted arrays, empty where it has none."""
    out = ads
    for name, rows, item in (
        ("keywords", keywords, F.struct("keyword", "relevance_score")),
        ("topics", topics, F.struct(*(c for c in ("topic_id", "tier", "relevance_score", "mapped_id") if c in topics.columns))),
        ("entities", entities, F.struct("text", "type")),
        ("countries", countries, F.col("country")),
        ("devices", devices, F.col("device")),
    ):
        lists = rows.groupBy("ad_id").agg(F.sort_array(F.collect_list(item)).alias(name))
        out = out.join(lists, "ad_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def page_context(keywords: DataFrame, topics: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per page with its keywords, topics and entities as sorted arrays."""
    lists = [rows.groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias(name)) for name, rows, item in (("keywords", keywords, F.struct("keyword", "relevance_score")), ("topics", topics, F.struct("topic_id", "tier", "relevance_score")), ("entities", entities, F.struct("text", "type")))]
    return lists[0].join(lists[1], "page_id", "full").join(lists[2], "page_id", "full")


def context_or_default(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each request's page context; where the page is unknown, its own ``request_keywords`` with weight 1."""
    own = F.transform(F.coalesce("request_keywords", F.array().cast("array<string>")), lambda k: F.struct(k.alias("keyword"), F.lit(1.0).alias("relevance_score")))
    joined = requests.join(contexts.withColumn("cached", F.lit(True)), "page_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return joined.withColumn("keywords", F.when(F.col("cached"), F.col("keywords")).otherwise(own))


def build_index(keywords: DataFrame, topics: DataFrame, entities: DataFrame, countries: DataFrame, devices: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """The inverted index as a long table (dim, key, ad_id); active: the only ads (ad_id) that it holds."""
    one = lambda df, dim, key: df.select(F.lit(dim).alias("dim"), F.col(key).alias("key"), "ad_id")
    parts = [one(keywords, "keyword", "keyword"), one(topics, "topic", "topic_id"), one(entities, "entity", "text"), one(countries, "country", "country"), one(devices, "device", "device")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if active is not None:
        out = out.join(active.select("ad_id"), "ad_id", "left_semi").select("dim", "key", "ad_id")
    return out.distinct()


def refresh_index(index: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the rows of the changed ads (ad_id) replaced by fresh ones; a changed ad without fresh rows, as one that is no longer active, goes."""
    return index.join(changed.select("ad_id"), "ad_id", "left_anti").select("dim", "key", "ad_id").unionByName(fresh.select("dim", "key", "ad_id"))


def index_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("dim", "key").agg(F.countDistinct("ad_id").alias("ads"))


def page_matches(page_keys: DataFrame, index: DataFrame) -> DataFrame:
    """(page_id, ad_id) of ads that share a keyword, topic or entity with a page; keys compare exactly."""
    return page_keys.join(index, ["dim", "key"]).select("page_id", "ad_id").distinct()


def matching_pairs(pairs: DataFrame, page_keys: DataFrame, index: DataFrame) -> DataFrame:
    """Those of given pairs (page_id, ad_id) that ``page_matches`` has: the keys of these pages meet the index by ad, so no other pairs are made."""
    keyed = pairs.select("page_id", "ad_id").join(page_keys, "page_id")
    return keyed.join(index.select("dim", "key", "ad_id").distinct(), ["dim", "key", "ad_id"], "left_semi").select("page_id", "ad_id").distinct()


def fitting(requests: DataFrame, pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(request_id, page_id, ad_id): the given pairs (page_id, ad_id) of each request's page whose country and device fit, as of ``find_candidates``."""
    met = requests.join(pairs.select("page_id", "ad_id").distinct(), "page_id")
    for dim in ("country", "device"):
        own = index.where(F.col("dim") == dim)
        met = met.join(own.select(F.col("key").alias(dim), F.lit(True).alias(f"{dim}_known")).distinct(), dim, "left")
        met = met.join(own.groupBy("ad_id").agg(F.collect_set("key").alias(f"{dim}s")), "ad_id", "left")
    fits = lambda dim: F.col(f"{dim}_known").isNull() | F.coalesce(F.array_contains(f"{dim}s", F.col(dim)), F.lit(False))
    return met.where(fits("country") & fits("device")).select("request_id", "page_id", "ad_id")


def find_candidates(requests: DataFrame, page_keys: DataFrame, index: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(request_id, ad_id) of ads that match a request's country, device and page.

    requests: request_id, page_id, country, device; page_keys: page_id, dim (keyword, topic or
    entity), key; active: the ads (ad_id) that may be given at all.  A page match on any key is enough.  A country or device
    filters only if some ad targets it: then ads without it are out.  A request has one row.

    Pages of one set of keys (of those that some ad has) are a class, with country and device one of requests; ads of one set of keys (of those that
    some page has), countries and devices are another.  Classes are matched; requests and ads meet in the result alone.
    """
    if active is not None:
        index = index.join(active.select("ad_id"), "ad_id", "left_semi")
    filters = F.col("dim").isin("country", "device")
    keyed, of = index.where(~filters), F.sort_array(F.collect_set(F.struct("dim", "key")))
    asked = page_keys.join(requests.select("page_id").distinct(), "page_id", "left_semi")
    pages, page_sets = classes.numbered(asked.join(keyed.select("dim", "key").distinct(), ["dim", "key"], "left_semi").groupBy("page_id").agg(of.alias("page")), "page_id", "page", "p")
    ads, ad_sets = classes.numbered(keyed.join(asked.select("dim", "key").distinct(), ["dim", "key"], "left_semi").groupBy("ad_id").agg(of.alias("ad")), "ad_id", "ad", "a")
    # Null keys tell classes apart but match nothing.
    text = lambda x: F.to_json(F.struct(x["dim"], x["key"]))
    known = lambda c: F.transform(F.filter(c, lambda x: x["dim"].isNotNull() & x["key"].isNotNull()), text)
    matches = classes.sharing(page_sets, ad_sets, known(F.col("page")), known(F.col("ad"))).select("p", "a")
    asking, offered = requests.select("request_id", "page_id", "country", "device").join(pages, "page_id"), ads
    for dim in ("country", "device"):
        own = index.where(F.col("dim") == dim)
        offered = offered.join(own.groupBy("ad_id").agg(F.sort_array(F.collect_set("key")).alias(f"{dim}s")), "ad_id", "left")
    request, ad = ("p", "country", "device"), ("a", "countrys", "devices")
    left, right = classes.classes(asking, "request_id", *request).withColumnRenamed("class", "l").drop("n"), classes.classes(offered, "ad_id", *ad).withColumnRenamed("class", "r").drop("n")
    for dim in ("country", "device"):
        left = left.join(index.where(F.col("dim") == dim).select(F.col("key").alias(dim), F.lit(True).alias(f"{dim}_known")).distinct(), dim, "left")
    fits = lambda dim: F.col(f"{dim}_known").isNull() | F.coalesce(F.array_contains(f"{dim}s", F.col(dim)), F.lit(False))
    met = left.join(matches, "p").join(right, "a").where(fits("country") & fits("device")).select("l", "r")
    members = [classes.blocks(classes.placed(rows, key, *features), key) for rows, key, features in ((asking, "request_id", request), (offered, "ad_id", ad))]
    return classes.expanded(met, *members, "request_id", "ad_id")
