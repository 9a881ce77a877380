"""The logical advertising tables over the test tables; ``SQL`` spells the same mappings for an oracle.

Nothing here scans more columns than a query uses: every mapping is a projection or filter that
Catalyst merges into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ship


class Tables:
    """The logical tables of one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _tracked(self, kind: str) -> DataFrame:
        cents = F.floor(F.col("value") * 100).cast("bigint")
        return self.raw("events").where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.col("ts").alias("event_time"), F.col("user_id").alias("ad_id"), (F.col("user_id") % 20).alias("campaign_id"), (F.col("event_id") % 10).alias("publisher_id"), cents.alias("price_cents"))

    @property
    def impressions(self) -> DataFrame:
        return self._tracked("view")

    @property
    def clicks(self) -> DataFrame:
        return self._tracked("click")

    @property
    def auctions(self) -> DataFrame:
        won = F.col("event_type").isin("purchase", "view")
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("auction_id"),
            F.col("ts").alias("event_time"),
            F.when(won, F.col("user_id")).alias("winner_ad_id"),
            F.when(won, F.col("user_id") % 20).alias("winner_campaign_id"),
            F.when(won, F.floor(F.col("value") * 100).cast("bigint")).alias("winning_bid_cents"),
            F.when(won, (e % 1000) / F.lit(1000.0)).alias("winning_final_score"),
            (e % 40 + 5).alias("num_candidates"),
            (e % 7).alias("num_filtered_budget"),
            (e % 11).alias("num_filtered_targeting"),
            (e % 5 + 1).alias("num_eligible"),
            (e % 10).alias("publisher_id"),
        )

    @property
    def advertisers(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))

    @property
    def campaigns(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        status = F.when(segment.isin("BUILDING", "AUTOMOBILE"), "ACTIVE").when(segment == "MACHINERY", "PAUSED").otherwise("PENDING_ANALYSIS")
        start = F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_interval(0, 0, 0, cast(c_custkey as int) * 2)")
        return self.raw("customer").where("c_custkey < 15").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("advertiser_id"), F.col("c_name").alias("name"), F.floor(F.abs("c_acctbal") * 100).cast("bigint").alias("total_budget"), status.alias("status"), start.alias("start_date"), F.when(F.col("c_custkey") % 3 > 0, start + F.expr("interval 30 days")).alias("end_date"))

    @property
    def ad_sets(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.raw("part").select(p.alias("id"), (p % 20).alias("campaign_id"), F.floor("p_retailprice").cast("bigint").alias("bid_amount_cents"), (F.col("p_size") * 1000).cast("bigint").alias("daily_budget_cents"), F.when(F.col("p_size") % 2 == 1, "CPC").otherwise("CPM").alias("pricing_model"))

    @property
    def ads(self) -> DataFrame:
        return self.raw("part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ad_set_id"), F.col("p_name").alias("headline"), F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string")).alias("destination_url"))

    @property
    def pacing_history(self) -> DataFrame:
        cents = lambda c, k: F.floor(F.col(c) * k).cast("bigint")
        return self.raw("lineitem").select(
            F.col("l_shipdate").alias("event_time"),
            (F.col("l_suppkey") % 20).alias("campaign_id"),
            (F.lit(1.0) + F.col("l_tax")).alias("previous_multiplier"),
            (F.lit(1.0) + F.col("l_discount")).alias("new_multiplier"),
            (F.col("l_discount") - F.col("l_tax")).alias("error_normalized"),
            F.col("l_tax").alias("p_term"),
            F.col("l_discount").alias("i_term"),
            (F.col("l_quantity") / 50.0).alias("urgency"),
            cents("l_extendedprice", 1).alias("spent_today_cents"),
            cents("l_quantity", 1000).alias("daily_budget_cents"),
            cents("l_extendedprice", 50).alias("remaining_budget_cents"),
            cents("l_extendedprice", 200).alias("total_budget_cents"),
            F.when(F.col("l_returnflag") == "R", "budget_exhausted").otherwise("ok").alias("status"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
        )

    # Targeting: words of a part's name are keywords, its size a topic, its brand an entity.

    @property
    def ad_keywords(self) -> DataFrame:
        words = F.explode(F.split(F.lower("p_name"), " "))
        return self.raw("part").select(F.col("p_partkey").alias("ad_id"), words.alias("keyword"), ((F.col("p_partkey") % 50 + 50) / F.lit(100.0)).alias("relevance_score"))

    @property
    def ad_topics(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("ad_id"), (F.col("p_size") % 30).cast("string").alias("topic_id"), (F.col("p_partkey") % 3 + 1).cast("int").alias("tier"), F.lit(0.8).alias("relevance_score"))

    @property
    def ad_entities(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("ad_id"), F.col("p_brand").alias("text"), F.when(F.col("p_partkey") % 2 == 0, "BRAND").otherwise("ORG").alias("type"))

    @property
    def ad_countries(self) -> DataFrame:
        k = F.col("p_partkey") % 3
        return self.raw("part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("ad_id"), F.when(k == 0, "US").when(k == 1, "GB").otherwise("DE").alias("country"))

    @property
    def ad_devices(self) -> DataFrame:
        return self.raw("part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("ad_id"), F.when(F.col("p_partkey") % 2 == 0, "desktop").otherwise("mobile").alias("device"))

    @property
    def page_keywords(self) -> DataFrame:
        words = F.explode(F.split(F.lower("p_name"), " "))
        return self.raw("part").select(F.col("p_partkey").alias("page_id"), words.alias("keyword"), ((F.col("p_partkey") % 10 + 1) / F.lit(10.0)).alias("relevance_score"))

    @property
    def page_topics(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("page_id"), (F.col("p_size") % 30 + 100).cast("string").alias("topic_id"), (F.col("p_partkey") % 2 + 1).cast("int").alias("tier"), F.lit(0.9).alias("relevance_score"))

    @property
    def page_entities(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("the "), F.col("p_brand"), F.lit(" store")).alias("text"), F.lit("BRAND").alias("type"))

    @property
    def topic_mapping(self) -> DataFrame:
        """Product topic to content topic; multiples of four have none."""
        return self.spark.range(30).where("id % 4 <> 0").select(F.col("id").cast("string").alias("product_id"), (F.col("id") + 100).cast("string").alias("content_id"))

    @property
    def requests(self) -> DataFrame:
        """Ad requests: page, country and device."""
        k = F.col("o_orderkey")
        return self.raw("orders").select(k.alias("request_id"), F.col("o_custkey").alias("page_id"), F.when(k % 4 == 0, "US").when(k % 4 == 1, "GB").when(k % 4 == 2, "DE").otherwise("FR").alias("country"), F.when(k % 3 == 0, "desktop").when(k % 3 == 1, "mobile").otherwise("tablet").alias("device"))

    @property
    def ad_vectors(self) -> DataFrame:
        return self.raw("embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("ad_id"), "embedding", "label")

    @property
    def page_vectors(self) -> DataFrame:
        return self.raw("embeddings").where("vec_id % 2 = 1").select(F.col("vec_id").alias("page_id"), "embedding", "label")


#: Each logical table as a query on the test tables.
SQL = {
    "impressions": "SELECT event_id AS id, ts AS event_time, user_id AS ad_id, user_id % 20 AS campaign_id, event_id % 10 AS publisher_id, CAST(floor(value * 100) AS BIGINT) AS price_cents FROM events WHERE event_type = 'view'",
    "clicks": "SELECT event_id AS id, ts AS event_time, user_id AS ad_id, user_id % 20 AS campaign_id, event_id % 10 AS publisher_id, CAST(floor(value * 100) AS BIGINT) AS price_cents FROM events WHERE event_type = 'click'",
    "auctions": "SELECT event_id AS auction_id, ts AS event_time, CASE WHEN won THEN user_id END AS winner_ad_id, CASE WHEN won THEN user_id % 20 END AS winner_campaign_id, CASE WHEN won THEN CAST(floor(value * 100) AS BIGINT) END AS winning_bid_cents, CASE WHEN won THEN (event_id % 1000) / 1000.0::DOUBLE END AS winning_final_score, event_id % 40 + 5 AS num_candidates, event_id % 7 AS num_filtered_budget, event_id % 11 AS num_filtered_targeting, event_id % 5 + 1 AS num_eligible, event_id % 10 AS publisher_id FROM (SELECT *, event_type IN ('purchase', 'view') AS won FROM events)",
    "advertisers": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation",
    "campaigns": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS advertiser_id, c_name AS name, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) AS total_budget, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'ACTIVE' WHEN c_mktsegment = 'MACHINERY' THEN 'PAUSED' ELSE 'PENDING_ANALYSIS' END AS status, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey * 2 AS INTEGER)) AS start_date, CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-01-31' + to_days(CAST(c_custkey * 2 AS INTEGER)) END AS end_date FROM customer WHERE c_custkey < 15",
    "ad_sets": "SELECT p_partkey AS id, p_partkey % 20 AS campaign_id, CAST(floor(p_retailprice) AS BIGINT) AS bid_amount_cents, CAST(p_size * 1000 AS BIGINT) AS daily_budget_cents, CASE WHEN p_size % 2 = 1 THEN 'CPC' ELSE 'CPM' END AS pricing_model FROM part",
    "ads": "SELECT p_partkey AS id, p_partkey AS ad_set_id, p_name AS headline, 'https://shop.example/' || CAST(p_partkey AS VARCHAR) AS destination_url FROM part WHERE p_partkey % 7 <> 0",
    "pacing": "SELECT l_shipdate AS event_time, l_suppkey % 20 AS campaign_id, 1.0::DOUBLE + l_tax AS previous_multiplier, 1.0::DOUBLE + l_discount AS new_multiplier, l_discount - l_tax AS error_normalized, l_tax AS p_term, l_discount AS i_term, l_quantity / 50.0::DOUBLE AS urgency, CAST(floor(l_extendedprice) AS BIGINT) AS spent_today_cents, CAST(floor(l_quantity * 1000) AS BIGINT) AS daily_budget_cents, CAST(floor(l_extendedprice * 50) AS BIGINT) AS remaining_budget_cents, CAST(floor(l_extendedprice * 200) AS BIGINT) AS total_budget_cents, CASE WHEN l_returnflag = 'R' THEN 'budget_exhausted' ELSE 'ok' END AS status, l_orderkey, l_linenumber, l_partkey FROM lineitem",
    "ad_keywords": "SELECT p_partkey AS ad_id, unnest(string_split(lower(p_name), ' ')) AS keyword, (p_partkey % 50 + 50) / 100.0::DOUBLE AS relevance_score FROM part",
    "ad_topics": "SELECT p_partkey AS ad_id, CAST(p_size % 30 AS VARCHAR) AS topic_id, CAST(p_partkey % 3 + 1 AS INTEGER) AS tier, 0.8::DOUBLE AS relevance_score FROM part",
    "ad_entities": "SELECT p_partkey AS ad_id, p_brand AS text, CASE WHEN p_partkey % 2 = 0 THEN 'BRAND' ELSE 'ORG' END AS type FROM part",
    "ad_countries": "SELECT p_partkey AS ad_id, CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' ELSE 'DE' END AS country FROM part WHERE p_partkey % 5 <> 0",
    "ad_devices": "SELECT p_partkey AS ad_id, CASE WHEN p_partkey % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS device FROM part WHERE p_partkey % 4 <> 0",
    "page_keywords": "SELECT p_partkey AS page_id, unnest(string_split(lower(p_name), ' ')) AS keyword, (p_partkey % 10 + 1) / 10.0::DOUBLE AS relevance_score FROM part",
    "page_topics": "SELECT p_partkey AS page_id, CAST(p_size % 30 + 100 AS VARCHAR) AS topic_id, CAST(p_partkey % 2 + 1 AS INTEGER) AS tier, 0.9::DOUBLE AS relevance_score FROM part",
    "page_entities": "SELECT p_partkey AS page_id, 'the ' || p_brand || ' store' AS text, 'BRAND' AS type FROM part",
    "topic_mapping": "SELECT CAST(i AS VARCHAR) AS product_id, CAST(i + 100 AS VARCHAR) AS content_id FROM range(30) t(i) WHERE i % 4 <> 0",
    "requests": "SELECT o_orderkey AS request_id, o_custkey AS page_id, CASE o_orderkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' ELSE 'FR' END AS country, CASE o_orderkey % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device FROM orders",
    "ad_vectors": "SELECT vec_id AS ad_id, embedding, label FROM embeddings WHERE vec_id % 2 = 0",
    "page_vectors": "SELECT vec_id AS page_id, embedding, label FROM embeddings WHERE vec_id % 2 = 1",
}


def with_tables(query: str, *names: str, **more: str) -> str:
    """A query preceded by the named logical tables and further named queries."""
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in [*((n, SQL[n]) for n in names), *more.items()]) + " " + query
