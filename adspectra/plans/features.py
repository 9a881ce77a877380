"""The registered queries over messages, text, taxonomies, evaluation and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspectra import schemas
from adspectra.functions import web
from adspectra.functions.scores import ecpm
from adspectra.functions.timeutil import day_key
from adspectra.operators import evaluation, merge, pacing, parse, similarity, taxonomy, textprep
from adspectra.registry import query, rounded
from adspectra.sources.driver import Tables, with_tables
from adspectra.streaming import jobs

SECRET = "a-test-secret"


def messages(t: Tables) -> DataFrame:
    """Ad event messages; every 17th is damaged, every 19th has an id that is no number, and every 13th has numbers as text."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "IMPRESSION").when(F.col("event_type") == "click", "click").otherwise(F.col("event_type"))
    number = lambda c: F.when(e % 13 == 0, F.concat(F.lit('"'), c.cast("string"), F.lit('"'))).otherwise(c.cast("string"))
    campaign = F.when(e % 3 == 0, 0).otherwise(F.col("user_id") % 20)
    good = F.concat(F.lit('{"event_type":"'), kind, F.lit('","ad_id":'), number(F.col("user_id")), F.lit(',"campaign_id":'), F.when(e % 19 == 0, F.lit('"none"')).otherwise(number(campaign)), F.lit(',"price_cents":'), F.floor(F.col("value") * 100).cast("string"), F.lit(',"timestamp":'), F.unix_timestamp("ts").cast("string"), F.lit(',"nonce":"'), (e % 500).cast("string"), F.lit('"}'))
    return t.raw("events").select(e.alias("event_id"), F.when(e % 17 == 0, F.lit('{"event_type": "click", ')).otherwise(good).alias("value"), F.lit("2024-06-01").cast("timestamp_ntz").alias("ingest_ts"))


PARSED = "SELECT event_id, CASE event_type WHEN 'view' THEN 'impression' ELSE 'click' END AS event_type, date_trunc('second', ts) AS event_time, user_id AS ad_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 20 END AS campaign_id, CAST(floor(value * 100) AS BIGINT) AS price_cents FROM events WHERE event_type IN ('view', 'click') AND event_id % 17 <> 0 AND event_id % 19 <> 0"


@query(PARSED)
def parse_ad_events(t: Tables) -> DataFrame:
    return parse.ad_events(messages(t)).select("event_id", "event_type", "event_time", "ad_id", "campaign_id", "price_cents")


@query("SELECT event_id FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0")
def dead_letters(t: Tables) -> DataFrame:
    return parse.dead_letters(messages(t)).select("event_id")


NONCES = f"SELECT event_type, CAST(event_id % 500 AS VARCHAR) AS nonce, event_time, min(event_id) AS event_id FROM ({PARSED}) GROUP BY 1, 2, 3"


@query(
    f"""WITH RECURSIVE x AS ({NONCES}), n AS (SELECT *, min(event_time) OVER (PARTITION BY event_type, nonce ORDER BY event_time RANGE BETWEEN INTERVAL 24 HOURS FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM x),
    held AS (SELECT event_type, nonce, min(event_time) AS event_time FROM x GROUP BY 1, 2 UNION ALL SELECT h.event_type, h.nonce, n.following FROM held h JOIN n ON n.event_type = h.event_type AND n.nonce = h.nonce AND n.event_time = h.event_time WHERE n.following IS NOT NULL)
    SELECT event_type, nonce, event_time, event_id FROM held JOIN x USING (event_type, nonce, event_time)"""
)
def event_dedupe(t: Tables) -> DataFrame:
    rows = messages(t).withColumn("nonce", F.get_json_object("value", "$.nonce"))
    return jobs.deduplicated(parse.ad_events(rows).select("event_type", "nonce", "event_time", "event_id"))


@query(f"SELECT time_bucket(INTERVAL '10 seconds', event_time) AS window_start, ad_id, count(*) FILTER (WHERE event_type = 'impression') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, CAST(sum(price_cents) AS BIGINT) AS spend_cents, coalesce(arg_min(campaign_id, event_time) FILTER (WHERE campaign_id <> 0), 0) AS campaign_id FROM ({PARSED}) GROUP BY 1, 2")
def window_ad_metrics(t: Tables) -> DataFrame:
    return jobs.ad_metrics(parse.ad_events(messages(t))).drop("window_end")


@query(f"SELECT time_bucket(INTERVAL '10 seconds', event_time) AS window_start, campaign_id, count(*) FILTER (WHERE event_type = 'impression') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, CAST(sum(price_cents) AS BIGINT) AS spend_cents FROM ({PARSED}) GROUP BY 1, 2")
def window_campaign_metrics(t: Tables) -> DataFrame:
    return jobs.campaign_metrics(parse.ad_events(messages(t))).drop("window_end")


@query(f"SELECT campaign_id, CAST(event_time AS DATE) AS day, count(*) FILTER (WHERE event_type = 'impression') AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks, CAST(sum(price_cents) AS BIGINT) AS spend_cents FROM ({PARSED}) GROUP BY 1, 2")
def spend_counters(t: Tables) -> DataFrame:
    return jobs.counters(parse.ad_events(messages(t)))


@query("SELECT event_id, CASE WHEN w THEN user_id END AS winner_ad_id, CASE WHEN w THEN user_id % 20 END AS winner_campaign_id, CASE WHEN w THEN CAST(trunc((event_id % 1000) / 8.0::DOUBLE * 100) AS BIGINT) END AS winning_bid_cents, event_id % 40 AS num_candidates, 0::BIGINT AS num_eligible FROM (SELECT *, event_id % 3 > 0 AS w FROM events)")
def parse_auction_events(t: Tables) -> DataFrame:
    e = F.col("event_id")
    winner = F.when(e % 3 > 0, F.struct(F.col("user_id").alias("ad_id"), (F.col("user_id") % 20).alias("campaign_id"), (e % 1000 / F.lit(8.0)).alias("effective_bid")))
    rows = t.raw("events").select(e, F.to_json(F.struct(e.cast("string").alias("auction_id"), (e % 40).alias("num_of_candidates"), winner.alias("winner"), F.lit("2024-01-01T00:00:00").alias("timestamp"))).alias("value"), F.lit("2024-06-01").cast("timestamp_ntz").alias("ingest_ts"))
    return parse.auction_events(rows).select("event_id", "winner_ad_id", "winner_campaign_id", "winning_bid_cents", "num_candidates", "num_eligible")


@query("SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS campaign_id, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS total_budget_cents, 0::BIGINT AS effective_target_cents, 1 + l_discount AS new_multiplier, 'ok' AS status FROM lineitem")
def parse_pacing_events(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct((F.col("l_suppkey") % 20).cast("string").alias("campaign_id"), F.col("l_extendedprice").alias("total_budget"), (1 + F.col("l_discount")).alias("new_multiplier"), F.lit("ok").alias("status"), F.lit("1995-01-01T00:00:00+00:00").alias("timestamp"))).alias("value"), F.lit("2024-06-01").cast("timestamp_ntz").alias("ingest_ts"))
    return parse.pacing_events(rows).select("l_orderkey", "l_linenumber", "campaign_id", "total_budget_cents", "effective_target_cents", "new_multiplier", "status")


@query(
    r"""SELECT page_id, u AS canonical, sha256(u) AS url_hash FROM (SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(.*)$', 1)) || '://' || lower(regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(.*)$', 2)) || rtrim(regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(.*)$', 3), '/') || regexp_extract(url, '^([a-z]+)://([^/?#]*)([^?#]*)(.*)$', 4) AS u FROM pages)"""
)
def url_hash(t: Tables) -> DataFrame:
    repeated = F.concat(F.when(F.col("url").startswith("https://"), "https://").otherwise("http://"), F.col("url"))
    return t.raw("pages").select("page_id", web.canonical_url(repeated).alias("canonical"), web.url_hash(F.col("url")).alias("url_hash"))


@query("SELECT event_id, event_id % 3 <> 1 AND event_id % 7 <> 0 AS verified FROM events")
def signature_check(t: Tables) -> DataFrame:
    e = F.col("event_id")
    params = F.create_map(F.lit("ts"), (e * 1000).cast("string"), F.lit("ad_id"), F.col("user_id").cast("string"), F.lit("dest"), F.concat(F.lit("https://x.example/?a="), e.cast("string")))
    signed = F.map_concat(params, F.create_map(F.lit("sig"), web.hmac_sha256(web.query_payload(params), SECRET)))
    sent = F.when(e % 3 == 1, F.map_concat(F.map_filter(signed, lambda k, v: k != "ad_id"), F.create_map(F.lit("ad_id"), F.lit("999999")))).otherwise(signed)
    # Every seventh comes two hours late, every eleventh from a clock an hour ahead, which passes.
    now = e * 1000 + F.when(e % 7 == 0, 7_200_000).when(e % 11 == 0, -3_600_000).otherwise(5000)
    return t.raw("events").select("event_id", web.verified(sent, SECRET, now).alias("verified"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || event_id % 200 WHEN event_id % 4 = 1 THEN '192.168.1.1' ELSE '172.16.0.9' END AS ip, CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device, CASE WHEN event_id % 2 = 0 THEN 'Android' ELSE 'Windows' END AS os, CASE WHEN event_id % 5 = 0 THEN 'en' ELSE 'de' END AS language FROM events")
def request_context(t: Tables) -> DataFrame:
    e = F.col("event_id")
    forwarded = F.when(e % 4 == 0, F.concat(F.lit("10.0.0."), (e % 200).cast("string"), F.lit(", 1.1.1.1"))).when(e % 4 == 2, F.lit("unknown"))
    real = F.when(e % 4 == 1, F.lit("192.168.1.1"))
    agent = F.when(e % 2 == 0, "Mozilla/5.0 (Linux; Android 14) Mobile").otherwise("Mozilla/5.0 (Windows NT 10.0)")
    return t.raw("events").select("event_id", web.client_ip(forwarded, real, F.lit("172.16.0.9:4411")).alias("ip"), web.device(agent).alias("device"), web.os_family(agent).alias("os"), web.language(F.when(e % 5 > 0, F.lit("de-DE,en;q=0.5"))).alias("language"))


@query(with_tables("SELECT id, round(CASE pricing_model WHEN 'CPC' THEN bid_amount_cents / 100.0::DOUBLE * 50 ELSE bid_amount_cents / 100.0::DOUBLE END, 6) AS ecpm FROM ad_sets", "ad_sets"), name="ecpm")
def ecpm_query(t: Tables) -> DataFrame:
    return rounded(t.ad_sets.select("id", ecpm(F.col("pricing_model"), F.col("bid_amount_cents") / F.lit(100.0)).alias("ecpm")))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1")
def day_counts(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(day_key("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))


def tree(t: Tables) -> DataFrame:
    """Regions, nations of a region, and customers of a nation as a taxonomy of three tiers."""
    one = t.raw("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), F.lit(1).alias("tier"))
    two = t.raw("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), F.col("n_name"), F.lit(2))
    three = t.raw("customer").select(F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey")), F.col("c_name"), F.lit(3))
    return one.union(two).union(three)


TREE = "SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, 1 AS tier FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 3 FROM customer"


@query(f"WITH RECURSIVE tree AS ({TREE}), p AS (SELECT id, parent_id, name, tier, name AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.parent_id, t.name, t.tier, p.path || '/' || t.name FROM tree t JOIN p ON p.id = t.parent_id) SELECT * FROM p")
def taxonomy_flatten(t: Tables) -> DataFrame:
    return taxonomy.with_paths(tree(t)).withColumn("path", F.array_join("path", "/"))


#: The walk over scores ``s``: two roots and two children of at least 0.3, the five best leaves.
WALK = """a AS (SELECT k, id AS leaf, score AS cum FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS r FROM s WHERE tier = 1) WHERE r <= 2 AND score >= 0.3),
    c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, parent_id ORDER BY score DESC, id) AS r FROM s WHERE tier = 2) WHERE r <= 2 AND score >= 0.3),
    c3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, parent_id ORDER BY score DESC, id) AS r FROM s WHERE tier = 3) WHERE r <= 2 AND score >= 0.3),
    b AS (SELECT a.k, coalesce(c2.id, a.leaf) AS leaf, a.cum * coalesce(c2.score, 1) AS cum FROM a LEFT JOIN c2 ON c2.k = a.k AND c2.parent_id = a.leaf),
    d AS (SELECT b.k, coalesce(c3.id, b.leaf) AS leaf, b.cum * coalesce(c3.score, 1) AS cum FROM b LEFT JOIN c3 ON c3.k = b.k AND c3.parent_id = b.leaf)
    SELECT k, leaf AS leaf_id, round(max(cum), 6) AS score, row_number() OVER (PARTITION BY k ORDER BY max(cum) DESC, leaf) AS rank FROM d GROUP BY 1, 2 QUALIFY rank <= 5"""
SCORE = "((CAST(substr(id, 2) AS BIGINT) * 37 + k * 101 + tier * 13) % 97 + 3) / 100.0::DOUBLE"


@query(
    f"""WITH tree AS ({TREE}), s AS (SELECT k, id, parent_id, tier, {SCORE} AS score FROM tree, range(20) r(k)),
    {WALK}"""
)
def taxonomy_walk(t: Tables) -> DataFrame:
    texts = t.spark.range(20).withColumnRenamed("id", "k")
    score = ((F.substring("id", 2, 9).cast("bigint") * 37 + F.col("k") * 101 + F.col("tier") * 13) % 97 + 3) / F.lit(100.0)
    scored = tree(t).crossJoin(F.broadcast(texts)).withColumn("score", score)  # of 20 rows
    return rounded(taxonomy.walk(scored, "k", 0.3, tiers=3).drop("path"))


#: Sizes stand for product topics (one of them for 0, which is no topic) and brand numbers for content topics.
MAPPED = "SELECT CAST(p_size - 1 AS VARCHAR) AS product_id, regexp_extract(p_brand, '([0-9]+)', 1) AS content_id, p_partkey FROM part"


@query(f"SELECT DISTINCT product_id, content_id FROM ({MAPPED}) WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0) AND TRY_CAST(product_id AS INTEGER) > 0 AND TRY_CAST(content_id AS INTEGER) > 0")
def taxonomy_mapping(t: Tables) -> DataFrame:
    """Even parts map products to content; every third maps content to products."""
    pairs = t.raw("part").select("p_partkey", (F.col("p_size") - 1).cast("string").alias("product_id"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("content_id"))
    return taxonomy.numeric_ids(taxonomy.merged_mapping(pairs.where("p_partkey % 2 = 0"), pairs.where("p_partkey % 3 = 0")))


COSINE = "list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"
RANKING = f"SELECT p.page_id, a.ad_id, p.label = a.label AS rel, {COSINE} AS s, row_number() OVER (PARTITION BY p.page_id ORDER BY s DESC, a.ad_id) AS rank FROM page_vectors p, ad_vectors a"


@query(with_tables("SELECT page_id, round(sum(CASE WHEN rel THEN 1 ELSE 0 END) FILTER (WHERE rank <= 5) / 5.0::DOUBLE, 6) AS precision, round(coalesce(sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) FILTER (WHERE rank <= 5) / nullif(list_sum(list_transform(range(1, least(5, sum(CASE WHEN rel THEN 1 ELSE 0 END))::BIGINT + 1), lambda i: 1 / log2(i + 1))), 0), 0), 6) AS ndcg FROM r GROUP BY 1", "page_vectors", "ad_vectors", r=RANKING))
def precision_ndcg(t: Tables) -> DataFrame:
    ranked = similarity.knn(t.page_vectors, t.ad_vectors, "page_id", "ad_id", 5)
    return rounded(evaluation.labelled_metrics(ranked, t.page_vectors.select("page_id", "label"), t.ad_vectors.select("ad_id", "label"), "page_id", "ad_id", 5).drop("ceiling"))


@query(with_tables("SELECT page_id, round(coalesce(avg(s) FILTER (WHERE rel), 0), 6) AS relevant_quality, round(coalesce(avg(s) FILTER (WHERE NOT rel), 0), 6) AS other_quality, round(coalesce(avg(s) FILTER (WHERE rel), 0) - coalesce(avg(s) FILTER (WHERE NOT rel), 0), 6) AS gap FROM r WHERE rank <= 50 GROUP BY 1", "page_vectors", "ad_vectors", r=RANKING))
def quality_gap(t: Tables) -> DataFrame:
    near = similarity.knn(t.page_vectors, t.ad_vectors, "page_id", "ad_id", 50).withColumnRenamed("similarity", "quality")
    labelled = near.join(t.page_vectors.select("page_id", F.col("label").alias("p")), "page_id").join(t.ad_vectors.select("ad_id", F.col("label").alias("a")), "ad_id")
    return rounded(evaluation.quality_gap(labelled.withColumn("relevant", F.col("p") == F.col("a")), "page_id"))


@query(with_tables("SELECT round(avg(s) FILTER (WHERE rel), 6) AS intra, round(avg(s) FILTER (WHERE NOT rel), 6) AS inter, round(avg(s) FILTER (WHERE rel) - avg(s) FILTER (WHERE NOT rel), 6) AS separation FROM r", "page_vectors", "ad_vectors", r=RANKING))
def embedding_clustering(t: Tables) -> DataFrame:
    return rounded(evaluation.cluster_cohesion(t.page_vectors, t.ad_vectors))


KEYS = "SELECT p_partkey, string_split(p_name, ' ') AS k, p_brand FROM part"


@query(f"WITH x AS ({KEYS}) SELECT p.p_partkey AS page_id, a.p_partkey AS ad_id FROM x p JOIN x a ON a.p_brand = p.p_brand AND p.p_partkey % 2 = 0 AND a.p_partkey % 2 = 1 WHERE len(list_intersect(p.k, a.k)) >= 1")
def ground_truth(t: Tables) -> DataFrame:
    x = t.raw("part").select("p_partkey", F.split(F.upper("p_name"), " ").alias("keywords"), F.col("p_brand").alias("category"))
    return evaluation.ground_truth(x.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "page_id"), x.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "ad_id"), 1)


@query(with_tables("SELECT campaign_id, count(*) AS steps, round(stddev_pop(new_multiplier) / avg(new_multiplier), 6) AS multiplier_cv, round(avg(CASE WHEN new_multiplier BETWEEN 0.3 AND 1.7 THEN 1.0 ELSE 0 END), 6) AS mid_share, max(spent_today_cents) AS spend_cents, round(abs(max(spent_today_cents)::DOUBLE / 50000 - 1), 6) AS utilization_error, round(greatest(max(spent_today_cents)::DOUBLE / 50000 - 1, 0), 6) AS overspend_ratio, 50000 AS daily_budget_cents FROM pacing GROUP BY 1", "pacing"))
def pacing_quality(t: Tables) -> DataFrame:
    steps = t.pacing_history.select("campaign_id", F.col("new_multiplier").alias("multiplier"), F.col("spent_today_cents").alias("daily_spend_cents"))
    return rounded(evaluation.pacing_quality(steps, t.spark.range(20).select(F.col("id").alias("campaign_id"), F.lit(50000).alias("daily_budget_cents"))))


@query("WITH x AS (SELECT event_type, CAST(floor(value * 10) AS BIGINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY floor(value * 10)) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(v) FILTER (WHERE i = n * 50 // 100) AS p50, max(v) FILTER (WHERE i = n * 95 // 100) AS p95, max(v) FILTER (WHERE i = n * 99 // 100) AS p99, min(v) AS least, max(v) AS greatest, round(sum(v)::DOUBLE / max(n), 6) AS mean FROM x GROUP BY 1")
def latency_percentiles(t: Tables) -> DataFrame:
    rows = t.raw("events").select("event_type", F.floor(F.col("value") * 10).alias("v"))
    return rounded(evaluation.latency_percentiles(rows, "v", "event_type"))


@query("WITH b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS c FROM events, (SELECT unnest([1, 5, 10, 25, 50, 100, 1000]) AS le) GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low, coalesce(lag(c) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, max(c) OVER (PARTITION BY event_type) * 0.95::DOUBLE AS target FROM b) SELECT event_type, round(low + (le - low) * (target - below) / (c - below), 6) AS value FROM w WHERE c >= target QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1")
def histogram_quantile(t: Tables) -> DataFrame:
    bounds = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 1000.0]
    counts = t.raw("events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)))
    long = counts.select("event_type", F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("count")) for k, b in enumerate(bounds)))).alias("x")).select("event_type", "x.le", "x.count")
    return rounded(evaluation.histogram_quantile(long, 0.95, "event_type"))


@query("SELECT user_id, ts, round(v / nullif(ts - lag(ts) OVER w, 0), 6) AS rate FROM (SELECT user_id, event_id * 10 AS ts, CASE WHEN lag(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id) <= event_id % 100 THEN event_id % 100 - lag(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id) ELSE event_id % 100 END::DOUBLE AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def counter_rate(t: Tables) -> DataFrame:
    rows = t.raw("events").select("user_id", (F.col("event_id") * 10).alias("ts"), (F.col("event_id") % 100).alias("value"))
    return rounded(evaluation.counter_rate(rows, "user_id"))


@query("WITH x AS (SELECT CASE user_id % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' ELSE 'FR' END AS country, event_type FROM events) SELECT country, count(*) FILTER (WHERE event_type = 'signup') AS request, count(*) FILTER (WHERE event_type = 'purchase') AS fill, count(*) FILTER (WHERE event_type = 'view') AS impression, count(*) FILTER (WHERE event_type = 'click') AS click, round(count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / count(*) FILTER (WHERE event_type = 'signup'), 6) AS fill_rate, round(count(*) FILTER (WHERE event_type = 'click')::DOUBLE / count(*) FILTER (WHERE event_type = 'view'), 6) AS ctr FROM x GROUP BY 1")
def funnel_by_country(t: Tables) -> DataFrame:
    k = F.col("user_id") % 4
    stage = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "purchase", "fill").when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "click")
    rows = t.raw("events").select(F.when(k == 0, "US").when(k == 1, "GB").when(k == 2, "DE").otherwise("FR").alias("country"), stage.alias("stage"))
    return rounded(evaluation.funnel(rows, "country"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label + 100 FROM embeddings WHERE vec_id % 7 = 0")
def upsert_embeddings(t: Tables) -> DataFrame:
    e = t.raw("embeddings").select("vec_id", "label")
    old = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 50).alias("label"), F.lit(1).alias("version"))
    new = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    more = e.where("vec_id % 7 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), (F.col("label") + 100).alias("label"), F.lit(1).alias("version"))
    return merge.upsert(e, merge.latest(old.union(new).union(more), ["vec_id"], ["version"]).drop("version"), ["vec_id"])


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN coalesce(CASE WHEN o_orderkey % 8 = 0 THEN 'changed' END, o_orderstatus) ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0")
def merge_and_delete(t: Tables) -> DataFrame:
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changes = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(None).cast("bigint").alias("o_custkey"), F.when(F.col("o_orderkey") % 8 == 0, "changed").alias("o_orderstatus"))
    return merge.delete(merge.merge_columns(o, changes, ["o_orderkey"]), o.where("o_orderkey % 5 = 0"), ["o_orderkey"])


@query(with_tables("SELECT label, actual, expected, CASE WHEN actual = expected THEN 'ok' ELSE 'mismatch' END AS status FROM (SELECT 'ads' AS label, (SELECT count(*) FROM ads) AS actual, (SELECT count(*) FROM ad_sets) AS expected UNION ALL SELECT 'vectors', (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0), (SELECT count(*) FROM ads))", "ads", "ad_sets"))
def reconciliation(t: Tables) -> DataFrame:
    return merge.reconcile([("ads", t.ads, t.ad_sets), ("vectors", t.ad_vectors, t.ads)])


@query(with_tables("SELECT s.id FROM ad_sets s WHERE s.id NOT IN (SELECT id FROM ads)", "ads", "ad_sets"))
def pending_work(t: Tables) -> DataFrame:
    return merge.pending(t.ad_sets, t.ads, ["id"]).select("id")


@query("WITH x AS (SELECT c_custkey, c_acctbal, c_mktsegment, c_custkey % 7 AS b FROM customer) SELECT c_custkey, unnest(list_filter([CASE WHEN c_mktsegment IN ('HOUSEHOLD') THEN 'status is unknown' END, CASE WHEN c_acctbal < 1 THEN 'total budget isn''t positive' END, CASE WHEN b = 0 THEN 'bid isn''t positive' END], lambda m: m IS NOT NULL)) AS problem FROM x")
def campaign_validation(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    rows = t.raw("customer").select("c_custkey", F.col("c_name").alias("name"), F.when(segment == "BUILDING", "active").when(segment == "MACHINERY", "archived").when(segment == "FURNITURE", "PENDING_ANALYSIS").when(segment == "AUTOMOBILE", "").otherwise("PENDING").alias("status"), F.col("c_acctbal").alias("total_budget"), F.lit(None).cast("double").alias("daily_budget_cents"), (F.col("c_custkey") % 7).alias("bid_amount_cents"), F.lit("cpc").alias("pricing_model"), F.lit(1).alias("start_date"), F.lit(None).cast("int").alias("end_date"))
    return rows.select("c_custkey", F.explode(schemas.campaign_problems()).alias("problem"))


@query(
    with_tables(
        """SELECT k.page_id, '{"keywords":{' || k.j || '},"topics":{"' || t.topic_id || '":' || CAST(t.relevance_score AS VARCHAR) || '},"entities":[{"text":"' || e.text || '","type":"' || e.type || '"}]}' AS document
        FROM (SELECT page_id, string_agg('"' || keyword || '":' || CAST(relevance_score AS VARCHAR), ',' ORDER BY keyword) AS j FROM (SELECT DISTINCT page_id, keyword, relevance_score FROM page_keywords) GROUP BY 1) k JOIN page_topics t ON t.page_id = k.page_id JOIN page_entities e ON e.page_id = k.page_id""",
        "page_keywords",
        "page_topics",
        "page_entities",
    )
)
def page_context_documents(t: Tables) -> DataFrame:
    return merge.page_documents(t.page_keywords.select("page_id").distinct(), t.page_keywords, t.page_topics, t.page_entities)


@query()
def html_to_text(t: Tables) -> DataFrame:
    return textprep.html_text(t.raw("pages"))


@query()
def document_chunks(t: Tables) -> DataFrame:
    return textprep.chunks(t.raw("documents"), "doc_id", "text")


#: A campaign's days as observations at noon, with what the step makes of them apart from its state.
OBSERVED = """SELECT campaign_id, event_time::DATE AS day, max(total_budget_cents) / 100.0::DOUBLE AS total_budget, max(daily_budget_cents) / 100.0::DOUBLE AS daily_budget,
min(remaining_budget_cents) / 100.0::DOUBLE AS left_over, max(spent_today_cents) / 30000.0::DOUBLE AS spent_today FROM pacing GROUP BY 1, 2"""
STEPS_SQL = f"""o1 AS (SELECT * REPLACE (total_budget - (total_budget - left_over) AS left_over), epoch(day::TIMESTAMP) + 43200.0 AS now, min(epoch(day::TIMESTAMP)) OVER w::DOUBLE AS st, max(epoch(day::TIMESTAMP)) OVER w + 86400.0::DOUBLE AS en, row_number() OVER (PARTITION BY campaign_id ORDER BY day) AS n
  FROM ({OBSERVED}) WINDOW w AS (PARTITION BY campaign_id)),
o2 AS (SELECT *, least(left_over / greatest(1.0, (en - now) / 3600.0) * 24, CASE WHEN daily_budget > 0 THEN daily_budget ELSE 1e300 END) * 0.5 AS target FROM o1),
o AS (SELECT *, CASE WHEN left_over <= 0 OR (daily_budget > 0 AND spent_today >= daily_budget) THEN 'budget_exhausted' WHEN target < 0.01 THEN 'target_too_low' ELSE 'ok' END AS status,
  greatest(-1.5, least(1.5, (target - spent_today) / target)) AS e, 0.3 * (1 + ((now - st) / (en - st)) * ((now - st) / (en - st))) + 0.7 * 1.25 AS u FROM o2),
s AS (SELECT campaign_id, 0::BIGINT AS n, 0.0::DOUBLE AS now, '' AS status, 0.0::DOUBLE AS error, 0.0::DOUBLE AS p_term, 0.0::DOUBLE AS i_term, 1.0::DOUBLE AS multiplier, 0.0::DOUBLE AS integral FROM o GROUP BY 1
  UNION ALL SELECT campaign_id, n, now, status, CASE status WHEN 'ok' THEN e WHEN 'budget_exhausted' THEN -1.0 ELSE 0.0 END, p, i,
  CASE status WHEN 'ok' THEN greatest(0.1, least(2.0, m + greatest(-0.04 * 1.9, least(0.08 * 1.9, greatest(-0.5, least(1.0, p + i)))))) WHEN 'budget_exhausted' THEN 0.0 ELSE m END, ni
  FROM (SELECT *, CASE WHEN status = 'ok' THEN 0.15 * e * u ELSE 0.0 END AS p, CASE WHEN status = 'ok' THEN 0.04 * ni * u ELSE 0.0 END AS i
    FROM (SELECT o.*, s.multiplier AS m, CASE WHEN o.status = 'ok' AND NOT (s.multiplier >= 2.0 AND o.e > 0 OR s.multiplier <= 0.1 AND o.e < 0) THEN greatest(-5.0, least(5.0, s.integral + o.e)) ELSE s.integral END AS ni
      FROM s JOIN o ON o.campaign_id = s.campaign_id AND o.n = s.n + 1)))"""
PI_SEQUENCE_SQL = with_tables("SELECT campaign_id, now, status, round(error, 6) AS error, round(p_term, 6) AS p_term, round(i_term, 6) AS i_term, round(multiplier, 6) AS multiplier, round(integral, 6) AS integral FROM s WHERE n > 0", "pacing").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT campaign_id, now, status, round", f", {STEPS_SQL} SELECT campaign_id, now, status, round", 1)


@query(PI_SEQUENCE_SQL)
def pi_sequence(t: Tables) -> DataFrame:
    """Each campaign's controller over its days, an observation at noon each."""
    cents = lambda f, x, by=100.0: (f(x) / by).alias(x.replace("_cents", ""))
    days = t.pacing_history.groupBy("campaign_id", F.to_date("event_time").alias("day")).agg(cents(F.max, "total_budget_cents"), cents(F.max, "daily_budget_cents"), cents(F.min, "remaining_budget_cents"), cents(F.max, "spent_today_cents", 30000.0))
    whole, second = Window.partitionBy("campaign_id"), F.unix_timestamp(F.col("day").cast("timestamp")).cast("double")
    seen = days.select("*", (second + 43200).alias("now"), F.min(second).over(whole).alias("start"), (F.max(second).over(whole) + 86400).alias("end"))
    return rounded(pacing.run_steps(seen.withColumn("spent", F.col("total_budget") - F.col("remaining_budget"))))
