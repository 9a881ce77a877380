"""The registered queries over page contexts, annotations, caches, requests and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspectra import schemas
from adspectra.functions import scores, text, vectors
from adspectra.operators import auction, evaluation, merge, pacing, similarity, targeting, taxonomy, textprep
from adspectra.plans.features import RANKING, TREE, tree
from adspectra.plans.matching import PI_SQL, STATE_SQL, pi_rows
from adspectra.registry import query, rounded
from adspectra.sources.driver import Tables, with_tables

# -- page contexts


@query(
    with_tables(
        "SELECT r.request_id, c.page_id IS NOT NULL AS cached, CASE WHEN c.page_id IS NOT NULL THEN c.l ELSE r.own END AS keywords FROM (SELECT *, CASE WHEN request_id % 3 = 0 THEN '' ELSE 'k' || request_id % 5 || ':1.0' END AS own FROM requests) r LEFT JOIN (SELECT page_id, string_agg(keyword || ':' || CAST(relevance_score AS VARCHAR), ',' ORDER BY keyword, relevance_score) AS l FROM page_keywords WHERE page_id % 2 = 0 GROUP BY 1) c ON c.page_id = r.page_id",
        "requests",
        "page_keywords",
    )
)
def page_context_or_default(t: Tables) -> DataFrame:
    """Every second page is known; of the others' requests a third bring no keywords."""
    even = lambda df: df.where("page_id % 2 = 0")
    contexts = targeting.page_context(even(t.page_keywords), even(t.page_topics), even(t.page_entities))
    own = F.when(F.col("request_id") % 3 > 0, F.array(F.concat(F.lit("k"), (F.col("request_id") % 5).cast("string"))))
    found = targeting.context_or_default(t.requests.withColumn("request_keywords", own), contexts)
    shown = F.transform("keywords", lambda k: F.concat_ws(":", k["keyword"], k["relevance_score"].cast("string")))
    return found.select("request_id", "cached", F.array_join(shown, ",").alias("keywords"))


@query(with_tables("SELECT page_id, keyword FROM page_keywords WHERE page_id % 3 > 0 UNION ALL SELECT page_id, 'fresh-' || keyword FROM page_keywords WHERE page_id % 3 = 0 AND page_id % 2 = 0 UNION ALL SELECT page_id, keyword FROM page_keywords WHERE page_id % 6 = 3", "page_keywords"))
def page_children_replaced(t: Tables) -> DataFrame:
    """The keywords of every sixth page are replaced; pages without fresh rows keep theirs."""
    rows = t.page_keywords.select("page_id", "keyword")
    return merge.replace_children(rows, rows.where("page_id % 6 = 0").withColumn("keyword", F.concat(F.lit("fresh-"), "keyword")), "page_id")


@query(with_tables("SELECT id, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'ACTIVE' WHEN id % 4 = 0 THEN 'PENDING_ANALYSIS' ELSE 'PAUSED' END AS status FROM ads", "ads"))
def ad_activation(t: Tables) -> DataFrame:
    ads = t.ads.select("id", F.when(F.col("id") % 4 == 0, "PENDING_ANALYSIS").otherwise("PAUSED").alias("status"))
    return merge.activated(ads, t.ads.where("id % 3 = 0").select(F.col("id").alias("ad_id")))


@query("SELECT 'page:' || page_id AS key, CAST(page_id AS VARCHAR) AS id FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'page:' || page_id || ':chunk', NULL FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT 'ad:' || page_id, NULL FROM pages WHERE page_id % 3 = 2")
def cache_key_scan(t: Tables) -> DataFrame:
    p = F.col("page_id")
    key = F.when(p % 3 == 0, F.concat(F.lit("page:"), p)).when(p % 3 == 1, F.concat(F.lit("page:"), p, F.lit(":chunk"))).otherwise(F.concat(F.lit("ad:"), p))
    return t.raw("pages").select(key.alias("key")).withColumn("id", merge.cache_keys(F.col("key"), "page"))


@query(with_tables("SELECT page_id, topic_id, arg_min(tier, p) AS tier FROM (SELECT page_id, topic_id, tier, 0 AS p FROM page_topics UNION ALL SELECT page_id, topic_id, tier + 10, 1 FROM page_topics WHERE page_id % 2 = 0) GROUP BY 1, 2", "page_topics"))
def first_topics(t: Tables) -> DataFrame:
    again = t.page_topics.where("page_id % 2 = 0").withColumn("tier", F.col("tier") + 10).withColumn("pos", F.lit(1))
    return taxonomy.first_wins(t.page_topics.withColumn("pos", F.lit(0)).unionByName(again), "page_id").drop("relevance_score")


@query(f"SELECT id, name FROM ({TREE}) WHERE parent_id = 'r1' AND tier = 2")
def taxonomy_children(t: Tables) -> DataFrame:
    return taxonomy.children(tree(t), "r1", tier=2).select("id", "name")


# -- evaluation

TRUTH_SQL = "SELECT p.p_partkey AS page_id, a.p_partkey AS ad_id FROM x p JOIN x a ON a.p_brand = p.p_brand AND p.p_partkey % 2 = 0 AND a.p_partkey % 2 = 1 WHERE len(list_intersect(p.k, a.k)) >= 2 OR p.t = a.t UNION SELECT 2 * (vec_id // 2), 2 * (vec_id // 2) + 1 FROM embeddings WHERE vec_id % 10 = 0"


@query(f"WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS k, p_size % 30 AS t, p_brand FROM part) {TRUTH_SQL}")
def hybrid_ground_truth(t: Tables) -> DataFrame:
    x = t.raw("part").select("p_partkey", F.split(F.upper("p_name"), " ").alias("keywords"), F.array(F.col("p_size") % 30).alias("topics"), F.col("p_brand").alias("category"))
    v = F.col("vec_id")
    near = t.raw("embeddings").where(v % 10 == 0).select(v.alias("page_id"), (v + 1).alias("ad_id"))
    return evaluation.hybrid_truth(x.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "page_id"), x.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "ad_id"), near, 2)


@query(with_tables("SELECT p.page_id, a.ad_id, CASE WHEN p.page_id % 3 = 0 THEN p.page_id % 2 = 0 ELSE p.label = a.label END AS relevant FROM page_vectors p JOIN ad_vectors a ON a.ad_id = p.page_id - 1 UNION ALL SELECT page_id + 1000000, 0, true FROM page_vectors WHERE page_id % 5 = 0", "page_vectors", "ad_vectors"))
def annotation_override(t: Tables) -> DataFrame:
    p = t.page_vectors.select("page_id", (F.col("page_id") - 1).alias("ad_id"), "label")
    automatic = p.join(t.ad_vectors.select("ad_id", F.col("label").alias("other")), "ad_id").select("page_id", "ad_id", (F.col("label") == F.col("other")).alias("relevant"))
    more = t.page_vectors.where("page_id % 5 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), F.lit(0).cast("bigint").alias("ad_id"), F.lit(True).alias("relevant"))
    return evaluation.overridden(automatic, p.where("page_id % 3 = 0").select("page_id", "ad_id", (F.col("page_id") % 2 == 0).alias("relevant")).union(more))


@query(with_tables("SELECT label, count(*) AS queries, round(avg(h / 5.0::DOUBLE), 6) AS precision, round(avg(least(n, 5) / 5.0::DOUBLE), 6) AS ceiling FROM (SELECT page_id, sum(CASE WHEN rel THEN 1 ELSE 0 END) AS n, sum(CASE WHEN rel AND rank <= 5 THEN 1 ELSE 0 END) AS h FROM r GROUP BY 1) JOIN page_vectors USING (page_id) WHERE n > 0 GROUP BY 1", "page_vectors", "ad_vectors", r=RANKING))
def ranking_macro_average(t: Tables) -> DataFrame:
    ranked = similarity.knn(t.page_vectors, t.ad_vectors, "page_id", "ad_id", 5)
    each = evaluation.labelled_metrics(ranked, t.page_vectors.select("page_id", "label"), t.ad_vectors.select("ad_id", "label"), "page_id", "ad_id", 5).drop("ndcg").where("ceiling is not null")
    return rounded(evaluation.macro_average(each.join(t.page_vectors.select("page_id", "label"), "page_id").drop("page_id"), "label"))


@query(with_tables("SELECT publisher, count(*) FILTER (WHERE k = 'i') AS impression, count(*) FILTER (WHERE k = 'c') AS click, round(count(*) FILTER (WHERE k = 'c')::DOUBLE / nullif(count(*) FILTER (WHERE k = 'i'), 0), 6) AS ctr FROM (SELECT publisher_id AS publisher, 'i' AS k FROM impressions UNION ALL SELECT publisher_id, 'c' FROM clicks) GROUP BY 1", "impressions", "clicks"))
def funnel_by_publisher(t: Tables) -> DataFrame:
    rows = t.impressions.select(F.col("publisher_id").alias("publisher"), F.lit("impression").alias("stage")).union(t.clicks.select("publisher_id", F.lit("click")))
    return rounded(evaluation.funnel(rows, "publisher").select("publisher", "impression", "click", "ctr"))


@query(with_tables("SELECT campaign_id, day, round(sum(c) OVER w - 100.0::DOUBLE * row_number() OVER w, 6) AS cumulative_error FROM (SELECT campaign_id, CAST(event_time AS DATE) AS day, sum(price_cents)::DOUBLE AS c FROM impressions GROUP BY 1, 2) WINDOW w AS (PARTITION BY campaign_id ORDER BY day)", "impressions"))
def cumulative_pacing_error(t: Tables) -> DataFrame:
    """What each campaign has spent by day, less an ideal line of a hundred cents a day."""
    daily = t.impressions.groupBy("campaign_id", F.to_date("event_time").alias("day")).agg(F.sum("price_cents").alias("spend_cents"))
    return rounded(evaluation.cumulative_error(daily, F.lit(100.0), "campaign_id", "day", "spend_cents").select("campaign_id", "day", "cumulative_error"))


# -- serving and requests


@query(with_tables("SELECT a.id, CASE WHEN s.pricing_model <> 'CPM' AND a.id % 5 > 0 THEN a.destination_url END AS click_url FROM ads a JOIN ad_sets s ON s.id = a.ad_set_id", "ads", "ad_sets"))
def click_urls(t: Tables) -> DataFrame:
    url = F.when(F.col("id") % 5 > 0, F.col("destination_url")).otherwise("")
    served = t.ads.withColumn("destination_url", url).join(t.ad_sets.select(F.col("id").alias("ad_set_id"), "pricing_model"), "ad_set_id")
    return auction.click_url(served).select("id", "click_url")


@query("""SELECT c_custkey, coalesce(nullif(upper(s), ''), 'ACTIVE') AS status, upper(m) AS pricing_model, CASE WHEN c_custkey % 2 = 0 THEN 'set' ELSE c_name || ' - Default Ad Set' END AS ad_set_name, CASE WHEN c_custkey % 3 = 0 THEN 'native' ELSE 'banner' END AS creative_type, CAST(trunc(c_custkey * 1.25::DOUBLE * 100) AS BIGINT) AS budget_cents
FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'paused' WHEN 'MACHINERY' THEN 'Archived' ELSE '' END AS s, CASE WHEN c_custkey % 2 = 0 THEN 'cpc' ELSE 'Cpm' END AS m FROM customer)""")
def campaign_normalization(t: Tables) -> DataFrame:
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    rows = t.raw("customer").select(
        k, F.col("c_name").alias("name"), F.when(segment == "BUILDING", "paused").when(segment == "MACHINERY", "Archived").otherwise("").alias("status"), F.when(k % 2 == 0, "cpc").otherwise("Cpm").alias("pricing_model"),
        F.when(k % 2 == 0, "set").alias("ad_set_name"), F.when(k % 3 == 0, "native").alias("creative_type"), (k * 1.25).alias("budget"), F.lit(0.5).alias("bid_amount"), F.lit(None).cast("double").alias("daily_budget"),
    )
    return schemas.normalized_campaigns(rows).select("c_custkey", "status", "pricing_model", "ad_set_name", "creative_type", "budget_cents")


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_tax * 30 - 0.5)), 6) AS relevance FROM lineitem")
def relevance_clamp(t: Tables) -> DataFrame:
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", scores.clamped(F.col("l_tax") * 30 - 0.5).alias("relevance")))


@query(with_tables(f"SELECT id, status FROM ({PI_SQL}) WHERE status IN ('ok', 'budget_exhausted')", "ad_sets", st=STATE_SQL))
def published_steps(t: Tables) -> DataFrame:
    return pacing.published(pacing.pi_step(pi_rows(t))).select("id", "status")


@query("SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 6) || '...' ELSE p_name END AS short, upper(p_name[1]) || substr(string_split(p_name, ' ')[1], 2) || ' ' || upper(string_split(p_name, ' ')[2][1]) || substr(string_split(p_name, ' ')[2], 2) AS title FROM part")
def labels_shown(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", text.shortened(F.col("p_name"), 9).alias("short"), text.titled(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


# -- text and vectors


@query(with_tables("SELECT doc, pos, CAST(coalesce(sum(b) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM (SELECT *, CASE WHEN count(s) OVER v < 2 THEN 1 WHEN s < avg(s) OVER v - 0.5 * stddev_pop(s) OVER v THEN 1 ELSE 0 END AS b FROM u WINDOW v AS (PARTITION BY doc))", u="SELECT vec_id % 20 AS doc, vec_id AS pos, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS DOUBLE[])) AS s FROM embeddings"))
def semantic_chunks(t: Tables) -> DataFrame:
    """Texts are vectors of one remainder in order of their ids; a chunk ends where two neighbours are unlike."""
    units = t.raw("embeddings").select((F.col("vec_id") % 20).alias("doc"), F.col("vec_id").alias("pos"), "embedding")
    return textprep.semantic_breaks(textprep.adjacent_similarity(units, "doc"), "doc").select("doc", "pos", "chunk")


@query("SELECT vec_id, len(embedding)::BIGINT AS size, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def vector_codec(t: Tables) -> DataFrame:
    """Vectors written as text and read again."""
    back = vectors.from_text(vectors.to_text(F.col("embedding")))
    rows = t.raw("embeddings").select("vec_id", back.alias("v"))
    return rows.select("vec_id", F.size("v").cast("bigint").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query(with_tables("SELECT page_id, label, rank FROM (SELECT page_id, label, row_number() OVER (PARTITION BY page_id ORDER BY s DESC, label) AS rank FROM (SELECT p.page_id, a.label, max(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) AS s FROM page_vectors p, ad_vectors a GROUP BY 1, 2)) WHERE rank <= 3", "page_vectors", "ad_vectors"))
def label_shortlist(t: Tables) -> DataFrame:
    """Each page's three labels of the most similar ads."""
    best = similarity.best_by_label(t.page_vectors, t.ad_vectors, "page_id", "ad_id").withColumnRenamed("similarity", "s")
    order = Window.partitionBy("page_id").orderBy(F.desc("s"), "label")
    return best.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("page_id", "label", "rank")


STOPS = ", ".join(f"'{w}'" for w in textprep.STOP_WORDS)


@query(
    rf"""WITH w AS (SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ({STOPS})) AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS keyword FROM w),
    c AS (SELECT doc_id, keyword, count(*) * (CASE WHEN contains(keyword, ' ') THEN 3 ELSE 2 END) AS weight FROM g GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, keyword) AS rank, max(weight) OVER (PARTITION BY doc_id) AS best FROM c)
    SELECT doc_id, keyword, round(weight::DOUBLE / best, 6) AS relevance_score, rank FROM r WHERE rank <= 20 AND weight::DOUBLE / best >= 0.1"""
)
def keyword_extraction(t: Tables) -> DataFrame:
    return rounded(textprep.keywords(t.raw("documents"), "doc_id", "text", 20, 0.1))


@query("SELECT p_partkey, lower(p_brand) AS text, 'BRAND' AS type FROM part")
def entity_extraction(t: Tables) -> DataFrame:
    names = t.raw("part").select(F.col("p_brand").alias("text"), F.lit("BRAND").alias("type")).distinct()
    texts = t.raw("part").select("p_partkey", F.concat("p_name", F.lit(" by "), "p_brand", F.lit("'s, new")).alias("text"))
    return textprep.entities(texts, "p_partkey", "text", names)
