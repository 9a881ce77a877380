"""The registered matching queries: candidates, scores, auctions, similarity, pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspectra.functions import scores
from adspectra.functions.timeutil import moment
from adspectra.functions.vectors import cosine
from adspectra.operators import auction, bitmaps, classes, pacing, similarity, targeting, vector_index
from adspectra.registry import query, rounded
from adspectra.sources.driver import Tables, with_tables

TARGETING = ("ad_keywords", "ad_topics", "ad_entities", "ad_countries", "ad_devices")
PAGES = ("page_keywords", "page_topics", "page_entities")


#: The moment at which ads are served.
AS_OF = "2024-01-15"
ACTIVE_SQL = f"SELECT a.id AS ad_id, a.ad_set_id, a.headline, s.campaign_id, s.pricing_model, s.bid_amount_cents FROM ads a JOIN ad_sets s ON s.id = a.ad_set_id JOIN campaigns c ON c.id = s.campaign_id WHERE c.status = 'ACTIVE' AND c.start_date < TIMESTAMP '{AS_OF}' AND (c.end_date IS NULL OR c.end_date > TIMESTAMP '{AS_OF}')"


def active(t: Tables) -> DataFrame:
    return targeting.active_ads(t.ads, t.ad_sets, t.campaigns, moment(AS_OF))


def index(t: Tables) -> DataFrame:
    return targeting.build_index(*(getattr(t, x) for x in TARGETING), active=active(t))


def page_keys(t: Tables) -> DataFrame:
    """Keys compare exactly: page topics are content ids, so only shared ids match."""
    one = lambda df, dim, key: df.select("page_id", F.lit(dim).alias("dim"), key.alias("key"))
    brand = F.regexp_extract("text", "^the (.*) store$", 1)
    return one(t.page_keywords, "keyword", F.col("keyword")).unionByName(one(t.page_topics, "topic", F.col("topic_id"))).unionByName(one(t.page_entities, "entity", brand))


INDEX_SQL = "SELECT dim, key, ad_id FROM (" + " UNION ".join(f"SELECT '{dim}' AS dim, {key} AS key, ad_id FROM {table}" for dim, key, table in (("keyword", "keyword", "ad_keywords"), ("topic", "topic_id", "ad_topics"), ("entity", "text", "ad_entities"), ("country", "country", "ad_countries"), ("device", "device", "ad_devices"))) + ") WHERE ad_id IN (SELECT ad_id FROM active)"
CANDIDATES_SQL = """SELECT DISTINCT r.request_id, i.ad_id FROM requests r JOIN page_keys p ON p.page_id = r.page_id JOIN idx i ON i.dim = p.dim AND i.key = p.key
WHERE (r.country NOT IN (SELECT key FROM idx WHERE dim = 'country') OR EXISTS (SELECT 1 FROM idx g WHERE g.dim = 'country' AND g.key = r.country AND g.ad_id = i.ad_id))
AND (r.device NOT IN (SELECT key FROM idx WHERE dim = 'device') OR EXISTS (SELECT 1 FROM idx g WHERE g.dim = 'device' AND g.key = r.device AND g.ad_id = i.ad_id))"""
PAGE_KEYS_SQL = "SELECT page_id, 'keyword' AS dim, keyword AS key FROM page_keywords UNION ALL SELECT page_id, 'topic', topic_id FROM page_topics UNION ALL SELECT page_id, 'entity', regexp_extract(text, '^the (.*) store$', 1) FROM page_entities"
MATCHES_SQL = "SELECT DISTINCT p.page_id, i.ad_id FROM page_keys p JOIN idx i ON i.dim = p.dim AND i.key = p.key"
ADS = ("ads", "ad_sets", "campaigns")
INDEXED = {"active": ACTIVE_SQL, "idx": INDEX_SQL}


@query(with_tables("SELECT dim, key, count(DISTINCT ad_id) AS ads FROM idx GROUP BY 1, 2", *TARGETING, *ADS, **INDEXED))
def index_sizes(t: Tables) -> DataFrame:
    return targeting.index_sizes(index(t))


@query(with_tables("SELECT * FROM cand", *TARGETING, *PAGES, *ADS, "requests", **INDEXED, page_keys=PAGE_KEYS_SQL, cand=CANDIDATES_SQL))
def candidate_match(t: Tables) -> DataFrame:
    return targeting.find_candidates(t.requests, page_keys(t), index(t), active(t))


@query(with_tables("SELECT * FROM cand", *TARGETING, *PAGES, *ADS, "requests", **INDEXED, page_keys=PAGE_KEYS_SQL, cand=CANDIDATES_SQL))
def candidate_match_bitmaps(t: Tables) -> DataFrame:
    """As ``candidate_match``, on bitmaps."""
    return bitmaps.candidates(t.requests, page_keys(t), bitmaps.pack(index(t)))


@query(with_tables("SELECT dim, key, ad_id FROM idx WHERE ad_id % 3 > 0 UNION ALL SELECT dim, 'new-' || key, ad_id FROM idx WHERE ad_id % 6 = 0", *TARGETING, *ADS, **INDEXED))
def index_refresh(t: Tables) -> DataFrame:
    """A third of the ads changed; of these half were indexed anew and half are no longer active."""
    whole = index(t)
    changed = active(t).where("ad_id % 3 = 0")
    fresh = whole.where("ad_id % 6 = 0").select("dim", F.concat(F.lit("new-"), "key").alias("key"), "ad_id")
    return targeting.refresh_index(whole, changed, fresh)


@query(with_tables("SELECT dim, key, ad_id FROM idx WHERE ad_id % 3 > 0 UNION ALL SELECT dim, 'new-' || key, ad_id FROM idx WHERE ad_id % 6 = 0", *TARGETING, *ADS, **INDEXED))
def index_refresh_bitmaps(t: Tables) -> DataFrame:
    """As ``index_refresh``, on bitmaps."""
    whole = index(t)
    fresh = whole.where("ad_id % 6 = 0").select("dim", F.concat(F.lit("new-"), "key").alias("key"), "ad_id")
    return bitmaps.unpack(bitmaps.refresh(bitmaps.pack(whole), active(t).where("ad_id % 3 = 0"), fresh))


@query(with_tables("SELECT * FROM active", *ADS, active=ACTIVE_SQL))
def active_ads_for_index(t: Tables) -> DataFrame:
    return active(t)


@query(with_tables("SELECT id, ad_set_id, headline, destination_url FROM a WHERE a.u > 3 OR ad_set_id IN (SELECT s.id FROM ad_sets s WHERE s.id % 13 > 11) OR ad_set_id IN (SELECT s.id FROM ad_sets s JOIN campaigns c ON c.id = s.campaign_id WHERE c.id % 6 > 4)", "ads", "ad_sets", "campaigns", a="SELECT *, id % 5 AS u FROM ads"))
def changed_ads_semi_join(t: Tables) -> DataFrame:
    stamp = lambda df, n, shift: df.withColumn("updated_at", (F.col("id") % n - shift).cast("int"))
    return targeting.changed_since(stamp(t.ads, 5, 3), stamp(t.ad_sets, 13, 11), stamp(t.campaigns, 6, 4), F.lit(0)).drop("updated_at")


@query(
    with_tables(
        """SELECT a.id, coalesce(k.n, 0) AS n_keywords, k.f AS first_keyword, coalesce(g.l, '') AS countries, coalesce(d.l, '') AS devices, o.topic_id, e.text AS entity FROM ads a
        LEFT JOIN (SELECT ad_id, count(*) AS n, min(keyword) AS f FROM ad_keywords GROUP BY 1) k ON k.ad_id = a.id LEFT JOIN (SELECT ad_id, string_agg(country, ',' ORDER BY country) AS l FROM ad_countries GROUP BY 1) g ON g.ad_id = a.id
        LEFT JOIN (SELECT ad_id, string_agg(device, ',' ORDER BY device) AS l FROM ad_devices GROUP BY 1) d ON d.ad_id = a.id LEFT JOIN ad_topics o ON o.ad_id = a.id LEFT JOIN ad_entities e ON e.ad_id = a.id""",
        "ads",
        *TARGETING,
    )
)
def targeting_nested(t: Tables) -> DataFrame:
    n = targeting.nested_ads(t.ads.withColumn("ad_id", F.col("id")), *(getattr(t, x) for x in TARGETING))
    return n.select("id", F.size("keywords").cast("bigint").alias("n_keywords"), F.col("keywords")[0]["keyword"].alias("first_keyword"), F.array_join("countries", ",").alias("countries"), F.array_join("devices", ",").alias("devices"), F.col("topics")[0]["topic_id"].alias("topic_id"), F.col("entities")[0]["text"].alias("entity"))


def grid(t: Tables, pairs: DataFrame) -> DataFrame:
    """Pairs of pages and active ads with both sides nested."""
    ads = targeting.nested_ads(active(t), t.ad_keywords, mapped_topics(t), t.ad_entities, t.ad_countries, t.ad_devices)
    a = ads.select("ad_id", "ad_set_id", *(F.col(x).alias(f"ad_{x}") for x in ("keywords", "topics", "entities")))
    p = targeting.page_context(*(getattr(t, x) for x in PAGES)).select("page_id", *(F.col(x).alias(f"page_{x}") for x in ("keywords", "topics", "entities")))
    return pairs.join(p, "page_id").join(a, "ad_id")


def near(t: Tables) -> DataFrame:
    """(page_id, ad_id, similarity) of the pages' nearest ads by vector."""
    chunks = t.page_vectors.select("page_id", F.lit(None).cast("int").alias("chunk_index"), "embedding")
    return similarity.rank_ads(chunks, t.ad_vectors).select("page_id", "ad_id", "similarity")


def mapped_topics(t: Tables) -> DataFrame:
    return t.ad_topics.join(t.topic_mapping.select(F.col("product_id").alias("topic_id"), F.col("content_id").alias("mapped_id")), "topic_id", "left").select("ad_id", "topic_id", "tier", "relevance_score", "mapped_id")


COSINE = "list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))"
NEAREST_SQL = f"SELECT page_id, ad_id, similarity FROM (SELECT p.page_id, a.ad_id, {COSINE} AS similarity FROM page_vectors p, ad_vectors a QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY similarity DESC, a.ad_id) <= 50) WHERE similarity >= 0.2"
PAIRS_SQL = "SELECT DISTINCT p.page_id, k.ad_id FROM page_keywords p JOIN ad_keywords k ON k.keyword = p.keyword JOIN active a ON a.ad_id = k.ad_id"
PENALTY = "CASE WHEN {p} <= {a} OR {a} = 0 THEN {s} ELSE {s} / (1 + 0.5 * log10({p}::DOUBLE / {a})) END"
KEYWORD_SQL = "SELECT g.page_id, g.ad_id, " + PENALTY.format(p="p.n", a="a.n", s="least(coalesce(m.s, 0) / a.w, 1)") + " AS keyword_score FROM pairs g JOIN (SELECT page_id, count(*) AS n FROM page_keywords GROUP BY 1) p ON p.page_id = g.page_id JOIN (SELECT ad_id, count(*) AS n, sum(relevance_score) AS w FROM ad_keywords GROUP BY 1) a ON a.ad_id = g.ad_id LEFT JOIN (SELECT p.page_id, k.ad_id, sum(k.relevance_score * p.relevance_score) AS s FROM page_keywords p JOIN ad_keywords k ON k.keyword = p.keyword GROUP BY 1, 2) m ON m.page_id = g.page_id AND m.ad_id = g.ad_id"
TOPIC_SQL = "SELECT page_id, ad_id, m / (pw + aw - m) AS topic_score FROM (SELECT g.page_id, g.ad_id, p.relevance_score * (1 + p.tier * 0.5::DOUBLE) AS pw, a.relevance_score * (1 + a.tier * 0.5::DOUBLE) AS aw, CASE WHEN t.content_id = p.topic_id THEN a.relevance_score * (1 + a.tier * 0.5::DOUBLE) * p.relevance_score WHEN a.topic_id = p.topic_id THEN a.relevance_score * (1 + a.tier * 0.5::DOUBLE) * p.relevance_score * 0.5::DOUBLE ELSE 0 END AS m FROM pairs g JOIN page_topics p ON p.page_id = g.page_id JOIN ad_topics a ON a.ad_id = g.ad_id LEFT JOIN topic_mapping t ON t.product_id = a.topic_id)"
ENTITY_SQL = "SELECT g.page_id, g.ad_id, CASE WHEN a.type = p.type AND list_contains(string_split(lower(p.text), ' '), lower(a.text)) THEN 1.0::DOUBLE ELSE 0 END AS entity_score FROM pairs g JOIN page_entities p ON p.page_id = g.page_id JOIN ad_entities a ON a.ad_id = g.ad_id"
QUALITY_SQL = """SELECT *, keyword_score * CASE pricing_model WHEN 'CPM' THEN 0.15 ELSE 0.2 END + topic_score * CASE pricing_model WHEN 'CPM' THEN 0.35 ELSE 0.3 END + entity_score * CASE pricing_model WHEN 'CPM' THEN 0.1 ELSE 0.4 END + similarity * CASE pricing_model WHEN 'CPM' THEN 0.4 ELSE 0.1 END AS quality
FROM (SELECT k.page_id, k.ad_id, a.campaign_id, a.pricing_model, a.bid_amount_cents / 100.0::DOUBLE AS bid_dollars, k.keyword_score, t.topic_score, e.entity_score, coalesce(n.similarity, 0) AS similarity
FROM k JOIN t ON t.page_id = k.page_id AND t.ad_id = k.ad_id JOIN e ON e.page_id = k.page_id AND e.ad_id = k.ad_id JOIN active a ON a.ad_id = k.ad_id LEFT JOIN near n ON n.page_id = k.page_id AND n.ad_id = k.ad_id)"""
SCORING = (*ADS, "topic_mapping", "ad_keywords", "ad_topics", "ad_entities", *PAGES, "page_vectors", "ad_vectors")
SCORES = {"active": ACTIVE_SQL, "near": NEAREST_SQL, "pairs": PAIRS_SQL, "k": KEYWORD_SQL, "t": TOPIC_SQL, "e": ENTITY_SQL}


class Sides:
    """Pages (p) and active ads (a): the numbers of their lists by row, and of pairs of lists what they share and score.

    What a page and an ad are to each other depends on their lists alone, so those that are alike are scored once (``operators.classes``).
    Lists that share no key score 0, so only those that do are met.
    """

    def __init__(self, t: Tables) -> None:
        ids = active(t).select("ad_id")
        keyword, topic, entity = F.struct("keyword", "relevance_score"), F.struct("topic_id", "tier", "relevance_score"), F.struct("text", "type")
        mapped = F.struct("topic_id", "tier", "relevance_score", "mapped_id")
        self.of: dict[str, tuple[DataFrame, DataFrame]] = {}
        for kind, pages, ads, page, ad in (("keywords", t.page_keywords, t.ad_keywords, keyword, keyword), ("topics", t.page_topics, mapped_topics(t), topic, mapped), ("entities", t.page_entities, t.ad_entities, entity, entity)):
            self._add(kind, pages, ads.join(ids, "ad_id", "left_semi"), F.sort_array(F.collect_list(page)), F.sort_array(F.collect_list(ad)))
        self._add("names", t.page_keywords, t.ad_keywords.join(ids, "ad_id", "left_semi"), *(F.sort_array(F.collect_set("keyword")) for _ in range(2)))

    def _add(self, kind: str, pages: DataFrame, ads: DataFrame, page: Column, ad: Column) -> None:
        self.of[f"p_{kind}"] = classes.numbered(pages.groupBy("page_id").agg(page.alias(f"page_{kind}")), "page_id", f"page_{kind}", f"p_{kind}")
        self.of[f"a_{kind}"] = classes.numbered(ads.groupBy("ad_id").agg(ad.alias(f"ad_{kind}")), "ad_id", f"ad_{kind}", f"a_{kind}")

    def pages(self, first: str, *kinds: str) -> DataFrame:
        """The pages that have a list of the first kind, with the numbers of their lists."""
        out = self.of[f"p_{first}"][0]
        for kind in kinds:
            out = out.join(self.of[f"p_{kind}"][0], "page_id", "left")
        return out

    def ads(self, first: str, *kinds: str) -> DataFrame:
        out = self.of[f"a_{first}"][0]
        for kind in kinds:
            out = out.join(self.of[f"a_{kind}"][0], "ad_id", "left")
        return out

    def scores(self, kind: str) -> DataFrame:
        """(p, a, score): numbers of the lists of a kind that share a key."""
        pages, ads = self.of[f"p_{kind}"][1], self.of[f"a_{kind}"][1]
        p, a, clean = F.col(f"page_{kind}"), F.col(f"ad_{kind}"), lambda x: F.lower(F.trim(x["text"]))
        if kind == "names":
            return classes.sharing(pages, ads, p, a).select(f"p_{kind}", f"a_{kind}")
        if kind == "keywords":
            met, score = classes.sharing(pages, ads, p["keyword"], a["keyword"]), scores.keyword_score(a, p)
        elif kind == "topics":
            met, score = classes.sharing(pages, ads, p["topic_id"], F.concat(a["topic_id"], a["mapped_id"])), scores.topic_score(a, p)
        else:
            met, score = classes.sharing(pages, ads, F.flatten(F.transform(p, lambda x: F.concat(F.array(clean(x)), F.split(clean(x), "\\s+")))), F.transform(a, clean)), scores.entity_score(a, p)
        return met.select(f"p_{kind}", f"a_{kind}", score.alias(f"{kind}_score"))

    def scored(self, met: DataFrame, *kinds: str) -> DataFrame:
        """Adds the scores of the kinds, 0 for lists that share nothing."""
        for kind in kinds:
            met = met.join(self.scores(kind), [f"p_{kind}", f"a_{kind}"], "left").withColumn(f"{kind}_score", F.coalesce(f"{kind}_score", F.lit(0.0)))
        return met

    def met(self, pages: DataFrame, ads: DataFrame, first: str, *kinds: str) -> DataFrame:
        """Rows of pages and blocks of ads (``classes.blocked`` by their first lists) that share a key of the first kind, with the scores of all kinds.

        A row of pages takes along the scores of its lists by the number of the ads' list (as many as share a key), so pairs are scored where they meet.
        """
        for kind in kinds:
            known = self.scores(kind).groupBy(f"p_{kind}").agg(F.map_from_entries(F.collect_list(F.struct(f"a_{kind}", f"{kind}_score"))).alias(f"{kind}_known"))
            pages = pages.join(known, f"p_{kind}", "left")
        key = [c for c in pages.columns if c in ("l", "page_id")]
        met = classes.met_in_place(self.scores(first), pages.select(*key, *(c for c in pages.columns if c not in key)), ads, f"p_{first}", f"a_{first}")
        for kind in kinds:
            met = met.withColumn(f"{kind}_score", F.coalesce(F.try_element_at(f"{kind}_known", F.col(f"a_{kind}")), F.lit(0.0))).drop(f"{kind}_known")
        return met


def held_ads(ads: DataFrame, first: str, *features: str) -> DataFrame:
    """Ads in blocks by their lists of a kind: items are ids (rs) of equal features."""
    placed = classes.placed(ads, "ad_id", *features)
    ids = classes.blocks(placed, "ad_id").join(classes.classes(ads, "ad_id", *features).drop("n"), "class").withColumnsRenamed({"class": "r", "ids": "rs"})
    return classes.blocked(ids, f"a_{first}", F.size("rs"), "r", "rs", *(f for f in features if f != f"a_{first}"))


def held_pages(pages: DataFrame, *features: str) -> DataFrame:
    """Pages in blocks (l, ls) with their features."""
    ids = classes.blocks(classes.placed(pages, "page_id", *features), "page_id")
    return ids.join(classes.classes(pages, "page_id", *features).drop("n"), "class").withColumnsRenamed({"class": "l", "ids": "ls"})


def shared_score(t: Tables, kind: str, name: str) -> DataFrame:
    """(page_id, ad_id, score) of the pages and active ads that share a keyword, by one kind of lists."""
    sides = Sides(t)
    first, more = ("keywords", ()) if kind == "keywords" else ("names", (kind,))
    pages, ads = sides.pages(first, *more), sides.ads(first, *more)
    own = [[f"{side}_{k}" for k in (first, *more)] for side in "pa"]
    left = classes.classes(pages, "page_id", *own[0]).withColumnRenamed("class", "l").drop("n")
    right = classes.classes(ads, "ad_id", *own[1]).withColumnRenamed("class", "r").drop("n")
    met = sides.scored(left.join(sides.scores(first), f"p_{first}").join(right, f"a_{first}"), *more)
    members = [classes.blocks(classes.placed(rows, key, *f), key) for rows, key, f in ((pages, "page_id", own[0]), (ads, "ad_id", own[1]))]
    return classes.expanded(rounded(met.select("l", "r", F.col(f"{kind}_score").alias(name))), *members, "page_id", "ad_id")


@query(with_tables("SELECT page_id, ad_id, round(keyword_score, 6) AS keyword_score FROM k", *ADS, "ad_keywords", "page_keywords", active=ACTIVE_SQL, pairs=PAIRS_SQL, k=KEYWORD_SQL))
def keyword_score(t: Tables) -> DataFrame:
    return shared_score(t, "keywords", "keyword_score")


@query(with_tables("SELECT page_id, ad_id, round(topic_score, 6) AS topic_score FROM t", *ADS, "topic_mapping", "ad_keywords", "page_keywords", "ad_topics", "page_topics", active=ACTIVE_SQL, pairs=PAIRS_SQL, t=TOPIC_SQL))
def topic_score(t: Tables) -> DataFrame:
    return shared_score(t, "topics", "topic_score")


@query(with_tables("SELECT page_id, ad_id, round(entity_score, 6) AS entity_score FROM e", *ADS, "ad_keywords", "page_keywords", "ad_entities", "page_entities", active=ACTIVE_SQL, pairs=PAIRS_SQL, e=ENTITY_SQL))
def entity_score(t: Tables) -> DataFrame:
    return shared_score(t, "entities", "entity_score")


LISTS = ("keywords", "topics", "entities")
P_LISTS, A_LISTS = [f"p_{k}" for k in LISTS], [f"a_{k}" for k in LISTS]
#: What the value of an ad depends on, but for its likeness to the page.
SOLD = [*A_LISTS, "campaign_id", "pricing_model", "bid_amount_cents"]


def valued(met: DataFrame) -> DataFrame:
    """Adds bid and quality to scored pairs of pages or classes."""
    c = F.col
    rows = met.withColumnsRenamed({"keywords_score": "keyword_score", "topics_score": "topic_score", "entities_score": "entity_score"}).withColumn("bid_dollars", c("bid_amount_cents") / F.lit(100.0))
    return rows.withColumn("quality", scores.quality_score(c("keyword_score"), c("topic_score"), c("entity_score"), c("similarity"), c("p_entities").isNotNull(), c("pricing_model"))).drop(*P_LISTS, *SOLD[:3], "bid_amount_cents")


class Valued:
    """Pages and active ads that share a keyword with their quality: pairs of classes, as if no ad were near a page, and the pairs that are near.

    An ad that isn't among a page's nearest has similarity 0.
    """

    def __init__(self, t: Tables) -> None:
        sides = Sides(t)
        self.pages = sides.pages(*LISTS)
        self.ads = sides.ads(*LISTS).join(active(t).select("ad_id", "campaign_id", "pricing_model", "bid_amount_cents"), "ad_id")
        self.sides = sides
        close = near(t).join(self.pages, "page_id").join(self.ads, "ad_id").join(sides.scores("keywords"), ["p_keywords", "a_keywords"])
        self.near = valued(sides.scored(close, "topics", "entities"))

    def met(self, pages: DataFrame, ads: DataFrame) -> DataFrame:
        """Pairs of rows of pages and items of ads, as if no ad were near a page."""
        return valued(self.sides.met(pages, ads, *LISTS).withColumn("similarity", F.lit(0.0)))

    def every(self, finish) -> DataFrame:
        """A row for each pair, as ``finish`` makes it of the pairs and of those of classes."""
        skips = self.near.groupBy("page_id").agg(F.collect_list("ad_id").alias("skip"))
        blocks = held_pages(self.pages.join(skips, "page_id", "left_anti"), *P_LISTS).withColumn("skip", F.lit(None).cast("array<bigint>"))
        alone = self.pages.join(skips, "page_id").select(F.col("page_id").alias("l"), F.array("page_id").alias("ls"), *P_LISTS, "skip")
        far = self.met(blocks.unionByName(alone), held_ads(self.ads, "keywords", *SOLD))
        return classes.rows_of(finish(far).drop("l", "r"), "page_id", "ad_id").unionByName(finish(self.near))

    def contenders(self, t: Tables, n: int) -> DataFrame:
        """Eligible scored pairs, among them each page's best ``n``.

        A class ranks its ads once. A page has at most ``NEIGHBOURS`` near ads, which may lie elsewhere in its own order, so it takes that many more.
        """
        most = n + similarity.NEIGHBOURS
        best = [F.desc("score"), F.desc("ecpm"), F.desc("quality")]
        whole = Window.partitionBy("l").orderBy(*best, "r")
        left = classes.classes(self.pages, "page_id", *P_LISTS).withColumnRenamed("class", "l").drop("n")
        right = classes.classes(self.ads, "ad_id", *SOLD).withColumnsRenamed({"class": "r", "n": "ads"})
        pairs = self.met(left, classes.blocked(right, "a_keywords", F.lit(1), "r", "ads", *(f for f in SOLD if f != "a_keywords")))
        graded = auction.score_candidates(pairs, multipliers(t)).where("eligible").withColumn("place", F.row_number().over(whole)).where(F.col("place") <= most)
        # Of classes with equal scores the ads mix, so only those that are better count.
        before = graded.withColumn("before", F.coalesce(F.sum("ads").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        wanted = before.withColumn("before", F.min("before").over(Window.partitionBy("l", "score", "ecpm", "quality"))).where(F.col("before") < most).drop("place", "before", "ads")
        first = classes.placed(self.ads, "ad_id", *SOLD).withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("ad_id"))).where(F.col("place") <= most)
        listed = wanted.join(first.select(F.col("class").alias("r"), "ad_id"), "r").withColumn("place", F.row_number().over(Window.partitionBy("l").orderBy(*best, "ad_id"))).where(F.col("place") <= most)
        close = auction.score_candidates(self.near, multipliers(t))
        more = close.groupBy("page_id").agg(F.count(F.lit(1)).alias("near"))
        far = classes.placed(self.pages, "page_id", *P_LISTS).select("page_id", F.col("class").alias("l")).join(more, "page_id", "left").join(listed, "l").where(F.col("place") <= n + F.coalesce("near", F.lit(0)))
        far = far.join(close.select("page_id", "ad_id"), ["page_id", "ad_id"], "left_anti")
        return far.select(*close.columns).unionByName(close.where("eligible"))


def quality(t: Tables, pairs: DataFrame) -> DataFrame:
    """All four signals and the quality of given pairs; an ad that isn't among a page's nearest has similarity 0."""
    c = F.col
    g = grid(t, pairs).select("page_id", "ad_id", "ad_set_id", scores.keyword_score(c("ad_keywords"), c("page_keywords")).alias("keyword_score"), scores.topic_score(c("ad_topics"), c("page_topics")).alias("topic_score"), scores.entity_score(c("ad_entities"), c("page_entities")).alias("entity_score"), (F.size("page_entities") > 0).alias("named"))
    g = g.join(near(t), ["page_id", "ad_id"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    g = g.join(t.ad_sets.select(c("id").alias("ad_set_id"), "campaign_id", "pricing_model", (c("bid_amount_cents") / F.lit(100.0)).alias("bid_dollars")), "ad_set_id")
    return g.withColumn("quality", scores.quality_score(c("keyword_score"), c("topic_score"), c("entity_score"), c("similarity"), c("named"), c("pricing_model"))).drop("ad_set_id", "named")


@query(with_tables("SELECT page_id, ad_id, campaign_id, pricing_model, round(bid_dollars, 6) AS bid_dollars, round(keyword_score, 6) AS keyword_score, round(topic_score, 6) AS topic_score, round(entity_score, 6) AS entity_score, round(similarity, 6) AS similarity, round(quality, 6) AS quality FROM q", *SCORING, **SCORES, q=QUALITY_SQL))
def quality_score(t: Tables) -> DataFrame:
    return Valued(t).every(rounded)


def multipliers(t: Tables) -> DataFrame:
    """One campaign in five has none, so its ads count as filtered by budget."""
    return t.spark.range(20).where("id % 5 <> 4").select(F.col("id").alias("campaign_id"), ((F.col("id") % 4 + 1) / F.lit(2.0)).alias("multiplier"))


SCORED_SQL = "SELECT *, pow(ecpm, 0.4) * pow(greatest(quality, 1e-6), 0.6) * pacing AS score FROM (SELECT q.*, CASE WHEN campaign_id % 5 = 4 THEN 0 ELSE (campaign_id % 4 + 1) / 2.0::DOUBLE END AS pacing, CASE pricing_model WHEN 'CPC' THEN bid_dollars * 0.05 * 1000 ELSE bid_dollars END AS ecpm FROM q)"
RANKED_SQL = "SELECT *, row_number() OVER w AS rnk, lead(score) OVER w AS next_score FROM scored WHERE pacing > 0 WINDOW w AS (PARTITION BY page_id ORDER BY score DESC, ecpm DESC, quality DESC, ad_id)"
PRICE_SQL = "SELECT *, least(CASE pricing_model WHEN 'CPC' THEN clear / 50 ELSE clear END, bid_dollars) AS price FROM (SELECT *, CASE WHEN next_score IS NULL THEN 0.5 WHEN quality * pacing > 0 THEN next_score / (quality * pacing) + 0.01 ELSE ecpm + 0.01 END AS clear FROM ranked WHERE rnk = 1)"
AUCTION = {**SCORES, "q": QUALITY_SQL, "scored": SCORED_SQL}


@query(with_tables("SELECT page_id, ad_id, campaign_id, pricing_model, round(ecpm, 6) AS ecpm, round(pacing, 6) AS pacing, round(score, 6) AS score, pacing > 0 AS eligible FROM scored", *SCORING, **AUCTION))
def rank_scores(t: Tables) -> DataFrame:
    shown = ("campaign_id", "pricing_model", "ecpm", "pacing", "score", "eligible")
    return Valued(t).every(lambda rows: rounded(auction.score_candidates(rows, multipliers(t)).select(*(c for c in ("ls", "rs", "skip", "page_id", "ad_id") if c in rows.columns), *shown)))


@query(with_tables("SELECT page_id, ad_id, campaign_id, pricing_model, round(bid_dollars, 6) AS bid_dollars, round(quality, 6) AS quality, round(pacing, 6) AS pacing, round(ecpm, 6) AS ecpm, round(score, 6) AS score, round(price, 6) AS clearing_price, CAST(trunc(price * 100) AS BIGINT) AS price_cents, CAST(trunc(ecpm * 100) AS BIGINT) AS winning_bid_cents FROM p", *SCORING, **AUCTION, ranked=RANKED_SQL, p=PRICE_SQL))
def second_price_auction(t: Tables) -> DataFrame:
    won = auction.second_price(Valued(t).contenders(t, 2), "page_id")
    return rounded(won.select("page_id", "ad_id", "campaign_id", "pricing_model", "bid_dollars", "quality", "pacing", "ecpm", "score", "clearing_price", "price_cents", "winning_bid_cents"))


@query(with_tables("SELECT page_id, count(*) AS num_candidates, count(*) FILTER (WHERE pacing <= 0) AS num_filtered_budget, count(*) FILTER (WHERE pacing > 0) AS num_eligible, (SELECT count(*) FROM active) - count(*) AS num_filtered_targeting FROM scored GROUP BY 1", *SCORING, **AUCTION))
def auction_stats(t: Tables) -> DataFrame:
    """Counted by the keywords that pages and ads have, then told to each page."""
    sides = Sides(t)
    ads = sides.ads("names").join(active(t).select("ad_id", "campaign_id"), "ad_id").groupBy("a_names", "campaign_id").agg(F.count(F.lit(1)).alias("ads"))
    paced = ads.join(multipliers(t), "campaign_id", "left").withColumn("eligible", F.coalesce("multiplier", F.lit(0.0)) > 0)
    stats = auction.auction_stats(sides.scores("names").join(paced, "a_names"), "p_names", active(t).count(), "ads")
    return sides.pages("names").join(stats, "p_names").drop("p_names")


@query(with_tables("SELECT page_id, ad_id, rnk AS rank, round(score, 6) AS score FROM ranked WHERE rnk <= 5", *SCORING, **AUCTION, ranked=RANKED_SQL))
def auction_top_n(t: Tables) -> DataFrame:
    return rounded(auction.top_n(Valued(t).contenders(t, 5), "page_id", 5).select("page_id", "ad_id", "rank", "score"))


SERVED = ("keyword_score", "topic_score", "entity_score", "similarity")
#: Pairs to score: a page's nearest ads that match it by a key.
CLOSE_SQL = "SELECT n.page_id, n.ad_id FROM near n JOIN m ON m.page_id = n.page_id AND m.ad_id = n.ad_id"
REQUESTED_SQL = "SELECT c.request_id, s.* FROM cand c JOIN requests r ON r.request_id = c.request_id JOIN scored s ON s.page_id = r.page_id AND s.ad_id = c.ad_id"
SERVE = {"active": ACTIVE_SQL, "idx": INDEX_SQL, "page_keys": PAGE_KEYS_SQL, "m": MATCHES_SQL, "cand": CANDIDATES_SQL, "near": NEAREST_SQL, "pairs": CLOSE_SQL, "k": KEYWORD_SQL, "t": TOPIC_SQL, "e": ENTITY_SQL, "q": QUALITY_SQL, "scored": SCORED_SQL, "asked": REQUESTED_SQL}
SERVE["ranked"] = RANKED_SQL.replace("FROM scored", "FROM asked").replace("PARTITION BY page_id", "PARTITION BY request_id")
SERVE_TABLES = (*ADS, *TARGETING, "topic_mapping", *PAGES, "requests", "page_vectors", "ad_vectors")


def asked(t: Tables) -> DataFrame:
    """Each request's candidates among its page's nearest ads, scored; pages are scored once, whatever their requests."""
    close = targeting.matching_pairs(near(t), page_keys(t), index(t))
    requested = targeting.fitting(t.requests, close, index(t))
    return requested.join(auction.score_candidates(quality(t, close), multipliers(t)), ["page_id", "ad_id"])


@query(with_tables("SELECT request_id, page_id, ad_id, campaign_id, pricing_model, round(similarity, 6) AS similarity, round(quality, 6) AS quality, round(score, 6) AS score, round(price, 6) AS clearing_price, CAST(trunc(price * 100) AS BIGINT) AS price_cents FROM p", *SERVE_TABLES, **SERVE, p=PRICE_SQL))
def ad_serving(t: Tables) -> DataFrame:
    """Requests answered end to end: candidates, vector search, scores, auction."""
    won = auction.second_price(asked(t), "request_id")
    return rounded(won.select("request_id", "page_id", "ad_id", "campaign_id", "pricing_model", "similarity", "quality", "score", "clearing_price", "price_cents"))


@query(with_tables("SELECT request_id, count(*) AS n, string_agg(CAST(ad_id AS VARCHAR), ',' ORDER BY rnk) AS ads FROM ranked GROUP BY 1", *SERVE_TABLES, **SERVE))
def auction_candidates(t: Tables) -> DataFrame:
    """Each request's ranked candidates as one array."""
    rows = auction.candidates_of(asked(t), "request_id")
    return rows.select("request_id", F.size("candidates").cast("bigint").alias("n"), F.array_join(F.transform("candidates", lambda c: c["ad_id"].cast("string")), ",").alias("ads"))


NEAR_SQL = f"SELECT p.page_id, a.ad_id, {COSINE} AS similarity FROM page_vectors p, ad_vectors a"


@query(with_tables("SELECT page_id, ad_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, ad_id) AS rank FROM n QUALIFY rank <= 10", "page_vectors", "ad_vectors", n=NEAR_SQL))
def knn_topk(t: Tables) -> DataFrame:
    return rounded(similarity.knn(t.page_vectors, t.ad_vectors, "page_id", "ad_id", 10))


@query(with_tables("SELECT page_id, ad_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, ad_id) AS rank FROM n QUALIFY rank <= 10", "page_vectors", "ad_vectors", n=NEAR_SQL))
def knn_indexed(t: Tables) -> DataFrame:
    """As ``knn_topk``, by inverted lists and triangle bounds."""
    return rounded(vector_index.search(vector_index.build(t.ad_vectors, "ad_id"), t.page_vectors, "page_id", "ad_id", 10))


@query()
def knn_probed_recall(t: Tables) -> DataFrame:
    """What the quick search finds of the true neighbours of all pages."""
    index = vector_index.build(t.ad_vectors, "ad_id")
    probes = vector_index.calibrated_probes(index, t.page_vectors, "page_id", "ad_id", 10)
    quick, exact = (vector_index.search(index, t.page_vectors, "page_id", "ad_id", 10, probes, x) for x in (False, True))
    return rounded(vector_index.recall(quick, exact, "page_id", "ad_id"))


@query(with_tables("SELECT page_id, ad_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, ad_id) AS rank FROM n WHERE similarity >= 0.3 QUALIFY rank <= 20", "page_vectors", "ad_vectors", n=NEAR_SQL))
def similar_threshold(t: Tables) -> DataFrame:
    return rounded(similarity.similar(t.page_vectors, t.ad_vectors, "page_id", "ad_id", 0.3, 20))


CHUNKS_SQL = "SELECT page_id // 20 AS page_id, CASE WHEN page_id % 20 = 1 THEN NULL ELSE page_id % 20 // 2 - 1 END AS chunk_index, embedding FROM page_vectors"
BEST_SQL = f"SELECT page_id, ad_id, max(similarity) AS similarity FROM (SELECT p.page_id, p.chunk_index, a.ad_id, {COSINE} AS similarity FROM (SELECT * FROM c WHERE chunk_index IS NULL OR chunk_index < 3) p, ad_vectors a QUALIFY row_number() OVER (PARTITION BY p.page_id, p.chunk_index ORDER BY similarity DESC, a.ad_id) <= 50) WHERE similarity >= 0.2 GROUP BY 1, 2"


@query(with_tables("SELECT page_id, ad_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, ad_id) AS rank FROM b WHERE (page_id, ad_id) IN (SELECT page_id, ad_id FROM m)", "page_vectors", "ad_vectors", *TARGETING, *PAGES, *ADS, **INDEXED, page_keys=PAGE_KEYS_SQL, m=MATCHES_SQL, c=CHUNKS_SQL, b=BEST_SQL))
def knn_max_over_chunks(t: Tables) -> DataFrame:
    k = F.col("page_id") % 20
    chunks = t.page_vectors.select(F.floor(F.col("page_id") / 20).alias("page_id"), F.when(k != 1, F.floor(k / 2) - 1).alias("chunk_index"), "embedding")
    return rounded(similarity.rank_ads(chunks, t.ad_vectors, lambda best: targeting.matching_pairs(best, page_keys(t), index(t))))


@query(with_tables("SELECT page_id, page_id - 1 AS ad_id, round(" + COSINE + ", 6) AS similarity FROM page_vectors p JOIN ad_vectors a ON a.ad_id = p.page_id - 1", "page_vectors", "ad_vectors"))
def cosine_expression(t: Tables) -> DataFrame:
    a = t.ad_vectors.select("ad_id", F.col("embedding").alias("v"))
    p = t.page_vectors.withColumn("ad_id", F.col("page_id") - 1)
    return rounded(p.join(a, "ad_id").select("page_id", "ad_id", cosine(F.col("embedding"), F.col("v")).alias("similarity")))


@query(with_tables("SELECT label, pos - 1 AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM ad_vectors) GROUP BY 1, 2", "ad_vectors"))
def mean_vectors(t: Tables) -> DataFrame:
    return rounded(similarity.mean_vector(t.ad_vectors, "label").select("label", F.posexplode("embedding").alias("pos", "x")))


BUDGETS = "SELECT id AS campaign_id, CASE WHEN id % 4 = 3 THEN NULL ELSE (id * 150 + 1) END AS total, id * 20 AS day, 0.5::DOUBLE + id / 20.0::DOUBLE AS m FROM campaigns"
SPENT = "SELECT campaign_id, CAST(sum(price_cents) AS BIGINT) AS c FROM impressions GROUP BY 1"
TODAY = "SELECT campaign_id, CAST(sum(price_cents) AS BIGINT) AS c FROM impressions WHERE CAST(event_time AS DATE) = DATE '2024-01-10' GROUP BY 1"


@query(with_tables("SELECT b.campaign_id, round(CASE WHEN b.total IS NULL THEN 1 WHEN b.total > 0 AND coalesce(s.c, 0) >= b.total * 100 THEN 0 WHEN b.day > 0 AND coalesce(d.c, 0) >= b.day * 100 THEN 0 ELSE b.m END, 6) AS multiplier FROM b LEFT JOIN s ON s.campaign_id = b.campaign_id LEFT JOIN d ON d.campaign_id = b.campaign_id", "campaigns", "impressions", b=BUDGETS, s=SPENT, d=TODAY))
def budget_caps(t: Tables) -> DataFrame:
    k = F.col("id")
    states = t.campaigns.where("id % 4 <> 3").select(k.alias("campaign_id"), (k * 150 + 1).cast("string").alias("total_budget"), (k * 20).cast("string").alias("daily_budget"), (F.lit(0.5) + k / F.lit(20.0)).alias("current_multiplier"))
    spend = t.impressions.groupBy("campaign_id").agg(F.sum("price_cents").alias("spend_cents"))
    daily = t.impressions.where(F.to_date("event_time") == F.lit("2024-01-10").cast("date")).groupBy("campaign_id").agg(F.sum("price_cents").alias("spend_cents"))
    return rounded(pacing.multipliers(t.campaigns.select(k.alias("campaign_id")), states, spend, daily))


STATE_SQL = "SELECT id, id * 1.0::DOUBLE + 50 AS total_budget, id % 40 * 2.5::DOUBLE AS daily_budget, id % 90 * 1.0::DOUBLE AS spent, CASE WHEN id % 6 = 5 THEN NULL ELSE id % 17 * 3.0::DOUBLE END AS spent_today, 1700000000.0::DOUBLE AS start_s, 1700000000.0::DOUBLE + (id % 11) * 86400 AS end_s, 1700000000.0::DOUBLE + id * 977 AS now_s, id % 20 / 10.0::DOUBLE AS m, id % 7 - 3.0::DOUBLE AS i FROM ad_sets"
PI_SQL = """SELECT id, status, round(CASE status WHEN 'ok' THEN e WHEN 'budget_exhausted' THEN -1 ELSE 0 END, 6) AS error,
round(CASE status WHEN 'ok' THEN greatest(0.1, least(2.0, m + greatest(-0.04 * 1.9, least(0.08 * 1.9, adj)))) WHEN 'budget_exhausted' THEN 0 ELSE m END, 6) AS new_multiplier, round(ni, 6) AS new_integral
FROM (SELECT *, greatest(-0.5, least(1.0, 0.15 * e * u + 0.04 * ni * u)) AS adj FROM (SELECT *, CASE WHEN status <> 'ok' OR (m >= 2 AND e > 0) OR (m <= 0.1 AND e < 0) THEN i ELSE greatest(-5, least(5, i + e)) END AS ni
FROM (SELECT *, greatest(-1.5, least(1.5, (target - td) / target)) AS e, 0.3 * (1 + cs * cs) + 0.7 * (1 + ds * ds) AS u, CASE WHEN rest <= 0 OR (daily_budget > 0 AND spent_today >= daily_budget) THEN 'budget_exhausted' WHEN target < 0.01 THEN 'target_too_low' ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN daily_budget > 0 THEN least(ideal, daily_budget) ELSE ideal END * greatest(0.05, ds) AS target
FROM (SELECT *, rest / greatest(1, greatest(0, end_s - now_s) / 3600) * 24 AS ideal, CASE WHEN end_s <= start_s THEN 1 ELSE greatest(0, least(1, (now_s - start_s) / (end_s - start_s))) END AS cs
FROM (SELECT *, total_budget - spent AS rest, coalesce(spent_today, 0) AS td, (now_s % 86400) / 86400 AS ds FROM st))))))"""


def pi_rows(t: Tables) -> DataFrame:
    k = F.col("id")
    return t.ad_sets.select("id", (k + F.lit(50.0)).alias("total_budget"), (k % 40 * 2.5).alias("daily_budget"), (k % 90).cast("double").alias("spent"), F.when(k % 6 != 5, k % 17 * 3.0).alias("spent_today"), F.lit(1.7e9).alias("start"), (F.lit(1.7e9) + k % 11 * 86400).alias("end"), (F.lit(1.7e9) + k * 977).alias("now"), (k % 20 / F.lit(10.0)).alias("multiplier"), (k % 7 - 3.0).alias("integral"))


@query(with_tables(PI_SQL, "ad_sets", st=STATE_SQL))
def pi_step(t: Tables) -> DataFrame:
    return rounded(pacing.pi_step(pi_rows(t)).select("id", "status", "error", "new_multiplier", "new_integral"))
