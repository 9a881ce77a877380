"""The registered queries over vectors of texts, names of several words and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspectra.operators import cache, embedding, names, textprep
from adspectra.registry import query, rounded
from adspectra.sources.driver import Tables

WORDS = r"list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(
    f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word FROM documents),
    f AS (SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {embedding.FEATURES} AS b FROM w),
    i AS (SELECT b, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(DISTINCT doc_id))::DOUBLE) + 1 AS idf FROM f GROUP BY 1),
    v AS (SELECT doc_id, b % {embedding.DIMENSIONS} AS dim, sum(CASE WHEN (b // {embedding.DIMENSIONS}) % 2 = 0 THEN idf ELSE -idf END) AS x FROM f JOIN i USING (b) GROUP BY 1, 2),
    n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1)
    SELECT d.doc_id, CAST(r.dim AS INTEGER) AS dim, round(coalesce(x / nullif(norm, 0), 0), 6) + 0.0 AS weight
    FROM documents d CROSS JOIN range({embedding.DIMENSIONS}) r(dim) LEFT JOIN v ON v.doc_id = d.doc_id AND v.dim = r.dim LEFT JOIN n ON n.doc_id = d.doc_id"""
)
def document_embeddings(t: Tables) -> DataFrame:
    """Every document's vector, a row for each dimension."""
    found = embedding.embeddings(t.raw("documents"), "doc_id", "text")
    return found.select("doc_id", F.posexplode("embedding").alias("dim", "weight")).withColumn("weight", F.round("weight", 6) + 0.0)


@query()
def document_semantic_chunks(t: Tables) -> DataFrame:
    """Every document's sentences, each with the number of its chunk: texts made vectors, chunks cut where neighbours are unlike."""
    units = t.raw("documents").select("doc_id", F.posexplode(textprep.sentences(F.col("text"))).alias("pos", "content"))
    vectors = embedding.embeddings(units, ["doc_id", "pos"], "content")
    return textprep.semantic_breaks(textprep.adjacent_similarity(vectors, "doc_id"), "doc_id").select("doc_id", "pos", "chunk")


NAMED = """WITH p AS (SELECT p_partkey, p_size, lower(p_name) AS name, lower(p_type) AS kind, string_split(lower(p_name), ' ') AS w FROM part),
    one AS (SELECT DISTINCT w[1] AS name FROM p WHERE p_size % 3 = 0), two AS (SELECT DISTINCT name FROM p WHERE p_size % 2 = 0), three AS (SELECT DISTINCT name || ' ' || kind AS name FROM p WHERE p_size % 5 = 0),
    m AS (SELECT p_partkey, w, name, kind, name || ' ' || kind IN (SELECT name FROM three) AS by3, name IN (SELECT name FROM two) AS by2, w[1] IN (SELECT name FROM one) AS by1, w[2] IN (SELECT name FROM one) AS also, w[2] || ' ' || kind IN (SELECT name FROM two) AS late, kind IN (SELECT name FROM one) AS last FROM p)
    SELECT p_partkey, 1 AS pos, 3 AS size, name || ' ' || kind AS name, 'ORG' AS type FROM m WHERE by3
    UNION ALL SELECT p_partkey, 1, 2, name, 'PRODUCT' FROM m WHERE by2 AND NOT by3
    UNION ALL SELECT p_partkey, 1, 1, w[1], 'EVENT' FROM m WHERE by1 AND NOT by2 AND NOT by3
    UNION ALL SELECT p_partkey, 2, 1, w[2], 'EVENT' FROM m WHERE also AND NOT late AND NOT by2 AND NOT by3
    UNION ALL SELECT p_partkey, 2, 2, w[2] || ' ' || kind, 'PRODUCT' FROM m WHERE late AND NOT by2 AND NOT by3
    UNION ALL SELECT p_partkey, 3, 1, kind, 'EVENT' FROM m WHERE last AND NOT by3 AND (by2 OR NOT late)"""


@query(NAMED)
def names_of_several_words(t: Tables) -> DataFrame:
    """Names of one to three words in every part's text; at each word the longest."""
    part, size = t.raw("part"), F.col("p_size")
    one = part.where(size % 3 == 0).select(F.split("p_name", " ")[0].alias("text"), F.lit("EVENT").alias("type"))
    two = part.where(size % 2 == 0).select(F.upper("p_name"), F.lit("PRODUCT"))
    three = part.where(size % 5 == 0).select(F.concat_ws(" ", "p_name", "p_type"), F.lit("ORG"))
    texts = part.select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit("'s "), "p_type", F.lit(", zzz!")).alias("text"))
    return names.names_in(texts, "p_partkey", "text", one.union(two).union(three))


NOW, DAYS_15 = "2024-01-31 00:00:00", 15 * 86400


@query(
    f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'miss' WHEN ts + INTERVAL 15 DAY > TIMESTAMP '{NOW}' THEN 'hit' ELSE 'expired' END AS status,
    CASE WHEN event_id % 3 > 0 AND ts + INTERVAL 15 DAY > TIMESTAMP '{NOW}' THEN value WHEN event_type <> 'view' THEN value * 2 END AS value,
    NOT (event_id % 3 > 0 AND ts + INTERVAL 15 DAY > TIMESTAMP '{NOW}') AND event_type <> 'view' AS loaded FROM events"""
)
def cache_read_through(t: Tables) -> DataFrame:
    """Values of all events out of a cache of two thirds of them; what it lacks or has held for 15 days is loaded, but for views, which the source doesn't know."""
    events = t.raw("events")
    held = events.where("event_id % 3 > 0").select("event_id", "value", F.col("ts").alias("stored_at"))
    source = events.where("event_type <> 'view'").select("event_id", (F.col("value") * 2).alias("value"))
    looked = cache.looked_up(events, held, "event_id", F.lit(NOW).cast("timestamp_ntz"), DAYS_15)
    return cache.filled(looked, lambda lacking: source.join(lacking, "event_id", "left_semi"), "event_id").select("event_id", "status", "value", "loaded")
