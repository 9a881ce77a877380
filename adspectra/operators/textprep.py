"""Text features: entities, keywords, chunks. Models that aren't available are replaced by deterministic rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adspectra.functions.vectors import cosine

LEAST_CHUNK_WORDS, TOKENS_PER_WORD, MOST_TOKENS = 20, 0.75, 256
ENTITY_LEAST_CHARS = 3


@dataclass(frozen=True)
class Features:
    """What is taken from a text: how many keywords, which taxonomy from which score on, and whether it is cut into chunks."""

    keywords: int
    taxonomy: str
    threshold: float
    chunked: bool


#: Fixed values.
AD_FEATURES = Features(20, "product", 0.1, False)
PAGE_FEATURES = Features(30, "content", 0.3, True)
#: English function words that are no keywords.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you", "your")


def clean_entity(text: Column) -> Column:
    """Lower case, without possessives, punctuation at the ends and repeated spaces."""
    t = F.regexp_replace(F.lower(text), "['’]s\\b", "")
    t = F.btrim(t, F.lit(" ,.;:!?-()[]{}\"'"))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns once and for all: the optimizer can't copy their expressions into the functions that use them."""
    return df.select(F.inline(F.array(F.struct(*df.columns, *(c.alias(x) for x, c in columns.items())))))


def _best_of_row(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, keyword, weight, best, r) of rows (key, w) that are texts by themselves, without a shuffle or a row for each word.

    Equal words and pairs stand side by side in the sorted array.  It is in the order that breaks ties of weight, so only the n that are kept are sorted by weight.
    """
    pairs = F.transform(F.slice("w", 2, F.size("w")), lambda x, i: F.concat(F.get("w", i), F.lit(" "), x))
    grams = _made(_made(rows.where(F.size("w") > 0), g=F.sort_array(F.concat("w", pairs))).drop("w"), s=F.filter(F.transform("g", lambda x, i: F.when((i == 0) | (x != F.get("g", i - 1)), i)), lambda i: i.isNotNull()))
    keyword = lambda s: F.get("g", s)
    size = F.transform("s", lambda s, k: ((F.coalesce(F.get("s", k + 1), F.size("g")) - s) * F.when(F.contains(keyword(s), F.lit(" ")), 3).otherwise(2)).cast("bigint"))
    weighed = _made(grams, weights=size)
    least = _made(weighed, nth=F.coalesce(F.get(F.sort_array("weights", False), F.lit(n - 1)), F.lit(0)))
    over = _made(least, over=F.filter(F.transform("weights", lambda x, k: F.when(x > F.col("nth"), k)), lambda k: k.isNotNull()), ties=F.filter(F.transform("weights", lambda x, k: F.when(x == F.col("nth"), k)), lambda k: k.isNotNull()))
    kept = F.concat("over", F.slice("ties", 1, n - F.size("over")))
    top = F.sort_array(F.transform(kept, lambda k: F.struct((-F.get("weights", k)).alias("less"), keyword(F.get("s", k)).alias("keyword"))))
    each = _made(over, top=top).select(key, (-F.get("top", F.lit(0))["less"]).alias("best"), F.posexplode("top").alias("pos", "x"))
    return each.select(key, F.col("x.keyword").alias("keyword"), (-F.col("x.less")).alias("weight"), "best", (F.col("pos") + 1).alias("r"))


def _best_of_key(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, keyword, weight, best, r) of rows (key, w), of which all with one key are one text; words and pairs are grouped, so that no key has to fit into memory."""
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    grams = rows.select(key, F.explode(F.concat("w", pairs)).alias("keyword")).groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("c"))
    weighed = grams.withColumn("weight", F.col("c") * (F.size(F.split("keyword", " ")) + 1))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "keyword")
    ranked = weighed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return ranked.select(key, "keyword", "weight", F.max("weight").over(Window.partitionBy(key)).alias("best"), "r")


def keywords(docs: DataFrame, key: str, text: str, n: int, least: float = 0.0) -> DataFrame:
    """(key, keyword, relevance_score): the n words and pairs of most weight; a stand-in for an embedding model.

    Weight is frequency times length in words, scaled to the best of the text.  Rows of one key are one text, but for pairs, which stand
    in one row.  Texts are shuffled once, their words only where a key has several rows.
    """
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " ")), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))
    rows = docs.select(key, text).withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
    alone, several = (_made(rows.where(c).select(key, text), w=words).select(key, "w") for c in (F.col("__rows") == 1, F.col("__rows") > 1))
    best = _best_of_row(alone, key, n).unionByName(_best_of_key(several, key, n))
    return best.withColumn("relevance_score", F.col("weight") / F.col("best")).where(F.col("relevance_score") >= least).select(key, "keyword", "relevance_score", F.col("r").alias("rank"))


def entities(docs: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, text, type) of the gazetteer's names (one word each) in the text; a stand-in for a tagger."""
    words = docs.select(key, F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}#]+", " "), " "))).alias("word"))
    names = gazetteer.select(clean_entity(F.col("text")).alias("word"), "type").where(F.length("word") >= ENTITY_LEAST_CHARS)
    return words.join(names, "word").select(key, F.col("word").alias("text"), "type").distinct()


def sentences(text: Column) -> Column:
    """Sentences: cut after a stop, question or exclamation mark or at a line's end."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+|\\n+"), lambda s: F.trim(s)), lambda s: s != "")


def adjacent_similarity(units: DataFrame, key: str) -> DataFrame:
    """Adds ``similarity``: the cosine of each unit's embedding and the next one's; null for the last."""
    following = F.lead("embedding").over(Window.partitionBy(key).orderBy("pos"))
    rows = units.withColumn("__next", following)
    return rows.withColumn("similarity", F.when(F.col("__next").isNotNull(), cosine(F.col("embedding"), F.col("__next")))).drop("__next")


def semantic_breaks(units: DataFrame, key: str, knob: float = 0.5) -> DataFrame:
    """Adds ``chunk`` to rows (key, pos, similarity to the next row): a chunk ends where the similarity
    is under the mean less ``knob`` population deviations. With fewer than two similarities each row is a chunk."""
    whole = Window.partitionBy(key)
    order = Window.partitionBy(key).orderBy("pos")
    n = F.count("similarity").over(whole)
    low = F.col("similarity") < F.avg("similarity").over(whole) - knob * F.stddev_pop("similarity").over(whole)
    flagged = units.withColumn("__break", F.coalesce(F.when(n < 2, F.lit(1)).when(low, 1), F.lit(0)))
    return flagged.withColumn("chunk", F.coalesce(F.sum("__break").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__break")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def joined_groups(units: DataFrame, key: str) -> DataFrame:
    """(key, pos, content): the units (key, pos, content, g) of each group as one text; groups are numbered by their order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "content")))
    return units.groupBy(key, "g").agg(F.array_join(F.transform(ordered, lambda u: u["content"]), " ").alias("content")).withColumnRenamed("g", "pos")


def merge_short(units: DataFrame, key: str, least: int = LEAST_CHUNK_WORDS) -> DataFrame:
    """(key, pos, content) with short units joined to the next one, and a short last one to the one before.

    In a run of short units every second one is taken in by the one before it, and so is the unit after a run of odd length.
    So a unit begins a new group unless an odd number of short units in a row stands right before it.
    """
    order = Window.partitionBy(key).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    place = units.withColumn("i", F.row_number().over(order)).withColumn("short", n_words(F.col("content")) < least)
    run = F.col("i") - 1 - F.coalesce(F.max(F.when(~F.col("short"), F.col("i"))).over(before), F.lit(0))
    grouped = joined_groups(place.withColumn("new", (run % 2 == 0).cast("int")).withColumn("g", F.sum("new").over(order)), key)
    last = F.lead("pos").over(order).isNull() & (F.col("pos") > 1) & (n_words(F.col("content")) < least)
    return joined_groups(grouped.withColumn("g", F.when(last, F.col("pos") - 1).otherwise(F.col("pos"))), key)


def split_large(text: Column, most: int = MOST_TOKENS) -> Column:
    """The chunks of a text: itself, or where it has over ``most`` tokens, its sentences filled up to that many; a longer sentence is a chunk by itself."""
    tokens = lambda s: F.floor(n_words(s) * TOKENS_PER_WORD).cast("int")
    nothing = F.array().cast("array<string>")
    begin = F.struct(nothing.alias("done"), nothing.alias("open"), F.lit(0).alias("used"))
    closed = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], " ")))).otherwise(a["done"])

    def take(a: Column, s: Column) -> Column:
        fits = a["used"] + s["n"] <= most
        return F.struct(F.when(fits, a["done"]).otherwise(closed(a)).alias("done"), F.when(fits, F.concat(a["open"], F.array(s["s"]))).otherwise(F.array(s["s"])).alias("open"), (F.when(fits, a["used"]).otherwise(F.lit(0)) + s["n"]).alias("used"))

    sized = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), tokens(s).alias("n")))
    return F.when(tokens(text) <= most, F.array(text)).otherwise(F.aggregate(sized, begin, take, closed))


def chunks(docs: DataFrame, key: str, text: str, least: int = LEAST_CHUNK_WORDS, most: int = MOST_TOKENS) -> DataFrame:
    """(key, chunk_index, content): sentences, short ones merged, large ones cut.

    Rows that repeat a key are separate texts; their chunks have the same key. Null and empty texts have none.
    """
    rows = docs.select(F.struct(F.col(key), F.monotonically_increasing_id().alias("row")).alias("k"), text)
    units = rows.select("k", F.posexplode(sentences(F.col(text))).alias("pos", "content"))
    parts = merge_short(units, "k", least).select("k", "pos", F.posexplode(split_large(F.col("content"), most)).alias("part", "content"))
    order = Window.partitionBy("k").orderBy("pos", "part")
    return parts.select(F.col(f"k.{key}").alias(key), (F.row_number().over(order) - 1).alias("chunk_index"), "content")


def token_chunks(words: Column, size: int, overlap: int) -> Column:
    """Arrays of ``size`` words, each overlapping the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(F.size(words) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(words, i + 1, size)))


def html_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Visible text of a page by the standard library's parser."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "title") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    def text(s: str | None) -> str:
        p = Text()
        p.feed(s or "")
        p.close()
        return " ".join(" ".join(p.out).split())

    own = T.StructType([pages.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(x) for x in batch.column(1).to_pylist()], pa.string())], own.names)

    return pages.select(key, html).mapInArrow(run, own)
