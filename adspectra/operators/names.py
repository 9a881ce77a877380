"""Names of one or more words in texts, by longest match against a table of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspectra.operators.textprep import ENTITY_LEAST_CHARS

#: The types of names that are kept.
TYPES = ("ORG", "PRODUCT", "PERSON", "EVENT", "GPE")
#: Parts that each step's rows of one word or name are dealt to, so that a word of every text isn't one task's.
SALTS = 8


def repaired(text: Column) -> Column:
    """A text whose UTF-8 bytes were read as Latin-1, read as UTF-8 again; any other text, and one whose bytes aren't UTF-8, as it is."""
    broken = text.rlike("[\\xC2-\\xF4][\\x80-\\xBF]") & ~text.rlike("[^\\x00-\\xFF]")
    return F.coalesce(F.try_validate_utf8(F.encode(F.when(broken, text), "ISO-8859-1").cast("string")), text)


def words(text: Column) -> Column:
    """Words of a text as names are compared by: repaired, in lower case, without possessives and punctuation."""
    plain = F.regexp_replace(F.lower(repaired(text)), "['’]s\\b", "")
    return F.filter(F.split(F.regexp_replace(plain, "[^\\p{L}\\p{N}#]+", " "), " "), lambda w: w != "")


def name_table(gazetteer: DataFrame) -> DataFrame:
    """(name, first, size, types): each different name of an allowed type, of ``ENTITY_LEAST_CHARS`` characters or more."""
    rows = gazetteer.where(F.col("type").isin(*TYPES)).select(words(F.col("text")).alias("w"), "type")
    named = rows.select(F.array_join("w", " ").alias("name"), F.col("w")[0].alias("first"), F.size("w").alias("size"), "type").where(F.length("name") >= ENTITY_LEAST_CHARS)
    return named.groupBy("name", "first", "size").agg(F.sort_array(F.collect_set("type")).alias("types"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def names_in(docs: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, pos, size, name, type): the names in each text, from left to right, at each word the longest; names don't overlap.

    A walk down a tree of names: a word goes on only if names begin with it, with as many words after it as the longest of them has, and each of
    these runs is looked up.  So of the texts only such words are shuffled, dealt out by a salt.  Names that overlap in a chain are
    chosen together, chains (cut where no name reaches over) one by one.

    A name of several types gives a row for each.  Null texts have no names; rows that repeat a key are texts of their own; pos counts words from 0.
    """
    names = name_table(gazetteer)
    starts = _dealt(names.groupBy("first").agg(F.max("size").alias("longest")))
    # The words from each on are cut to the table's longest name before they are shuffled, and before rows are made of them.
    most = names.agg(F.coalesce(F.max("size"), F.lit(1)).alias("most"))
    texts = docs.select(F.struct(F.col(key), F.monotonically_increasing_id().alias("row")).alias("k"), words(F.col(text)).alias("w")).crossJoin(F.broadcast(most))
    ahead = texts.select("k", F.posexplode(F.transform("w", lambda _, i: F.slice("w", i + 1, F.col("most")))).alias("pos", "after"))
    at = ahead.withColumn("first", F.col("after")[0]).withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)).cast("int"))
    begun = at.join(starts, ["first", "salt"])
    longest = F.least(F.col("longest"), F.size("after"))
    runs = begun.select("k", "pos", "salt", F.explode(F.transform(F.sequence(F.lit(1), longest), lambda n: F.struct(n.alias("size"), F.array_join(F.slice("after", 1, n), " ").alias("name")))).alias("run"))
    found = runs.select("k", "pos", "salt", "run.*").join(_dealt(names.select("name", "types")), ["name", "salt"])
    best = found.groupBy("k", "pos").agg(F.max(F.struct("size", "name", "types")).alias("b")).select("k", "pos", "b.*")
    order = Window.partitionBy("k").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = best.withColumn("new", (F.coalesce(reach, F.lit(0)) <= F.col("pos")).cast("int")).withColumn("chain", F.sum("new").over(order))
    chain = chained.groupBy("k", "chain").agg(F.sort_array(F.collect_list(F.struct("pos", "size", "name", "types"))).alias("m"))
    fields = "pos int, size int, name string, types array<string>"
    begin = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>").alias("kept"))

    def take(a: Column, x: Column) -> Column:
        fits = x["pos"] >= a["end"]
        return F.struct(F.when(fits, x["pos"] + x["size"]).otherwise(a["end"]).alias("end"), F.when(fits, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"))

    chosen = chain.select("k", F.inline(F.aggregate("m", begin, take, lambda a: a["kept"])))
    return chosen.select(F.col(f"k.{key}").alias(key), "pos", "size", "name", F.explode("types").alias("type"))
