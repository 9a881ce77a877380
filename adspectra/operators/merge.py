"""Changes to tables as new snapshots: upserts, deletes, replacements of children, reconciliation.

A snapshot is immutable; each function gives the next one.  ``written_by_day`` stores facts by day,
replacing whole days, so a repeated write leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adspectra.functions.vectors import from_text


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation with map-side combining."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*changes.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the changes replace or join those of the table; one row per key is expected in the changes."""
    return table.join(changes.select(*keys), keys, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key is new; of new rows with one key any one."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti").select(*table.columns)


def cascade(parents: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """The parents without the gone ones, and each child table without their rows; children: (table, foreign key)."""
    ids = gone.select(key)
    return [delete(parents, ids, [key]), *(delete(df, ids.withColumnRenamed(key, fk), [fk]) for df, fk in children)]


def merge_columns(table: DataFrame, changes: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by column: a null in the changes keeps the old value, and so does any value for ``keep_old``."""
    new = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys))
    joined = table.join(new, keys, "full")
    pick = lambda c: F.coalesce(c, f"__{c}") if c in keep_old else F.coalesce(f"__{c}", c)
    return joined.select(*(c if c in keys or f"__{c}" not in joined.columns else pick(c).alias(c) for c in table.columns))


def replace_children(children: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All children of the parents that ``fresh`` has rows for are replaced."""
    return delete(children, fresh.select(key).distinct(), [key]).unionByName(fresh.select(*children.columns))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key isn't done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def activated(ads: DataFrame, analysed: DataFrame) -> DataFrame:
    """Ads that wait for their analysis and have it become active."""
    done = analysed.select(F.col("ad_id").alias("id"), F.lit(True).alias("__done")).distinct()
    on = (F.col("status") == "PENDING_ANALYSIS") & F.col("__done").isNotNull()
    return ads.join(done, "id", "left").withColumn("status", F.when(on, "ACTIVE").otherwise(F.col("status"))).select(*ads.columns)


def reconcile(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(label, actual, expected, status) of row counts."""
    rows = [a.agg(F.count(F.lit(1)).alias("actual")).crossJoin(e.agg(F.count(F.lit(1)).alias("expected"))).select(F.lit(label).alias("label"), "actual", "expected") for label, a, e in checks]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("status", F.when(F.col("actual") == F.col("expected"), "ok").otherwise("mismatch"))


def page_documents(pages: DataFrame, keywords: DataFrame, topics: DataFrame, entities: DataFrame) -> DataFrame:
    """One denormalised document per page: keyword map, topics and entities, as JSON text."""
    as_map = lambda df, k, v: df.groupBy("page_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias("m"))
    kw = as_map(keywords.groupBy("page_id", "keyword").agg(F.max("relevance_score").alias("s")), "keyword", "s").withColumnRenamed("m", "keywords")
    tp = as_map(topics.groupBy("page_id", "topic_id").agg(F.max("relevance_score").alias("s")), "topic_id", "s").withColumnRenamed("m", "topics")
    en = entities.groupBy("page_id").agg(F.sort_array(F.collect_set(F.struct("text", "type"))).alias("entities"))
    rows = pages.select("page_id").join(kw, "page_id", "left").join(tp, "page_id", "left").join(en, "page_id", "left")
    return rows.select("page_id", F.to_json(F.struct("keywords", "topics", "entities")).alias("document"))


PAGE_DOCUMENT = "keywords map<string,double>, topics map<string,double>, entities array<struct<text:string,type:string>>"


def read_documents(documents: DataFrame) -> DataFrame:
    """The documents of ``page_documents`` as columns; all null where the text can't be read."""
    return documents.withColumn("d", F.from_json("document", PAGE_DOCUMENT)).select("page_id", "d.*")


def vector_documents(ads: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ad_id, embedding) of the given ads, out of vectors stored as text; ads without a vector are left out."""
    return vectors.join(ads.select("ad_id").distinct(), "ad_id", "left_semi").select("ad_id", from_text(F.col("embedding")).alias("embedding")).where("embedding is not null")


def listed(table: DataFrame, column: str, value: object, *order: Column | str) -> DataFrame:
    """The rows of one id or parent, in order."""
    return table.where(F.col(column) == F.lit(value)).orderBy(*order)


def cache_keys(keys: Column, prefix: str) -> Column:
    """The id in keys of the form prefix:id with exactly two parts; null for others."""
    parts = F.split(keys, ":")
    return F.when((F.size(parts) == 2) & (parts[0] == prefix), parts[1])


def written_by_day(facts: DataFrame, path: str, time: str = "event_time") -> None:
    dated = facts.withColumn("event_date", F.to_date(time))
    dated.repartition("event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def written_together(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Writes the tables as one version; it counts only once all are written, and a repeated one replaces itself."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}/{version}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/committed/at={version}")


def read_together(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    """The tables of the last version that was written whole."""
    version = spark.read.parquet(f"{path}/committed").agg(F.max("version")).first()[0]
    return [spark.read.parquet(f"{path}/tables/{name}/{version}") for name in names]
