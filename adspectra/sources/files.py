"""Readers and writers of the other formats, and message topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "key string, value string, ingest_ts timestamp_ntz"
#: A producer's settings. Fixed values.
PRODUCER = {"kafka.acks": "all", "kafka.compression.type": "snappy", "kafka.batch.size": "16384", "kafka.linger.ms": "100"}


def mapping_json(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """(left, right) pairs of a JSON object of texts; keys stay text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(left, right))


def flat_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, parent_id string, name string, tier int").json(path, multiLine=True)


def taxonomy_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All columns as text, no quoting; malformed lines are dropped."""
    return spark.read.csv(path, sep="\t", schema=schema, header=True, quote="", mode="DROPMALFORMED")


def day_partitioned(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Facts of a half-open time range; the days outside aren't read."""
    from adspectra.functions.timeutil import half_open, with_event_date

    return spark.read.parquet(path).where(with_event_date(start, end) & half_open("event_time", start, end))


def topic_stream(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest") -> DataFrame:
    """Messages of topics as key, value, ingest_ts; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", starting).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").cast("timestamp_ntz").alias("ingest_ts"))


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Messages from JSON-lines files that arrive in a folder, one message per line."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(F.lit(None).cast("string").alias("key"), "value", F.current_timestamp().cast("timestamp_ntz").alias("ingest_ts"))


def publish(df: DataFrame, servers: str, topic: str, key: str) -> None:
    """Writes rows as JSON messages; needs the Kafka connector."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value")).write.format("kafka").options(**PRODUCER).option("kafka.bootstrap.servers", servers).option("topic", topic).save()
