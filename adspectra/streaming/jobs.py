"""Streaming jobs: parse, deduplicate, count in windows, write by day, pace.

Windows are over event time with a watermark; the reference point of processing time has no
counterpart here.  Sinks write under the batch's number, so a batch that is repeated after a
failure replaces its own rows instead of adding them twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from adspectra.operators import parse
from adspectra.operators.pacing import START, Config, folded
from adspectra.operators.parse import NONCE_HOURS

SINK_SECONDS, WINDOW_SECONDS, LATENESS, CHECKPOINT_SECONDS = 5, 10, "1 minute", 60
#: How late an event of a nonce may come.
NONCE_LATENESS = "1 hour"


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need timestamps with a zone; the session's is UTC."""
    return events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late) if events.isStreaming else events


def _windowed(events: DataFrame, key: str) -> DataFrame:
    events = _watermarked(events, LATENESS)
    return events.groupBy(F.window("event_time", f"{WINDOW_SECONDS} seconds").alias("w"), key)


def _measures() -> list:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return [kind("impression").alias("impressions"), kind("click").alias("clicks"), F.sum("price_cents").alias("spend_cents")]


def ad_metrics(events: DataFrame) -> DataFrame:
    """Per window and ad: counts, spend of impressions and clicks, and the first campaign that isn't 0."""
    rows = _windowed(events, "ad_id").agg(*_measures(), F.min_by(F.nullif("campaign_id", F.lit(0)), F.when(F.col("campaign_id") != 0, F.col("event_time"))).alias("campaign_id"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "ad_id", F.coalesce("campaign_id", F.lit(0)).alias("campaign_id"), "impressions", "clicks", "spend_cents")


def campaign_metrics(events: DataFrame) -> DataFrame:
    rows = _windowed(events, "campaign_id").agg(*_measures())
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "campaign_id", "impressions", "clicks", "spend_cents")


def counters(events: DataFrame) -> DataFrame:
    """Running totals of each campaign and UTC day."""
    return events.groupBy("campaign_id", F.to_date("event_time").alias("day")).agg(*_measures())


def timed_state(spark: SparkSession) -> None:
    """State by key and timers are kept by RocksDB; streams started before keep the store that their checkpoint names."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class NonceHolder(StatefulProcessor):
    """Keeps for each nonce when its last accepted event was, until a timer of event time lets it go."""

    def __init__(self, columns: list[str], time: str = "event_time", hours: int = NONCE_HOURS):
        self.columns, self.time, self.hours = columns, time, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "until_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        until = self.held.get()[0] if self.held.exists() else None
        before, kept = until, []
        batch = pd.concat(list(rows)).sort_values([self.time, *(c for c in self.columns if c != self.time)], kind="stable")
        for at in (batch[self.time].astype("datetime64[us]").astype("int64") // 1000).tolist():
            kept.append(until is None or at >= until)
            if kept[-1]:
                until = at + self.hours * 3_600_000
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.held.update((until,))
            self.handle.registerTimer(until)
        yield batch.loc[kept, self.columns]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def deduplicated(events: DataFrame, late: str = NONCE_LATENESS, hours: int = NONCE_HOURS) -> DataFrame:
    """The events whose type and nonce no accepted event holds, as ``parse.dedupe`` gives them.

    In a stream events of a nonce count in order of time within a batch, and over batches as they come; those later than ``late`` are dropped.
    """
    if not events.isStreaming:
        return parse.dedupe(events, hours=hours)
    timed_state(events.sparkSession)
    marked = _watermarked(events, late)
    return marked.groupBy("event_type", "nonce").transformWithStateInPandas(NonceHolder(marked.columns, "event_time", hours), marked.schema, "append", "eventTime", eventTimeColumnName="event_time")


def by_day(path: str, batches: str = "batch_id") -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: Parquet by day and batch; a repeated batch replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        dated = rows.withColumn("event_date", F.to_date("event_time")).withColumn(batches, F.lit(batch))
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", batches).parquet(path)

    return write


def ad_event_sink(impressions: str, clicks: str, dead: str | None = None) -> Callable[[DataFrame, int], None]:
    """Parses a batch of messages and writes impressions, clicks and unreadable messages."""

    def write(messages: DataFrame, batch: int) -> None:
        messages = messages.persist()
        try:
            seen, clicked = parse.split_ad_events(parse.ad_events(messages))
            by_day(impressions)(seen, batch)
            by_day(clicks)(clicked, batch)
            if dead:
                parse.dead_letters(messages).withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(dead)
        finally:
            messages.unpersist()

    return write


def start(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, seconds: int = SINK_SECONDS) -> StreamingQuery:
    trigger: dict[str, Any] = {"availableNow": True} if once else {"processingTime": f"{seconds} seconds"}
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ad_event_job(messages: DataFrame, impressions: str, clicks: str, checkpoint: str, dead: str | None = None, once: bool = False) -> StreamingQuery:
    return start(messages, ad_event_sink(impressions, clicks, dead), checkpoint, once)


def auction_job(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return start(messages, lambda rows, batch: by_day(path)(parse.auction_events(rows), batch), checkpoint, once)


def pacing_job(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    return start(messages, lambda rows, batch: by_day(path)(parse.pacing_events(rows), batch), checkpoint, once)


def counter_job(messages: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps what each batch adds to the counters; a repeated batch replaces what it added."""

    def write(rows: DataFrame, batch: int) -> None:
        added = counters(parse.ad_events(rows)).withColumn("batch_id", F.lit(batch))
        added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return start(messages, write, checkpoint, once)


def counter_totals(added: DataFrame) -> DataFrame:
    """The counters of each campaign and day over all batches."""
    return added.groupBy("campaign_id", "day").agg(*(F.sum(c).alias(c) for c in ("impressions", "clicks", "spend_cents")))


def printed(rows: DataFrame, lines: int = 20) -> StreamingQuery:
    """Shows the changed rows of a stream on the console."""
    return rows.writeStream.format("console").outputMode("update").option("numRows", lines).option("truncate", False).start()


class Pacer(StatefulProcessor):
    """Keeps each campaign's multiplier and integral; every observation is one controller step. A campaign without state starts from the given one, else at 1 and 0."""

    OUTPUT = "campaign_id bigint, now double, status string, error double, p_term double, i_term double, multiplier double, integral double"

    def __init__(self, config: Config = Config()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("pacing", "multiplier double, integral double")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.state.update((float(initialState["multiplier"].iloc[0]), float(initialState["integral"].iloc[0])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        began = tuple(self.state.get()) if self.state.exists() else START
        steps, last = folded(key[0], pd.concat(list(rows)), began, self.config)
        self.state.update(last)
        yield steps

    def close(self) -> None:
        pass


def paced(observations: DataFrame, config: Config = Config(), initial: DataFrame | None = None) -> DataFrame:
    """A stream of observations (campaign_id, now and a step's inputs) to a stream of controller steps; initial: campaign_id, multiplier, integral."""
    timed_state(observations.sparkSession)
    given = initial.groupBy("campaign_id") if initial is not None else None
    return observations.groupBy("campaign_id").transformWithStateInPandas(Pacer(config), Pacer.OUTPUT, "append", "none", initialState=given)
