"""Parsers of event messages (JSON text), for batch and stream alike.

Each gives typed rows of the readable messages; ``dead_letters`` gives the others.  Numbers may
come as text; a missing field takes its default; one that can't be read makes the message unreadable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspectra.functions.ratios import to_cents
from adspectra.functions.timeutil import event_time

AD_EVENTS = ("impression", "click")
#: Whole numbers without which a message can't be used.
AD_NUMBERS = ("ad_id", "campaign_id", "price_cents")
AUCTION_NUMBERS = ("num_of_candidates", "num_filtered_budget", "num_filtered_targeting", "num_eligible")
PACING_KEYS = ("campaign_id", "remaining_days")
NONCE_HOURS = 24
PACING_MONEY = ("total_budget", "daily_budget", "remaining_budget", "spent_today", "effective_target")
PACING_NUMBERS = ("campaign_time_factor", "daily_time_factor", "kp", "ki", "min_multiplier", "max_multiplier", "error_normalized", "p_term", "i_term", "urgency", "adjustment", "cumulative_error", "previous_multiplier", "new_multiplier")


def _field(name: str) -> Column:
    return F.try_variant_get("__message", f"$.{name}", "string")


def _text(name: str) -> Column:
    return F.coalesce(_field(name), F.lit(""))


def _whole(name: str) -> Column:
    """A whole number, 0 if missing, null if unreadable; fractions are cut."""
    v = _field(name)
    return F.when(v.isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(v.try_cast("bigint"), v.try_cast("double").try_cast("bigint")))


def _number(name: str) -> Column:
    v = _field(name)
    return F.when(v.isNull(), F.lit(0.0)).otherwise(v.try_cast("double"))


def _read(messages: DataFrame) -> DataFrame:
    """The messages with ``__message``: the object each holds, read once; null where it holds none.

    The parsed value goes through ``inline``, which no filter is moved below: else each condition on a field would parse the message again.
    """
    parsed = messages.select("*", F.inline(F.array(F.struct(F.try_parse_json("value").alias("__message")))))
    return parsed.withColumn("__message", F.when(F.schema_of_variant("__message").startswith("OBJECT"), F.col("__message")))


def _unreadable(numbers: tuple[str, ...]) -> Column:
    """Whether the message is no object or one of its whole numbers can't be read."""
    bad = F.col("__message").isNull()
    for n in numbers:
        bad = bad | _whole(n).isNull()
    return bad


def _objects(messages: DataFrame, numbers: tuple[str, ...]) -> DataFrame:
    return _read(messages).where(~_unreadable(numbers))


def ad_events(messages: DataFrame, ingested: str = "ingest_ts") -> DataFrame:
    """Impressions and clicks; other event types are no ad events. messages: value, and the ingest time."""
    rows = _objects(messages, AD_NUMBERS).select(
        F.lower(_field("event_type")).alias("event_type"),
        event_time(_field("timestamp"), F.col(ingested)).alias("event_time"),
        *(_whole(x).alias(x) for x in AD_NUMBERS),
        *(_text(x).alias(x) for x in ("auction_id", "publisher_id", "page_url", "click_url", "device_type", "user_agent", "ip_address")),
        *(c for c in messages.columns if c not in ("value", ingested)),
    )
    return rows.where(F.col("event_type").isin(*AD_EVENTS))


def auction_events(messages: DataFrame, ingested: str = "ingest_ts") -> DataFrame:
    """Auctions with the winner's fields, null without a winner. The winning bid is its eCPM in cents, cut."""
    has = _field("winner").isNotNull()
    bid = F.when(has, F.coalesce(_field("winner.effective_bid").try_cast("double"), F.lit(0.0)))
    return _objects(messages, AUCTION_NUMBERS).select(
        event_time(_field("timestamp"), F.col(ingested)).alias("event_time"),
        *(_text(x).alias(x) for x in ("auction_id", "publisher_id", "page_url", "device_type", "user_agent", "ip_address")),
        _whole("num_of_candidates").alias("num_candidates"),
        *(_whole(x).alias(x) for x in ("num_filtered_budget", "num_filtered_targeting", "num_eligible")),
        *(_field(f"winner.{x}").try_cast("bigint").alias(f"winner_{x}") for x in ("ad_id", "campaign_id")),
        to_cents(bid).alias("winning_bid_cents"),
        _field("winner.effective_bid").try_cast("double").alias("winning_effective_bid"),
        _field("winner.final_rank_score").try_cast("double").alias("winning_final_score"),
        *(c for c in messages.columns if c not in ("value", ingested)),
    )


def pacing_events(messages: DataFrame, ingested: str = "ingest_ts") -> DataFrame:
    return _objects(messages, PACING_KEYS).select(
        event_time(_field("timestamp"), F.col(ingested)).alias("event_time"),
        _whole("campaign_id").alias("campaign_id"),
        *(to_cents(_number(x)).alias(f"{x}_cents") for x in PACING_MONEY),
        _whole("remaining_days").alias("remaining_days"),
        *(_number(x).alias(x) for x in PACING_NUMBERS),
        _text("status").alias("status"),
        *(c for c in messages.columns if c not in ("value", ingested)),
    )


def dead_letters(messages: DataFrame, numbers: tuple[str, ...] = AD_NUMBERS) -> DataFrame:
    """Messages that are no JSON objects, or of which a whole number can't be read: no parser gives a row for them."""
    return _read(messages).where(_unreadable(numbers)).drop("__message")


def split_ad_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(impressions, clicks); an empty address becomes null."""
    rows = events.withColumn("ip_address", F.nullif("ip_address", F.lit("")))
    return rows.where("event_type = 'impression'").drop("event_type", "click_url"), rows.where("event_type = 'click'").drop("event_type")


def dedupe(events: DataFrame, keys: tuple[str, ...] = ("event_type", "nonce"), time: str = "event_time", hours: int = NONCE_HOURS) -> DataFrame:
    """The events whose nonce isn't held: an accepted event holds its nonce for some hours, and later ones are dropped.

    Events count in order of time, then of their other columns.  One that comes so many hours after the one before it, or is its nonce's first, is
    accepted whatever came before; the others are read in order, with the time that holds their nonce as all that is kept.  So a task's
    memory doesn't grow with the replays of a nonce.
    """
    rest = [c for c in events.columns if c not in (*keys, time)]
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time, *rest))
    fresh = before.isNull() | (F.col(time) >= before + F.expr(f"interval {int(hours)} hours"))
    ordered = events.withColumns({"__fresh": fresh, "__at": F.unix_micros(F.col(time).cast("timestamp"))})
    span, columns = int(hours) * 3_600_000_000, events.columns

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            fresh, at = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("__fresh", "__at"))
            keep = fresh.astype(bool)
            for k in np.flatnonzero(~keep).tolist():  # the row before is the same nonce's
                if k and keep[k - 1]:
                    held = at[k - 1]
                keep[k] = at[k] >= held + span
            if len(keep) and keep[-1]:
                held = at[-1]
            yield batch.filter(pa.array(keep)).select(columns)

    return ordered.mapInArrow(accepted, events.schema)
