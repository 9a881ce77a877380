"""Budget pacing: hard caps and a proportional-integral controller, as column expressions.

A step reads one campaign's state and gives its next multiplier; ``run_steps`` folds a campaign's
ordered observations, one group of bounded size (the controller's ticks) per campaign.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspectra.functions.ratios import to_cents


@dataclass(frozen=True)
class Config:
    """Fixed default values of the controller."""

    kp: float = 0.15
    ki: float = 0.04
    least: float = 0.10
    most: float = 2.0
    most_integral: float = 5.0
    rise: float = 0.08
    fall: float = 0.04


LEAST_DAY, LEAST_TARGET, MOST_ERROR = 0.05, 0.01, 1.5
PUBLISHED = ("ok", "budget_exhausted")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def multipliers(campaigns: DataFrame, states: DataFrame, spend: DataFrame, daily: DataFrame) -> DataFrame:
    """campaign_id, multiplier: 1 without a state, 0 once a budget is spent, else the state's.

    states: campaign_id, total_budget, daily_budget (dollar strings), current_multiplier; spend and daily: campaign_id, spend_cents.
    """
    s = states.select("campaign_id", to_cents(F.col("total_budget")).alias("total"), to_cents(F.col("daily_budget")).alias("day"), "current_multiplier", F.lit(True).alias("has"))
    rows = campaigns.select("campaign_id").distinct().join(s, "campaign_id", "left").join(spend.select("campaign_id", F.col("spend_cents").alias("spent")), "campaign_id", "left").join(daily.select("campaign_id", F.col("spend_cents").alias("today")), "campaign_id", "left")
    over = lambda spent, cap: (F.coalesce(cap, F.lit(0)) > 0) & (F.coalesce(spent, F.lit(0)) >= cap)
    value = F.when(F.col("has").isNull(), F.lit(1.0)).when(over(F.col("spent"), F.col("total")) | over(F.col("today"), F.col("day")), F.lit(0.0)).otherwise(F.col("current_multiplier"))
    return rows.select("campaign_id", value.alias("multiplier"))


def day_share(now: Column) -> Column:
    """Elapsed share of the UTC day; now in Unix seconds."""
    return F.pmod(now.cast("double"), F.lit(86400.0)) / 86400.0


def campaign_share(start: Column, end: Column, now: Column) -> Column:
    length = end.cast("double") - start.cast("double")
    return F.when(length <= 0, F.lit(1.0)).otherwise(clamp((now - start) / F.nullif(length, F.lit(0.0)), 0, 1))


def urgency(campaign: Column, day: Column) -> Column:
    return 0.3 * (1 + campaign * campaign) + 0.7 * (1 + day * day)


def pi_step(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """One controller step per row.

    Needs total_budget, daily_budget, spent, spent_today (dollars), start, end, now (Unix seconds),
    multiplier and integral; a null state (total_budget) or null spent gives no_state or no_metrics.
    Adds status, error, target, urgency, p_term, i_term, adjustment, new_multiplier, new_integral.
    """
    c = F.col
    today = F.coalesce(c("spent_today"), F.lit(0.0))
    left = c("total_budget") - c("spent")
    exhausted = (left <= 0) | ((c("daily_budget") > 0) & c("spent_today").isNotNull() & (today >= c("daily_budget")))
    hours = F.greatest(F.lit(1.0), F.greatest(F.lit(0.0), c("end") - c("now")) / 3600.0)
    ideal = left / hours * 24
    day = day_share(c("now"))
    rows = rows.withColumn("target", F.when(c("daily_budget") > 0, F.least(ideal, c("daily_budget"))).otherwise(ideal) * F.greatest(F.lit(LEAST_DAY), day))
    status = F.when(c("total_budget").isNull(), "no_state").when(c("spent").isNull(), "no_metrics").when(exhausted, "budget_exhausted").when(c("target") < LEAST_TARGET, "target_too_low").otherwise("ok")
    rows = rows.withColumn("status", status)
    ok = c("status") == "ok"
    error = clamp((c("target") - today) / F.nullif(c("target"), F.lit(0.0)), -MOST_ERROR, MOST_ERROR)
    rows = rows.withColumn("error", F.when(ok, error).when(c("status") == "budget_exhausted", F.lit(-1.0)).otherwise(F.lit(0.0))).withColumn("urgency", F.when(ok, urgency(campaign_share(c("start"), c("end"), c("now")), day)))
    frozen = ((c("multiplier") >= config.most) & (c("error") > 0)) | ((c("multiplier") <= config.least) & (c("error") < 0))
    rows = rows.withColumn("new_integral", F.when(ok & ~frozen, clamp(c("integral") + c("error"), -config.most_integral, config.most_integral)).otherwise(c("integral")))
    rows = rows.withColumn("p_term", F.when(ok, config.kp * c("error") * c("urgency")).otherwise(F.lit(0.0))).withColumn("i_term", F.when(ok, config.ki * c("new_integral") * c("urgency")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("adjustment", clamp(c("p_term") + c("i_term"), -0.5, 1.0))
    width = config.most - config.least
    moved = c("multiplier") + F.greatest(F.lit(-config.fall * width), F.least(F.lit(config.rise * width), c("adjustment")))
    new = F.when(ok, clamp(moved, config.least, config.most)).when(c("status") == "budget_exhausted", F.lit(0.0)).when(c("status") == "target_too_low", c("multiplier")).otherwise(F.lit(1.0))
    return rows.withColumn("new_multiplier", new)


def step(state: dict, config: Config = Config()) -> dict:
    """``pi_step`` for one campaign in plain Python, for sequences and streams; same keys."""
    s = dict(state)
    today = s["spent_today"] or 0.0
    left = s["total_budget"] - s["spent"]
    out = {"p_term": 0.0, "i_term": 0.0, "adjustment": 0.0, "new_integral": s["integral"]}
    if left <= 0 or (s["daily_budget"] > 0 and s["spent_today"] is not None and today >= s["daily_budget"]):
        return out | {"status": "budget_exhausted", "error": -1.0, "new_multiplier": 0.0}
    day = s["now"] % 86400 / 86400
    ideal = left / max(1.0, max(0.0, s["end"] - s["now"]) / 3600) * 24
    target = (min(ideal, s["daily_budget"]) if s["daily_budget"] > 0 else ideal) * max(LEAST_DAY, day)
    if target < LEAST_TARGET:
        return out | {"status": "target_too_low", "error": 0.0, "new_multiplier": s["multiplier"]}
    error = max(-MOST_ERROR, min(MOST_ERROR, (target - today) / target))
    length = s["end"] - s["start"]
    share = 1.0 if length <= 0 else max(0.0, min(1.0, (s["now"] - s["start"]) / length))
    u = 0.3 * (1 + share**2) + 0.7 * (1 + day**2)
    prev = s["multiplier"]
    if not (prev >= config.most and error > 0 or prev <= config.least and error < 0):
        out["new_integral"] = max(-config.most_integral, min(config.most_integral, s["integral"] + error))
    out["p_term"], out["i_term"] = config.kp * error * u, config.ki * out["new_integral"] * u
    out["adjustment"] = max(-0.5, min(1.0, out["p_term"] + out["i_term"]))
    width = config.most - config.least
    moved = prev + max(-config.fall * width, min(config.rise * width, out["adjustment"]))
    return out | {"status": "ok", "error": error, "new_multiplier": max(config.least, min(config.most, moved))}


STEPS = "campaign_id bigint, now double, status string, error double, p_term double, i_term double, multiplier double, integral double"


#: Multiplier and integral of a campaign that has no state yet.
START = (1.0, 0.0)


def folded(campaign: int, rows: pd.DataFrame, state: tuple[float, float], config: Config = Config()) -> tuple[pd.DataFrame, tuple[float, float]]:
    """One campaign's steps over its observations in order of ``now``, and the state after them."""
    out = []
    for r in rows.sort_values("now", kind="stable").to_dict("records"):
        x = step({**r, "spent_today": None if pd.isna(r["spent_today"]) else r["spent_today"], "multiplier": state[0], "integral": state[1]}, config)
        state = (x["new_multiplier"], x["new_integral"])
        out.append((campaign, r["now"], x["status"], x["error"], x["p_term"], x["i_term"], *state))
    return pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")]), state


def run_steps(observations: DataFrame, config: Config = Config()) -> DataFrame:
    """Each campaign's controller over its observations in order of ``now``."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return folded(key[0], rows, START, config)[0]

    return observations.groupBy("campaign_id").applyInPandas(fold, STEPS)


def published(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("status").isin(*PUBLISHED))
