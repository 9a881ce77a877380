"""Simulated traffic: who asks, what is filled, seen and clicked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adspectra.functions.choice import draw, weighted


@dataclass(frozen=True)
class Traffic:
    """Weights of devices and countries, and the rates of impressions among fills and of clicks among impressions."""

    devices: dict[str, float] = field(default_factory=dict)
    countries: dict[str, float] = field(default_factory=dict)
    impression_rate: float = 0.95
    click_rate: float = 0.05
    seed: int = 0


def asked(requests: DataFrame, traffic: Traffic, key: str = "request_id", drawn: Callable[[str], Column] | None = None) -> DataFrame:
    """Adds device and country; ``drawn`` gives a draw for each purpose, by default from key and seed."""
    pick = drawn or (lambda purpose: draw(traffic.seed, key, F.lit(purpose)))
    country = weighted(pick("country"), traffic.countries, next(iter(traffic.countries), ""))
    return requests.withColumns({"device": weighted(pick("device"), traffic.devices, "desktop"), "country": country})


def followed(requests: DataFrame, served: DataFrame, traffic: Traffic, key: str = "request_id", drawn: Callable[[str], Column] | None = None) -> DataFrame:
    """Adds whether a request was filled (``served`` has its key), then seen, then clicked."""
    pick = drawn or (lambda purpose: draw(traffic.seed, key, F.lit(purpose)))
    rows = requests.join(served.select(key, F.lit(True).alias("__served")).distinct(), key, "left")
    fill = F.coalesce("__served", F.lit(False))
    seen = fill & (pick("impression") < traffic.impression_rate)
    return rows.withColumns({"fill": fill, "impression": seen, "click": seen & (pick("click") < traffic.click_rate)}).drop("__served")


def stages(rows: DataFrame, by: str) -> DataFrame:
    """Counts of each stage."""
    count = lambda c: F.count_if(F.col(c)).alias(f"{c}s")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), count("fill"), count("impression"), count("click"))
