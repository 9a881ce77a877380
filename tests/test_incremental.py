"""Rollups refreshed from new batches against a full recompute."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from adspectra.plans import incremental, rollups
from adspectra.streaming.jobs import by_day

FACTS = {
    "impressions": "id bigint, event_time timestamp_ntz, ad_id bigint, campaign_id bigint, price_cents bigint",
    "clicks": "id bigint, event_time timestamp_ntz, ad_id bigint, campaign_id bigint, price_cents bigint",
    "auctions": "id bigint, event_time timestamp_ntz, winner_ad_id bigint, winning_bid_cents bigint, num_candidates bigint, num_filtered_budget bigint, num_filtered_targeting bigint, num_eligible bigint",
}


def batch(spark, n, days, seed):
    import datetime

    rnd, out = random.Random(seed), {}
    at = lambda: datetime.datetime(2024, 1, rnd.choice(days), rnd.randint(0, 3), rnd.randint(0, 59))
    for name in ("impressions", "clicks"):
        out[name] = spark.createDataFrame([(seed * 10_000 + i, at(), rnd.randint(1, 4), rnd.choice((1, 2, None)), rnd.randint(0, 90)) for i in range(n)], FACTS[name])
    rows = []
    for i in range(n):
        won = rnd.random() < 0.6
        rows.append((seed * 10_000 + i, at(), 7 if won else None, rnd.choice((10, 20, 35, None)) if won else 99, *(rnd.choice((None, 1, 2, 9)) for _ in range(4))))
    out["auctions"] = spark.createDataFrame(rows, FACTS["auctions"])
    return out


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)


def full(name, facts):
    if name == "auctions":
        return rollups.auction_metrics_hourly(facts["auctions"])
    return (rollups.ad_metrics_hourly if name == "ads" else rollups.campaign_metrics_hourly)(facts["impressions"], facts["clicks"])


@pytest.mark.parametrize(("name", "rollup"), [("ads", incremental.AD_METRICS), ("campaigns", incremental.CAMPAIGN_METRICS), ("auctions", incremental.AUCTION_METRICS)])
def test_refresh_equals_a_full_recompute(spark, tmp_path, name, rollup):
    """After new days, late hours of old days, a repeated refresh and one that stopped before its mark."""
    path, stored = str(tmp_path / "rollup"), {x: str(tmp_path / x) for x in rollup.facts}
    read = lambda: {x: spark.read.parquet(stored[x]) for x in rollup.facts}
    for number, (n, days) in enumerate([(60, (1, 2)), (40, (3,)), (30, (1, 3)), (20, (2, 4))]):
        for x, df in batch(spark, n, days, number + 1).items():
            if x in rollup.facts:
                by_day(stored[x])(df, number)
        if number == 2:  # parts were written, the mark wasn't
            half = rollup.state(incremental.fresh(rollup, read(), 1)).withColumns({"event_date": F.to_date("hour"), "upto": F.lit(2).cast("bigint")})
            half.write.mode("append").partitionBy("event_date", "upto").parquet(f"{path}/parts")
            assert incremental.mark(spark, path) == 1
        assert incremental.refresh(rollup, read(), path) == number
        assert incremental.refresh(rollup, read(), path) == number
        assert rows_of(incremental.measures(rollup, spark, path)) == rows_of(full(name, read()))
    incremental.merge_parts(rollup, spark, path)
    assert rows_of(incremental.measures(rollup, spark, path)) == rows_of(full(name, read()))
    assert spark.read.parquet(f"{path}/parts").select("upto").distinct().count() == 1 and incremental.mark(spark, path) == 3
    assert incremental.refresh(rollup, read(), path) == 3


def test_only_new_batches_are_read(spark, tmp_path):
    for number in range(3):
        by_day(str(tmp_path / "a"))(batch(spark, 20, (1, 2), number + 1)["auctions"], number)
    new = incremental.fresh(incremental.AUCTION_METRICS, {"auctions": spark.read.parquet(str(tmp_path / "a"))}, 1)["auctions"]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan and {f.rsplit("batch_id=")[1][0] for f in new.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} == {"2"}
