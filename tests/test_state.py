"""Streams that keep state over restarts: nonces with timers and the pacer."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from adspectra.operators import pacing, parse
from adspectra.sources import files
from adspectra.streaming import jobs

HOUR = 3600
NOON = 1_705_320_000


def event(hours, nonce, ad):
    return json.dumps({"event_type": "click", "timestamp": NOON + int(hours * HOUR), "ad_id": ad, "nonce": nonce})


def test_nonces_in_a_stream_are_those_of_a_batch(spark, tmp_path):
    """A nonce used again after 23 hours is dropped and after 26 accepted, in one batch of a stream or over a restart."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [[event(0, "a", 1), event(0.01, "a", 2), event(0, "b", 3)], [event(23, "a", 4), event(23.9, "b", 5)], [event(26, "a", 6), event(26, "c", 7)], [event(49, "a", 8), event(51, "a", 9), event(51, "b", 10), event(51.5, "c", 11)]]
    for k, lines in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(lines))
        rows = files.file_stream(spark, str(source), 1).withColumn("nonce", F.get_json_object("value", "$.nonce"))
        found = jobs.deduplicated(parse.ad_events(rows).select("event_type", "nonce", "event_time", "ad_id"))
        found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    whole = spark.createDataFrame([(x, None) for lines in batches for x in lines], "value string, ingest_ts timestamp_ntz").withColumn("nonce", F.get_json_object("value", "$.nonce"))
    batch = parse.dedupe(parse.ad_events(whole).select("event_type", "nonce", "event_time", "ad_id"))
    assert sorted(r.ad_id for r in spark.read.parquet(out).collect()) == sorted(r.ad_id for r in batch.collect()) == [1, 3, 6, 7, 9, 10, 11]


def test_replays_of_a_nonce(spark):
    """Against a plain loop, with nonces of many events over several Arrow batches, null nonces and equal times."""
    import random

    rnd = random.Random(6)
    rows = [("click", rnd.choice(("x", "y", None, f"n{i % 40}")), NOON + rnd.randint(0, 200) * HOUR, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_type string, nonce string, s bigint, i int").select("event_type", "nonce", F.timestamp_seconds("s").cast("timestamp_ntz").alias("event_time"), "i")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = sorted(r.i for r in parse.dedupe(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, want = {}, []
    for _, nonce, at, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if at >= held.get(nonce, 0) + 24 * HOUR:
            held[nonce] = at
            want.append(i)
    assert got == sorted(want)
    assert parse.dedupe(df.limit(0)).count() == 0


FIELDS = "campaign_id bigint, now double, total_budget double, daily_budget double, spent double, spent_today double, start double, end double"


def test_pacer_over_restarts(spark, tmp_path):
    """Steps of a stream that is stopped and started again equal those of one run; a campaign's first state may be given."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rows = [(c, NOON + k * 600.0, 1000.0, 100.0, 9.0 * k * c, 4.0 * k * c if k % 5 else None, float(NOON), NOON + 86400.0) for k in range(12) for c in (1, 2)]
    initial = spark.createDataFrame([(2, 0.5, -1.0)], "campaign_id bigint, multiplier double, integral double")
    for n in range(3):
        spark.createDataFrame(rows[8 * n : 8 * n + 8], FIELDS).coalesce(1).write.parquet(str(source / f"{n}"))
        observed = spark.readStream.schema(FIELDS).parquet(str(source / "*"))
        jobs.paced(observed, initial=initial).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = {(r.campaign_id, r.now): (r.status, r.multiplier, r.integral) for r in spark.read.parquet(out).collect()}
    want, state = {}, {1: pacing.START, 2: (0.5, -1.0)}
    for r in rows:
        x = pacing.step(dict(zip([c.split()[0] for c in FIELDS.split(", ")], r, strict=True)) | {"multiplier": state[r[0]][0], "integral": state[r[0]][1]})
        state[r[0]] = (x["new_multiplier"], x["new_integral"])
        want[r[0], r[1]] = (x["status"], *state[r[0]])
    assert got == want


def test_step_is_the_same_for_columns(spark):
    """The step of sequences and streams gives what the step of columns gives."""
    rows = [(c, NOON + k * 3000.0, 1000.0, 100.0 * (c % 2), 90.0 * k * c, 30.0 * k if k % 4 else None, float(NOON), NOON + 86400.0, 0.1 + 0.3 * k, 0.5 * c - k) for k in range(8) for c in range(5)]
    names = FIELDS + ", multiplier double, integral double"
    for r in pacing.pi_step(spark.createDataFrame(rows, names)).collect():
        x = pacing.step({c.split()[0]: r[c.split()[0]] for c in names.split(", ")})
        assert r.status == x["status"] and [r[c] for c in ("error", "p_term", "i_term", "new_multiplier", "new_integral")] == pytest.approx([x[c] for c in ("error", "p_term", "i_term", "new_multiplier", "new_integral")])
