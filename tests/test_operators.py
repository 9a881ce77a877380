from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adspectra import schemas
from adspectra.functions import choice, timeutil, web
from adspectra.operators import geo, merge, pacing, parse, similarity, targeting, taxonomy, textprep, traffic
from adspectra.plans import rollups
from adspectra.sources import files
from adspectra.streaming import jobs

NOW = dt.datetime(2024, 6, 1)


def parsed(spark, function, *values):
    return function(spark.createDataFrame([(v, NOW) for v in values], "value string, ingest_ts timestamp_ntz"))


def test_ad_events(spark):
    good = {"event_type": "CLICK", "ad_id": "7", "campaign_id": 3, "timestamp": 1704067200, "price_cents": 12}
    values = [json.dumps(good | x) for x in ({}, {"timestamp": 1704067200000}, {"timestamp": "2024-01-01T00:00:00"}, {"timestamp": 0}, {"timestamp": "soon"}, {"event_type": "view"}, {"ad_id": "x"}, {"price_cents": None, "ip_address": ""})]
    rows = parsed(spark, parse.ad_events, *values, "{broken", "[1]", None).collect()
    first = dt.datetime(2024, 1, 1)
    assert [r.event_time for r in rows] == [first, first, first, NOW, NOW, first]
    assert all(r.ad_id == 7 and r.event_type == "click" for r in rows) and [r.price_cents for r in rows][-1] == 0
    dead = parsed(spark, parse.dead_letters, *values, "{broken", "[1]", None).collect()
    assert [r.value for r in dead] == [values[6], "{broken", "[1]", None]  # an id that is no number is lost to no one
    assert parsed(spark, lambda m: parse.dead_letters(m, parse.PACING_KEYS), '{"campaign_id": 1}', '{"campaign_id": "x"}').count() == 1
    seen, clicked = parse.split_ad_events(parsed(spark, parse.ad_events, *values))
    assert seen.count() == 0 and clicked.count() == 6 and clicked.where("ip_address is null").count() == 6


def test_auction_and_pacing_events(spark):
    won = json.dumps({"auction_id": "a", "winner": {"ad_id": 1, "effective_bid": 12.349}, "num_of_candidates": 3, "timestamp": "2024-01-01T00:00:00"})
    none = json.dumps({"auction_id": "b", "winner": None})
    rows = parsed(spark, parse.auction_events, won, none).collect()
    assert [(r.winner_ad_id, r.winning_bid_cents, r.num_candidates) for r in rows] == [(1, 1234, 3), (None, None, 0)]
    row = parsed(spark, parse.pacing_events, json.dumps({"campaign_id": "4", "total_budget": 10.999, "new_multiplier": 1.5, "status": "ok"})).first()
    assert (row.campaign_id, row.total_budget_cents, row.effective_target_cents, row.new_multiplier) == (4, 1099, 0, 1.5)


def test_urls_and_signatures(spark):
    cases = {"https://https://Example.COM/a/": "https://example.com/a", "HTTP://x.y/Path//?q=A#f": "http://x.y/Path?q=A#f", "http://x.y": "http://x.y", "http://http://http://x/": "http://x"}
    df = spark.createDataFrame(list(cases.items()), "u string, e string").select(web.canonical_url(F.col("u")).alias("c"), web.url_hash(F.col("u")).alias("h"), "e")
    for r in df.collect():
        assert r.c == r.e and r.h == hashlib.sha256(r.e.encode()).hexdigest()
    for secret in ("k", "s" * 100):
        got = spark.createDataFrame([("a=1&b=2",)], "p string").select(web.hmac_sha256(F.col("p"), secret).alias("m")).first().m
        assert got == hmac.new(secret.encode(), b"a=1&b=2", "sha256").hexdigest()


def test_buckets():
    a = dt.datetime(2024, 1, 1)
    seconds = lambda **x: timeutil.bucket_seconds(a, a + dt.timedelta(**x))
    assert [seconds(hours=1), seconds(), seconds(seconds=599), seconds(seconds=600), seconds(seconds=900, milliseconds=999), seconds(days=30), seconds(days=400)] == [15, 1, 1, 2, 5, 14400, 86400]
    assert [timeutil.bucket_label(s) for s in (30, 60, 7200)] == ["30s", "1m", "2h"]


def test_nonces_expire(spark):
    day, at = dt.timedelta(days=1), dt.datetime(2024, 1, 1)
    times = [at, at + day / 2, at + day, at + day * 1.4, at + day * 2.5, at]
    rows = [("click", "n", t, k) for k, t in enumerate(times)] + [("impression", "n", at, 9), ("click", "m", at, 8)]
    events = spark.createDataFrame(rows, "event_type string, nonce string, event_time timestamp_ntz, id int").repartition(3)
    assert sorted(r.id for r in jobs.deduplicated(events).collect()) == [0, 2, 4, 8, 9]


def test_statuses(spark):
    rows = [("a", s, 100, None, 5, m, 1, None) for s in ("active", "ARCHIVED", "PENDING_ANALYSIS", "", None, "PENDING") for m in ("cpm", "", "CPA")]
    names = "name string, status string, total_budget int, daily_budget_cents int, bid_amount_cents int, pricing_model string, start_date int, end_date int"
    got = [tuple(r.p) for r in spark.createDataFrame(rows, names).select(schemas.campaign_problems().alias("p")).collect()]
    want = [(("status is unknown",) if s == "PENDING" else ()) + (("pricing model is unknown",) if m == "CPA" else ()) for s in ("a", "A", "P", "", None, "PENDING") for m in ("cpm", "", "CPA")]
    assert got == want
    ads = spark.createDataFrame([(1, "PENDING_ANALYSIS"), (2, "PENDING_ANALYSIS"), (3, "PAUSED")], "id int, status string")
    done = spark.createDataFrame([(1,), (1,), (3,)], "ad_id int")
    assert sorted(map(tuple, merge.activated(ads, done).collect())) == [(1, "ACTIVE"), (2, "PENDING_ANALYSIS"), (3, "PAUSED")]


PI = "total_budget double, daily_budget double, spent double, spent_today double, start double, end double, now double, multiplier double, integral double"
NOON = 1700000000 // 86400 * 86400 + 43200.0


@pytest.mark.parametrize(("today", "multiplier", "integral", "expected"), [(20.0, 1.0, 0.0, 1.1425), (90.0, 1.0, 0.0, 0.924), (49.0, 1.0, 0.0, 1.00475), (0.0, 2.0, 1.0, 2.0)])
def test_pi_step(spark, today, multiplier, integral, expected):
    row = (1000.0, 100.0, 250.0 if today else 0.0, today, NOON - 5 * 86400, NOON + 5 * 86400, NOON, multiplier, integral)
    got = pacing.pi_step(spark.createDataFrame([row], PI)).first()
    plain = pacing.step(dict(zip([c.split()[0] for c in PI.split(", ")], row, strict=True)))
    assert got.new_multiplier == pytest.approx(expected) and plain["new_multiplier"] == pytest.approx(expected)
    assert got.new_integral == pytest.approx(plain["new_integral"]) and got.status == plain["status"] == "ok"


def test_pi_states(spark):
    base = [1000.0, 100.0, 250.0, 20.0, 0.0, 0.0, NOON, 0.7, 0.1]
    rows = [base, [None, *base[1:]], [1000.0, 100.0, None, *base[3:]], [100.0, *base[1:]], [1000.0, 10.0, *base[2:]], [250.0001, *base[1:]]]
    got = [r.status for r in pacing.pi_step(spark.createDataFrame([tuple(r) for r in rows], PI)).collect()]
    assert got == ["ok", "no_state", "no_metrics", "budget_exhausted", "budget_exhausted", "target_too_low"]


def test_candidates(spark):
    index = spark.createDataFrame([("keyword", "a", 1), ("keyword", "a", 2), ("topic", "9", 3), ("country", "US", 1), ("device", "mobile", 2)], targeting.INDEX)
    keys = spark.createDataFrame([(1, "keyword", "a"), (1, "topic", "9"), (2, "keyword", "A")], "page_id int, dim string, key string")
    req = spark.createDataFrame([(1, 1, "US", "desktop"), (2, 1, "FR", "mobile"), (3, 2, "FR", "tv")], "request_id int, page_id int, country string, device string")
    assert sorted(map(tuple, targeting.find_candidates(req, keys, index).collect())) == [(1, 1), (2, 2)]
    only = spark.createDataFrame([(2,), (3,)], "ad_id int")
    # Without ad 1 no ad targets a country, so none filters by it.
    assert sorted(map(tuple, targeting.find_candidates(req, keys, index, only).collect())) == [(1, 2), (1, 3), (2, 2)]
    nulls = spark.createDataFrame([(9, 1, None, None)], req.schema)
    assert sorted(map(tuple, targeting.find_candidates(nulls, keys, index).collect())) == [(9, 1), (9, 2), (9, 3)]
    fresh = targeting.refresh_index(index, spark.createDataFrame([(1,), (3,)], "ad_id int"), spark.createDataFrame([("keyword", "b", 1)], targeting.INDEX))
    assert sorted(map(tuple, fresh.collect())) == [("device", "mobile", 2), ("keyword", "a", 2), ("keyword", "b", 1)]


def test_active(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, "active", day(1), None), (2, "ACTIVE", day(1), day(9)), (3, "ACTIVE", day(1), day(5)), (4, "ACTIVE", day(6), None), (5, "PAUSED", day(1), None), (6, "ACTIVE", day(5), day(9))]
    df = spark.createDataFrame(rows, "id int, status string, start_date timestamp_ntz, end_date timestamp_ntz")
    ids = lambda **k: [r.id for r in df.where(targeting.active_at(timeutil.moment(day(5)), **k)).orderBy("id").collect()]
    assert ids() == [1, 2] and ids(closed=True) == [1, 2, 3, 6]


def test_similarity_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "i bigint, embedding array<double>")
    got = {(r.q, r.i): r.similarity for r in similarity.similarities(v.withColumnRenamed("i", "q"), v, "q", "i", None).collect()}
    assert len(got) == 9 and got[1, 2] == 0 and got[1, 3] == pytest.approx(2**-0.5)
    assert similarity.knn(v.limit(0).withColumnRenamed("i", "q"), v, "q", "i", 2).count() == 0


def test_taxonomy(spark):
    tree = [{"id": "1", "name": "a", "tier": 1, "children": [{"id": "3", "name": "c", "tier": 2}]}, {"id": "2", "name": "b", "tier": 1}]
    flat = taxonomy.flat_taxonomy(spark, tree)
    rows = [tuple(r) for r in flat.collect()]
    assert rows == [("1", None, "a", 1), ("2", None, "b", 1), ("3", "1", "c", 2)]
    assert taxonomy.nested(rows) == [{"id": "1", "name": "a", "tier": 1, "children": [{"id": "3", "name": "c", "tier": 2, "children": []}]}, {"id": "2", "name": "b", "tier": 1, "children": []}]
    assert taxonomy.flat_taxonomy(spark, []).count() == 0


def test_twelve_tiers(spark):
    node = None
    for k in range(12, 0, -1):
        node = {"id": str(k), "name": f"n{k}", "tier": k, "children": [node] if node else []}
    flat = taxonomy.flat_taxonomy(spark, [node])
    got = taxonomy.with_paths(flat).orderBy("tier").collect()
    assert [r.id for r in got] == [str(k) for k in range(1, 13)] and got[-1].path == [f"n{k}" for k in range(1, 13)]


def test_paths_without_root(spark):
    """Nodes on a cycle, below one, or below a missing node have no path; a node that is its own parent is a root."""
    rows = [("1", None, "a", 1), ("2", "1", "b", 2), ("s", "s", "s", 1), ("x", "y", "x", 2), ("y", "z", "y", 2), ("z", "x", "z", 2), ("c", "x", "c", 3), ("o", "gone", "o", 3), ("p", "o", "p", 4)]
    got = taxonomy.with_paths(spark.createDataFrame(rows, taxonomy.FLAT))
    assert got.columns == ["id", "parent_id", "name", "tier", "path"]
    assert sorted((r.id, r.path) for r in got.collect()) == [("1", ["a"]), ("2", ["a", "b"]), ("s", ["s"])]


def brute_chunks(units, least, most):
    """Short units take the next one in; then sentences are filled up to ``most`` tokens."""
    words = lambda s: len(s.split())
    groups, k = [], 0
    while k < len(units):
        groups.append(units[k : k + 1 + (words(units[k]) < least)])
        k += len(groups[-1])
    if len(groups) > 1 and words(" ".join(groups[-1])) < least:
        groups[-2:] = [groups[-2] + groups[-1]]
    out = []
    for text in map(" ".join, groups):
        parts = [[]] if words(text) * 3 // 4 > most else [[text]]
        for s in re.split(r"(?<=[.!?])\s+", text) if not parts[0] else ():
            if parts[-1] and sum(words(x) * 3 // 4 for x in parts[-1]) + words(s) * 3 // 4 > most:
                parts.append([])
            parts[-1].append(s)
        out += [" ".join(p) for p in parts]
    return out


def test_chunks(spark):
    rnd = random.Random(4)
    texts = [[" ".join(["w"] * rnd.choice((1, 2, 3, 4, 9, 30))) + "." for _ in range(rnd.randint(0, 9))] for _ in range(80)]
    df = spark.createDataFrame([(k % 40, " ".join(x)) for k, x in enumerate(texts)] + [(90, None), (91, "")], "id int, text string")
    for least, most in ((1, 256), (4, 256), (4, 12), (20, 5)):
        got = Counter((r.id, r.chunk_index, r.content) for r in textprep.chunks(df, "id", "text", least, most).collect())
        assert got == Counter((k % 40, i, c) for k, x in enumerate(texts) for i, c in enumerate(brute_chunks(x, least, most)))
    lines = spark.createDataFrame([(1, "One two. Three!\nFour")], "id int, text string")
    assert [r.content for r in textprep.chunks(lines, "id", "text", least=1).collect()] == ["One two.", "Three!", "Four"]
    words = F.array(*[F.lit(x) for x in "abcdefg"])
    assert spark.range(1).select(textprep.token_chunks(words, 4, 1)).first()[0] == [list("abcd"), list("defg")]


def test_merge(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    c = spark.createDataFrame([(2, "B"), (3, None)], "id int, v string")
    assert sorted(map(tuple, merge.upsert(t, c, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, None)]
    assert sorted(map(tuple, merge.insert_absent(t, c, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(map(tuple, merge.merge_columns(t, c.withColumn("v", F.lit(None).cast("string")), ["id"]).collect())) == [(1, "a"), (2, "b"), (3, None)]
    parents, kids = merge.cascade(t, c, "id", (spark.createDataFrame([(9, 2), (8, 1)], "k int, id_fk int"), "id_fk"))
    assert [r.id for r in parents.collect()] == [1] and [r.k for r in kids.collect()] == [8]


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"1": "100", "2": "v9i3On"}')
    m = files.mapping_json(spark, str(tmp_path / "m.json"), "product_id", "content_id")
    assert m.count() == 2 and taxonomy.numeric_ids(m).count() == 1
    (tmp_path / "t.tsv").write_text('id\tname\n1\t"a\n2\tb\n')
    assert files.taxonomy_tsv(spark, str(tmp_path / "t.tsv"), "id string, name string").collect()[0].name == '"a'


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda t, n: json.dumps({"event_type": t, "ad_id": 1, "campaign_id": n % 2, "price_cents": n, "timestamp": 1704067200 + n})
    (source / "a.json").write_text("\n".join([line("impression", 1), line("click", 2), "{bad"]))
    (source / "b.json").write_text("\n".join([line("impression", 3), line("view", 4)]))
    out = [str(tmp_path / x) for x in ("imp", "clk", "dead")]
    for _ in range(2):  # the second run finds nothing new
        jobs.ad_event_job(files.file_stream(spark, str(source), 1), out[0], out[1], str(tmp_path / "cp"), out[2], once=True).awaitTermination()
    assert [spark.read.parquet(x).count() for x in out] == [2, 1, 1]
    assert files.day_partitioned(spark, out[0], "2024-01-01", "2024-01-02").count() == 2

    events = parse.ad_events(files.file_stream(spark, str(source)))
    q = jobs.ad_metrics(events).writeStream.format("memory").queryName("windows").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("windows").orderBy("impressions").collect()
    assert sum(r.impressions for r in got) == 2 and sum(r.spend_cents for r in got) == 6 and got[-1].campaign_id == 1


def test_auction_and_pacing_streams(spark, tmp_path):
    """Both sinks; a batch that runs again replaces itself."""
    files_at = tmp_path / "in"
    files_at.mkdir()
    won = {"auction_id": "a", "winner": {"ad_id": 1, "effective_bid": 2.5}, "timestamp": 1704067200}
    (files_at / "a.json").write_text("\n".join([json.dumps(won), json.dumps({"campaign_id": 4, "status": "ok", "timestamp": 1704153600}), "{bad"]))
    for job, n in ((jobs.auction_job, 2), (jobs.pacing_job, 2)):
        out = str(tmp_path / job.__name__)
        for _ in range(2):
            job(files.file_stream(spark, str(files_at)), out, str(tmp_path / f"cp-{job.__name__}"), once=True).awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == n and {str(r.event_date) for r in rows.collect()} == {"2024-01-01", "2024-01-02"}
        jobs.by_day(out)(rows.drop("event_date", "batch_id").where("event_time < '2024-01-02'"), 0)
        assert spark.read.parquet(out).count() == n


def test_late_rows_and_nonces_in_a_stream(spark, tmp_path):
    """A row behind the watermark is left out of the windows; a repeated nonce is dropped."""
    source = tmp_path / "in"
    source.mkdir()
    line = lambda second, nonce: json.dumps({"event_type": "click", "ad_id": 1, "campaign_id": 1, "price_cents": 1, "nonce": nonce, "timestamp": 1704067200 + second})
    (source / "a.json").write_text("\n".join([line(0, "a"), line(1, "a"), line(600, "b")]))
    messages = lambda: files.file_stream(spark, str(source), 1)
    counted = jobs.ad_metrics(parse.ad_events(messages())).writeStream.format("memory").queryName("late").outputMode("append").start()
    once = jobs.deduplicated(parse.ad_events(messages().withColumn("nonce", F.get_json_object("value", "$.nonce")))).writeStream.format("memory").queryName("nonces").start()
    for q in (counted, once):
        q.processAllAvailable()
    (source / "b.json").write_text("\n".join([line(2, "c"), line(700, "b"), line(800, "d")]))
    for q in (counted, once):
        q.processAllAvailable()
        q.stop()
    assert [r.clicks for r in spark.table("late").orderBy("window_start").collect()] == [2, 1, 1]
    assert spark.table("nonces").count() == 4


def test_sequence_matches_single_steps(spark):
    rows = [(1, NOON + k * 600, 1000.0, 100.0, 10.0 * k, 5.0 * k, NOON, NOON + 86400.0) for k in range(6)]
    names = "campaign_id bigint, now double, total_budget double, daily_budget double, spent double, spent_today double, start double, end double"
    got = pacing.run_steps(spark.createDataFrame(rows, names)).orderBy("now").collect()
    m, i = 1.0, 0.0
    for row, r in zip(rows, got, strict=True):
        x = pacing.step(dict(zip([c.split()[0] for c in names.split(", ")], row, strict=True)) | {"multiplier": m, "integral": i})
        m, i = x["new_multiplier"], x["new_integral"]
        assert r.multiplier == pytest.approx(m) and r.integral == pytest.approx(i)


def test_places(spark):
    """The longest network wins; an override leaves the rest empty; what is no address, or unknown, has no place."""
    nets = spark.createDataFrame([("10.0.0.0/8", "A", "a", 1.0, 2.0), ("10.1.0.0/16", "B", "b", 3.0, 4.0), ("10.1.2.3/32", "C", "c", 5.0, 6.0), ("0.0.0.0/0", "Z", "z", 7.0, 8.0), ("x/9", "X", "x", 0.0, 0.0)], "network string, country string, city string, lat double, lon double")
    asked = spark.createDataFrame([(1, "10.200.0.1", None), (2, "10.1.9.9", ""), (3, "10.1.2.3", None), (4, "255.255.255.255", None), (5, "10.1.2.3", "US"), (6, "::1", None), (7, None, None), (8, "1.2.3", "FR"), (9, "10.1.2.256", None)], "id int, address string, header string")
    got = {r.id: (r.country, r.lat) for r in geo.located(asked, nets, "address", "header").collect()}
    assert got == {1: ("A", 1.0), 2: ("B", 3.0), 3: ("C", 5.0), 4: ("Z", 7.0), 5: ("US", 0.0), 6: ("", 0.0), 7: ("", 0.0), 8: ("FR", 0.0), 9: ("", 0.0)}
    assert {r.country for r in geo.located(asked, nets.limit(0), "address").collect()} == {""}


def test_traffic(spark):
    """Draws repeat, follow their weights, and each stage is part of the one before."""
    mix = traffic.Traffic({"mobile": 0.7, "desktop": 0.3}, {"US": 0.6, "DE": 0.4}, 0.9, 0.1, seed=5)
    requests = spark.range(20_000).withColumnRenamed("id", "request_id")
    run = lambda: traffic.followed(traffic.asked(requests, mix), requests.where("request_id % 2 = 0"), mix)
    r = run().selectExpr("avg(int(device = 'mobile')) m", "avg(int(country = 'US')) u", "sum(int(fill)) f", "sum(int(impression)) i", "sum(int(click)) c", "sum(int(click and not impression or impression and not fill)) bad").first()
    assert abs(r.m - 0.7) < 0.02 and abs(r.u - 0.6) < 0.02 and r.f == 10_000 and abs(r.i / r.f - 0.9) < 0.02 and abs(r.c / r.i - 0.1) < 0.02 and r.bad == 0
    assert run().exceptAll(run()).isEmpty()
    assert traffic.asked(requests.limit(1), traffic.Traffic()).first()[1:] == ("desktop", "")
    assert requests.limit(50).select(choice.nonce().alias("n")).distinct().count() == 50


def test_versions(spark, tmp_path):
    """A version counts once all its tables are written."""
    at = str(tmp_path / "v")
    one, two = spark.range(3), spark.range(5)
    merge.written_together({"a": one, "b": one}, at, 1)
    two.write.parquet(f"{at}/tables/a/2")  # the writer was lost before b and the mark
    assert [df.count() for df in merge.read_together(spark, at, "a", "b")] == [3, 3]
    for _ in range(2):
        merge.written_together({"a": two, "b": one}, at, 2)
    assert [df.count() for df in merge.read_together(spark, at, "a", "b")] == [5, 3]


def test_counter_stream(spark, tmp_path):
    """Counters over batches; a batch that runs again adds nothing."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = lambda kind, n: json.dumps({"event_type": kind, "ad_id": 1, "campaign_id": n % 2, "price_cents": n, "timestamp": 1704067200 + n})
    for k, name in enumerate("ab"):
        (source / f"{name}.json").write_text("\n".join([line("impression", 2 * k), line("click", 2 * k + 1), line("impression", 2 * k + 1)]))
        for _ in range(2):
            jobs.counter_job(files.file_stream(spark, str(source)), out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r.campaign_id: (r.impressions, r.clicks, r.spend_cents) for r in jobs.counter_totals(spark.read.parquet(out)).collect()}
    assert got == {0: (2, 0, 2), 1: (2, 2, 8)}


def test_rollup_refresh(spark, tmp_path):
    """Only the days that a rollup has rows for are replaced."""
    at, day = str(tmp_path / "r"), dt.timedelta(days=1)
    rows = lambda *x: spark.createDataFrame([(NOW + k * day, v) for k, v in x], "hour timestamp_ntz, impressions int")
    rollups.refresh(rows((0, 1), (1, 2)), at)
    rollups.refresh(rows((1, 9)), at)
    assert sorted(r.impressions for r in spark.read.parquet(at).collect()) == [1, 9]
