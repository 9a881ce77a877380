"""The vector index, the bitmap index and the one parse of messages on small tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from adspectra.operators import bitmaps, evaluation, parse, similarity, targeting, vector_index

VECTORS = "id bigint, embedding array<double>"


def clustered(n, dims=12, clusters=9, seed=0, hot=0.4):
    """Vectors round few directions, one of which has a large share."""
    rnd = np.random.default_rng(seed)
    centres = np.random.default_rng(7).normal(size=(clusters, dims))
    own = np.where(rnd.random(n) < hot, 0, rnd.integers(0, clusters, n))
    return centres[own] + 0.25 * rnd.normal(size=(n, dims))


@pytest.fixture(scope="module")
def sides(spark):
    items, queries = clustered(900), clustered(120, seed=1)
    items = [(i, v.tolist()) for i, v in enumerate(items)] + [(2000 + i, [0.0] * 12) for i in range(5)] + [(3000, None)] + [(4000 + i, items[3].tolist()) for i in range(20)]
    queries = [(i, v.tolist()) for i, v in enumerate(queries)] + [(500, [0.0] * 12), (501, None), (502, items[3][1])]
    return spark.createDataFrame(queries, VECTORS).withColumnRenamed("id", "q"), spark.createDataFrame(items, VECTORS).withColumnRenamed("id", "i")


def rows_of(found):
    return sorted((r.q, r["rank"], r.i, round(r.similarity, 9)) for r in found.collect())


@pytest.mark.parametrize(("k", "part"), [(10, 64), (40, 2048)])
def test_indexed_search_is_exact(sides, k, part):
    queries, items = sides
    index = vector_index.build(items, "i", part=part)
    want = rows_of(similarity.knn(queries.where("embedding is not null"), items.where("embedding is not null"), "q", "i", k))
    assert rows_of(vector_index.search(index, queries, "q", "i", k, probes=1)) == want
    assert rows_of(vector_index.search(index, queries, "q", "i", k, probes=3)) == want


def test_quick_search_recalls(sides):
    queries, items = (x.where("embedding is not null") for x in sides)
    index = vector_index.build(items, "i")
    row = vector_index.recall(vector_index.search(index, queries, "q", "i", 10, probes=6, exact=False), similarity.knn(queries, items, "q", "i", 10), "q", "i").first()
    assert row.neighbours == 10 * queries.count() and row.recall >= 0.9
    probes = vector_index.calibrated_probes(index, queries, "q", "i", 10, target=0.9)
    found = vector_index.search(index, queries, "q", "i", 10, probes, exact=False)
    assert 1 <= probes <= len(index.held) and vector_index.recall(found, similarity.knn(queries, items, "q", "i", 10), "q", "i").first().recall >= 0.9


def test_index_compares_less_than_all(sides):
    """The bounds leave out most pairs of far clusters, and a list of many items is several parts."""
    queries, items = sides
    index = vector_index.build(items, "i", centres=12, part=64)
    assert index.held.sum() == 925 and index.parts.max() > 1
    near = queries.where("q < 120").select("q", F.col("embedding").alias("v"), F.lit(0.6).alias("reach"))
    compared = vector_index._wanted(near, index, False, 5, 1).join(index.items.groupBy("cell", "part").count(), ["cell", "part"]).agg(F.sum("count")).first()[0]
    assert compared < 0.7 * 120 * 925


def test_empty_sides(sides):
    queries, items = sides
    assert vector_index.search(vector_index.build(items.limit(0), "i"), queries, "q", "i", 3).count() == 0
    assert vector_index.search(vector_index.build(items, "i"), queries.limit(0), "q", "i", 3).count() == 0
    few = rows_of(vector_index.search(vector_index.build(items.where("i < 2"), "i"), queries.where("q < 3"), "q", "i", 5))
    assert len(few) == 6


@pytest.mark.parametrize("k", [1, 3, 7, None])
def test_best_of_blocks(k):
    rnd = np.random.default_rng(2)
    sim, ids = rnd.integers(0, 4, (20, 7)) / 4, rnd.permutation(7)
    got = similarity.best_of(np.arange(20), ids, sim, k).sort_values(["q", "similarity", "i"], ascending=[True, False, True])
    want = [(q, i) for q in range(20) for _, i in sorted((-sim[q, c], ids[c]) for c in range(7))[:k]]
    assert list(zip(got["q"], got["i"], strict=True)) == want


# -- bitmaps


@pytest.fixture(scope="module")
def long_index(spark):
    rnd = np.random.default_rng(4)
    rows = [("keyword", f"k{rnd.integers(0, 6)}", int(a)) for a in rnd.integers(0, 100_000, 300)] + [("keyword", "hot", a) for a in range(32_700, 32_900)]
    rows += [("country", c, int(a)) for c in ("US", "DE") for a in rnd.integers(0, 100_000, 200)] + [("device", "mobile", a) for a in range(32_000, 33_000)] + [("country", "US", a) for a in range(32_700, 32_800)]
    rows += [("keyword", "edge", a) for a in (0, 63, 64, 32_767, 32_768, 65_535, 65_536)] + [("keyword", "edge", 0), ("keyword", None, 3), ("keyword", "edge", None)]
    return spark.createDataFrame(rows, "dim string, key string, ad_id bigint")


def entries(df):
    return sorted((r.dim, r.key, r.ad_id) for r in df.collect())


def test_bitmaps_hold_the_index(long_index):
    packed = bitmaps.pack(long_index)
    assert entries(bitmaps.unpack(packed)) == entries(long_index.dropna().distinct())
    assert {(r.dim, r.key): r.ads for r in bitmaps.sizes(packed).collect()} == {(r.dim, r.key): r.ads for r in targeting.index_sizes(long_index.dropna()).collect()}
    assert packed.count() < long_index.count() / 10
    assert bitmaps.unpack(bitmaps.pack(long_index.limit(0))).count() == 0


def test_bitmaps_are_refreshed(spark, long_index):
    packed = bitmaps.pack(long_index)
    changed = spark.createDataFrame([(a,) for a in [*range(32_600, 32_850), 0, 65_536, 99_999_999]] + [(None,)], "ad_id bigint")
    fresh = spark.createDataFrame([("keyword", "new", 32_700), ("keyword", "edge", 0), ("keyword", "far", 99_999_999)], "dim string, key string, ad_id bigint")
    before = entries(bitmaps.unpack(packed))
    assert entries(bitmaps.unpack(bitmaps.refresh(packed, changed, fresh))) == entries(targeting.refresh_index(long_index.dropna().distinct(), changed, fresh))
    assert entries(bitmaps.unpack(packed)) == before
    every = spark.range(bitmaps.BITS, 2 * bitmaps.BITS).withColumnRenamed("id", "ad_id")
    assert entries(bitmaps.unpack(bitmaps.refresh(packed, every, fresh.limit(0)))) == [x for x in before if x[2] // bitmaps.BITS != 1]
    assert entries(bitmaps.unpack(bitmaps.refresh(packed, changed.limit(0), fresh.limit(0)))) == before


def test_candidates_on_bitmaps(spark, long_index):
    requests = spark.createDataFrame([(i, i % 4, c, d) for i, (c, d) in enumerate([(c, d) for c in ("US", "DE", "FR", None) for d in ("mobile", "tv", None)] * 4)], "request_id bigint, page_id bigint, country string, device string")
    keys = spark.createDataFrame([(0, "keyword", "hot"), (0, "keyword", "k1"), (1, "keyword", "k2"), (1, "keyword", "edge"), (2, "keyword", "unknown"), (9, "keyword", "hot")], "page_id bigint, dim string, key string")
    known = long_index.dropna().distinct()
    want = sorted(map(tuple, targeting.find_candidates(requests, keys, known).collect()))
    assert want and sorted(map(tuple, bitmaps.candidates(requests, keys, bitmaps.pack(known)).collect())) == want
    assert bitmaps.candidates(requests, keys, bitmaps.pack(known.limit(0))).count() == 0


def test_messages_are_parsed_once(spark):
    messages = spark.createDataFrame([('{"event_type":"click","ad_id":1}', None)], "value string, ingest_ts timestamp_ntz")
    for read in (parse.ad_events, parse.auction_events, parse.pacing_events, parse.dead_letters):
        plan = read(messages)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1, plan


def test_batches_are_compared_in_slices(spark):
    """A task sees as many rows at a time as a slice holds, and sends on each query once, with the lists it wants."""
    sizes = [len(x) for x in vector_index._sliced(iter([pd.DataFrame({"q": range(n)}) for n in (1100, 3, 0)]))]
    assert max(sizes) == vector_index.SLICE and sum(sizes) == 1103
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(900))], VECTORS).withColumnRenamed("id", "i")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(700, seed=2))], VECTORS).select(F.col("id").alias("q"), "embedding")
    index = vector_index.build(items, "i", part=64)
    assert "cells" in vector_index._wanted(queries.select("q", F.col("embedding").alias("v"), F.lit(None).cast("double").alias("reach")), index, False, 5, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(vector_index.search(index, queries, "q", "i", 5)) == rows_of(similarity.knn(queries, items, "q", "i", 5))


def test_best_of_each_label(spark, monkeypatch):
    """Labels over several blocks, null ones among them, by the similarities of all pairs."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    v = "id bigint, embedding array<double>, label int"
    items = spark.createDataFrame([(i, x.tolist(), None if i % 11 == 0 else i % 4) for i, x in enumerate(clustered(150))], v).withColumnRenamed("id", "i")
    queries = spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(clustered(60, seed=3))], v).withColumnRenamed("id", "q")
    found = similarity.best_by_label(queries, items, "q", "i")
    want = similarity.similarities(queries, items, "q", "i", None).join(items.select("i", "label"), "i").groupBy("q", "label").agg(F.max("similarity").alias("s"))
    key = lambda rows: sorted((r[0], -1 if r[1] is None else r[1], round(r[2], 9)) for r in rows.collect())
    assert found.count() == 300 and key(found) == key(want)


def test_metrics_by_labels_are_those_of_pairs(spark):
    queries = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 9)], "q bigint, label int")
    items = spark.createDataFrame([(i, None if i == 7 else i % 3) for i in range(8)], "i bigint, label int")
    ranked = spark.createDataFrame([(q, (q * 3 + r) % 8, r) for q in range(1, 5) for r in range(1, 7)], "q bigint, i bigint, rank int")
    truth = queries.join(items, "label").select("q", "i")
    got = evaluation.labelled_metrics(ranked, queries, items, "q", "i", 5)
    want = evaluation.ranking_metrics(ranked, truth, "q", "i", 5).join(evaluation.ceiling_precision(truth, "q", 5), "q", "left")
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
