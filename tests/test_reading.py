"""Vectors of texts, names of several words and the cache on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adspectra.operators import cache, embedding, names
from adspectra.plans import reading  # noqa: F401  it registers its queries
from adspectra.registry import QUERIES


def brute_vectors(texts, dimensions=embedding.DIMENSIONS):
    split = {k: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for k, t in texts.items()}
    feature = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % embedding.FEATURES
    held = Counter(f for w in split.values() for f in {feature(x) for x in w})
    out = {}
    for k, own in split.items():
        v = [0.0] * dimensions
        for f in map(feature, own):
            v[f % dimensions] += (1 if f // dimensions % 2 == 0 else -1) * (math.log((1 + len(texts)) / (1 + held[f])) + 1)
        norm = math.sqrt(sum(x * x for x in v))
        out[k] = [x / norm if norm else 0.0 for x in v]
    return out


def test_embeddings(spark):
    texts = {1: "Red shoes, red hats", 2: "red", 3: None, 4: "", 5: "... !", 6: "blue Été 42", 7: "word " * 50_000, 8: "shoes RED hats red"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string").withColumn("feature", F.lit("clash")).withColumn("idf", F.lit(1))
    got = {r.id: r.embedding for r in embedding.embeddings(df, "id", "text").collect()}
    want = brute_vectors(texts)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert got[1] == got[8] and not any(got[3] + got[4] + got[5])
    assert embedding.embeddings(df.limit(0), "id", "text").count() == 0


def test_embeddings_by_given_weights(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "unseen")], "id int, text string")
    idf = embedding.frequencies(df.where("id = 1"), "text")
    got = {r.id: r.embedding for r in embedding.embeddings(df, "id", "text", idf, 16).collect()}
    assert len(got[2]) == 16 and sorted(map(abs, got[2])) == [0.0] * 15 + [1.0]


def test_chunks_of_documents_cover_their_sentences(spark, sf):
    rows = QUERIES["document_semantic_chunks"](spark, sf).collect()
    by_doc = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.pos)):
        by_doc[r.doc_id].append((r.pos, r.chunk))
    assert all([p for p, _ in x] == list(range(len(x))) and x[0][1] == 0 and all(0 <= b[1] - a[1] <= 1 for a, b in zip(x, x[1:], strict=False)) for x in by_doc.values())
    assert any(x[-1][1] > 0 for x in by_doc.values())


def brute_names(text, table):
    w = [x for x in re.split(r"[^\w#]+", re.sub(r"['’]s\b", "", text.lower())) if x]
    at, out = 0, []
    while at < len(w):
        fits = [n for n in range(min(len(w) - at, 6), 0, -1) if " ".join(w[at : at + n]) in table]
        if fits:
            name = " ".join(w[at : at + fits[0]])
            out += [(at, fits[0], name, t) for t in table[name]]
        at += fits[0] if fits else 1
    return out


def test_names(spark):
    rnd = random.Random(4)
    letters = ["new", "york", "city", "hall", "the", "of", "#1"]
    known = [("New York", "GPE"), ("New York City", "GPE"), ("york city hall of", "ORG"), ("city hall", "ORG"), ("city hall", "EVENT"), ("Hall", "PERSON"), ("of", "ORG"), ("the new", "DATE"), ("#1 hall", "PRODUCT"), ("", "ORG"), (None, "ORG"), ("New York", "GPE")]
    texts = [(i, " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (61, "New York's City-Hall"), (62, "new york " * 5000)]
    table = defaultdict(list)
    for text, kind in sorted({(x.lower(), t) for x, t in known if x}):
        if kind in names.TYPES and len(text) >= 3:
            table[text].append(kind)
    docs = spark.createDataFrame(texts, "id int, text string").withColumn("name", F.lit("clash")).withColumn("pos", F.lit(0))
    gazetteer = spark.createDataFrame(known, "text string, type string")
    got = sorted(tuple(r) for r in names.names_in(docs, "id", "text", gazetteer).collect())
    assert got == sorted((i, *m) for i, t in texts for m in brute_names(t or "", table))
    assert names.names_in(docs.limit(0), "id", "text", gazetteer).count() == names.names_in(docs, "id", "text", gazetteer.limit(0)).count() == 0


def test_encoding_is_repaired(spark):
    whole = ["Café", "naïve Ünï", "plain", "日本", "Â", "Ã alone", "price 5 €", None]
    broken = [("Café".encode().decode("latin-1"), "Café"), ("日本".encode().decode("latin-1"), "日本"), ("Ã\x28 Ã©\xff", "Ã\x28 Ã©\xff")]
    rows = spark.createDataFrame([(x, x) for x in whole] + broken, "text string, want string").withColumn("got", names.repaired(F.col("text"))).collect()
    assert all(r.got == r.want for r in rows)


def test_cache_over_versions(spark, tmp_path):
    """Loads only what is lacking, ages entries, and doesn't remember what the source lacks."""
    asked = []

    def load(lacking):
        asked.append(sorted(r.k for r in lacking.collect()))
        return lacking.where("k <> 'none'").withColumn("value", F.concat(F.lit("new "), "k"))

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    store = cache.Cache(spark, str(tmp_path), "k", 3600)
    rows = [("a", "old a", "2024-01-01 00:00:00"), ("a", "a", "2024-01-01 02:30:00"), ("b", "b", "2024-01-01 01:00:00"), ("c", "c", "2024-01-01 02:00:00"), ("d", "d", None)]
    store.put(spark.createDataFrame(rows, "k string, value string, s string").select("k", "value", F.col("s").cast("timestamp_ntz").alias("stored_at")), 0)
    keys = spark.createDataFrame([(x,) for x in ["a", "a", "b", "c", "d", "e", "none", None]], "k string")
    first = {r.k: (r.status, r.value) for r in store.read_through(keys, load, at("2024-01-01 03:00:00"), 1).collect()}
    assert first == {"a": ("hit", "a"), "b": ("expired", "new b"), "c": ("expired", "new c"), "d": ("expired", "new d"), "e": ("miss", "new e"), "none": ("miss", None)}
    second = {r.k: (r.status, r.value) for r in store.read_through(keys, load, at("2024-01-01 03:45:00"), 2).collect()}
    assert second == {"a": ("expired", "new a"), **{k: ("hit", f"new {k}") for k in "bcde"}, "none": ("miss", None)}
    assert {tuple(x) for x in asked} == {("b", "c", "d", "e", "none"), ("a", "none")}
    assert store.entries().count() == 5
    assert cache.looked_up(keys.limit(0), store.entries(), "k", at("2024-01-01 03:00:00")).count() == 0
