"""SimHash near-duplicates, repeated substrings and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from adspectra.llm import components, simhash, substrings, suffixes

DOCS = "doc_id bigint, text string, source string, n_chars bigint"
WORDS = ["".join(random.Random(k).choices("abcdefghijkl", k=4)) for k in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(8)
    base = [prose(rnd, rnd.randint(3, 90)) for _ in range(40)]
    rows = [(100 + i, x, "a", 0) for i, x in enumerate(base)]
    for i in range(25):  # near copies
        words = rnd.choice(base).split()
        words[rnd.randrange(len(words))] = "changed"
        rows.append((200 + i, " ".join(words), "b", 0))
    passage = prose(rnd, 60)
    rows += [(300 + i, prose(rnd, rnd.randint(0, 30)) + " " + passage + "é" * rnd.randint(0, 9) + " " + prose(rnd, 5), "c", 0) for i in range(12)]
    rows += [(400, base[0], "d", 0), (401, base[0].upper(), "d", 0), (402, None, "d", None), (403, "", "d", 0), (404, "é" * 500, "d", 0), (405, "ab" * 300, "d", 0), (400, base[0], "d", 0), (None, base[1], "d", 0), (406, "same line of text\n" * 40, "d", 0)]
    return spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("clash")).withColumn("spans", F.lit(0))


# -- SimHash


def brute_fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    prints = [brute_fingerprint(x) for _, x in rows]
    top = brute_components(prints, 4)
    least = {}
    for t, (k, _) in zip(top, rows, strict=True):
        if k is not None:
            least[t] = min(k, least.get(t, k))
    want = Counter((k, p, least.get(t)) for (k, _), p, t in zip(rows, prints, top, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words entirely here now"), (5, "x y z w v"), (None, "x y z w v")], "doc_id bigint, text string")
    assert sorted(r.text for r in simhash.one_of_each(df).collect()) == ["a b c d e f", "other words entirely here now", "x y z w v"]


@pytest.mark.parametrize("depth", [0, 3, 6])
def test_trees_lose_no_link(spark, depth):
    rnd = np.random.default_rng(depth)
    base = rnd.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = base[rnd.integers(0, 150, 300)].copy()
    for k in range(300):
        for b in rnd.choice(64, rnd.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    values = np.unique(np.concatenate([base, near, np.array([0, 1, 3], np.uint64)]))
    want = {(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    found = set()
    for m in simhash.block_masks(3):
        mask = np.uint64(m)
        tree = simhash.grow(values, mask, depth)
        at, leaf, home = simhash.deal(tree, values, mask, 1)
        assert sorted(at[home].tolist()) == list(range(len(values)))
        for x in np.unique(leaf):
            h, q = at[(leaf == x) & home], at[(leaf == x) & ~home]
            for other in (h, q):
                for i, j in simhash.near_pairs(values[h], values[other], mask, 1, 4):
                    found |= {(max(a, b), min(a, b)) for a, b in zip(h[i].tolist(), other[j].tolist(), strict=True) if a != b}
    assert found == want
    fps = spark.createDataFrame([(int(v.view(np.int64)),) for v in values], "fp bigint")
    got = {(r.node, r.root) for r in components.roots(simhash.links(fps, shard=16)).collect()}
    top = brute_components([int(v) for v in values], 4)
    groups = {}
    for v, t in zip(values.view(np.int64).tolist(), top, strict=True):
        groups.setdefault(t, []).append(v)
    assert got == {(v, min(g)) for g in groups.values() if len(g) > 1 for v in g}


def test_a_block_that_many_share():
    """Fingerprints alike in a whole block are searched by their other bits, and lose no pair."""
    rnd = np.random.default_rng(5)
    mask = np.uint64(simhash.block_masks(3)[0])
    values = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) & ~mask | np.uint64(77)
    for k in range(2000, 3000):
        values[k] = values[k - 2000]
        for b in rnd.choice(np.arange(22, 64), rnd.integers(1, 6), replace=False):
            values[k] ^= np.uint64(1) << np.uint64(b)
    values = np.unique(values)
    found = set()
    for i, j in simhash.near_pairs(values, values, mask, 1, 4):
        found |= {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)
    assert found == {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b} and len(found) > 500


def test_a_very_long_text(spark):
    text = prose(random.Random(2), 200_000)
    rows = spark.createDataFrame([(1, text), (2, text + " tail"), (3, "short")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    assert got[1].fp & (1 << 64) - 1 == brute_fingerprint(text) and got[2].component_id == 1 and got[3].component_id == 3
    cut = {r.doc_id: r for r in substrings.removed(rows).collect()}
    assert cut[1].n_removed < 100_000 and cut[2].n_bytes - cut[2].n_removed == 5 and cut[3].n_removed == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components.roots(chain.union(spark.createDataFrame([(1000, 1001), (7, 7)], "u bigint, v bigint"))).collect()
    assert {(r.node, r.root) for r in rows} == {(k, 0) for k in range(301)} | {(1000, 1000), (1001, 1000)}


# -- repeated substrings


def brute_repeats(rows, length=100):
    """By (id, text) in order: removed byte flags."""
    seen, out = set(), {}
    for k, x in sorted(set(rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], xxhash.xxh64_intdigest(r[1].encode(), 42) ^ 1 << 63)):
        data = x.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out[k, x] = gone
    return out


def summary(data, gone):
    runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("limit", [256, 2])
def test_removed(spark, docs, monkeypatch, limit):
    """With a limit of 2 nearly all anchors take the way of those with too many segments."""
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", limit)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    flags = brute_repeats(rows)
    want = Counter((k, *summary(x.encode(), flags[k, x])) for k, x in rows)
    got = substrings.removed(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 5000
    cut = {r.doc_id: r for r in substrings.without_repeats(docs).collect()}
    assert cut[405].text == "ab" and cut[405].n_chars == 2 and cut[402].text is None and cut[403].text == ""
    assert substrings.without_repeats(docs).columns == docs.columns
    assert substrings.removed(docs.limit(0)).count() == 0


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 512)
    rnd = random.Random(0)
    texts = [bytes(rnd.choices(b"abcd", k=n)) for n in (5000, 0, 99, 100, 511, 512, 513, 40)]
    seen = Counter()
    for pieces, of, begin in substrings.blocks(texts):
        s = substrings.Segments(pieces)
        for o, a, n in zip(s.owner.tolist(), s.start.tolist(), s.windows.tolist(), strict=True):
            first = a - int(s.first[o]) + begin[o]
            seen.update((of[o], first + k) for k in range(n))
            assert pieces[o][a - int(s.first[o]) :][: n + 99] == texts[of[o]][first : first + n + 99]
    assert seen == Counter((i, k) for i, x in enumerate(texts) for k in range(len(x) - 99))


def test_a_long_run_sends_few_anchors(spark):
    """An anchor is sent twice at most from each batch, and the map holds those that occur again all the same."""
    rnd = random.Random(3)
    texts = ["a" * 300_000, "".join(rnd.choices("abcdefgh ", k=5_000)), "".join(rnd.choices("ijklmnop ", k=5_000))]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, texts[1]])], "doc_id int, text string").coalesce(1)
    every = Counter(int(h) >> 32 for x in (*texts, texts[1]) for pieces, _, _ in substrings.blocks([x.encode()]) for h in substrings.Segments(pieces).h)
    assert max(every.values()) > 100_000
    sent = Counter(int(v) for r in substrings.anchor_numbers(docs, 64).collect() for v in np.frombuffer(r.f, np.uint32))
    assert sent == {v: min(n, 2) for v, n in every.items()}
    want = np.zeros(1 << 26, np.uint64)
    for v in [v for v, n in every.items() if n > 1]:
        want[v >> 6] |= np.uint64(1) << np.uint64(v & 63)
    assert (substrings.repeated_anchors(docs, 32) == want).all()


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(1)
    w = bytes(rnd.choices(b"ab", k=160))
    s = substrings.Segments([bytes(rnd.choices(b"ab", k=77)) + w + b"x" * 30, w, b"q" * 9 + w])
    anchor = {}
    for o, a, n, h in zip(s.owner.tolist(), s.start.tolist(), s.windows.tolist(), s.h.tolist(), strict=True):
        for k in range(n):
            data = s.text[a + k : a + k + 100].tobytes()
            assert anchor.setdefault(data, h) == h


@pytest.mark.parametrize("n", [1, 2, 7, 40, 130])
def test_suffix_arrays(n):
    rnd = np.random.default_rng(n)
    t = rnd.integers(1, 4, (n, 25)).astype(np.uint8)
    t[: n // 2, ::2] = 1
    t[-1] = 0
    sa = suffixes.suffix_arrays(t)
    for c in range(25):
        x = t[:, c].tobytes()
        order = sorted(range(n), key=lambda i: x[i:])
        assert sa[:, c].tolist() == order
    if n > 1:
        for most in (5, 16, 65):
            common = suffixes.permuted_common_prefixes(t, sa, most)
            for c in range(25):
                x = t[:, c].tobytes()
                for a, b in zip(sa[:-1, c], sa[1:, c], strict=True):
                    k = 0
                    while k < most and max(a, b) + k < n and x[a + k] == x[b + k]:
                        k += 1
                    assert common[b, c] == k


# -- pipeline


def test_pipeline_stages(spark, sf):
    from adspectra.llm import packing, quality
    from adspectra.llm.common import table
    from adspectra.llm.queries import vocabulary

    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None
    good = {r.doc_id for r in quality.measure(docs, quality.train(docs, table(spark, sf, "labels"))).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    top = brute_components([brute_fingerprint(x) for _, x in rows], 4)
    rows = [rows[i] for i in sorted(set(top))]
    flags = brute_repeats(rows)
    left = []
    for k, x in rows:
        data, gone = x.encode(), flags[k, x]
        left.append((k, "".join(ch for ch, at in zip(x, np.cumsum([0] + [len(c.encode()) for c in x]).tolist(), strict=False) if not all(gone[at : at + len(ch.encode())]))))
    want = packing.token_pieces(spark.createDataFrame(left, "doc_id bigint, text string"), vocabulary("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(cols).collect())) == Counter(map(tuple, want.select(cols).collect()))


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables go through all stages."""
    from adspectra.llm import packing
    from adspectra.llm.queries import vocabulary

    rnd = random.Random(12)
    plain = [(i, prose(rnd, rnd.randint(12, 60)), "a", 0) for i in range(30)]
    rows = [*plain, plain[3], (plain[4][0], prose(rnd, 30), "b", 0), (None, prose(rnd, 40), "c", None), (None, None, None, None), (40, None, "d", 0), (41, "", "d", 0), (42, " \n", "d", 0), (43, prose(rnd, 20_000), "e", 9)]
    rows += [(50 + i, plain[i][1] + " " + plain[i + 1][1], "f", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit("x"), "fp": F.lit(1), "spans": F.lit(2), "piece": F.lit(3), "__row": F.lit(4)})
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, None), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    for name, of in (("full", lambda df: df), ("empty", lambda df: df.limit(0))):
        folder = f"{tmp_path}/{name}"
        of(docs).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            before, table = table, f(spark, table, folder)
            assert table.columns == docs.columns, stage
            table.write.parquet(f"{folder}/{stage}")
            table = spark.read.parquet(f"{folder}/{stage}")
            assert table.count() <= before.count()
        texts = table.select("doc_id", "text")
        got = corpus_pipeline.run(spark, folder)
        want = packing.token_pieces(texts, vocabulary("word_bpe_49k.json"))
        assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got.collect()) == Counter((r.doc_id, r.length, r.ids_crc32) for r in want.collect())
        kept = Counter(r.doc_id for r in texts.collect())
        if name == "full":
            assert {43, *range(30)} >= set(kept) - {None, *range(50, 55)} and max(kept.values()) == 1 and 43 in kept and not {40, 41, 42} & set(kept)
        else:
            assert not kept


def test_suffix_arrays_take_a_few_sorts():
    """The suffixes of many texts are sorted in the time of some sorts of as many words, not in hundreds of scattered steps a symbol."""
    rnd = np.random.default_rng(0)
    t = rnd.choice(np.array([1, *range(99, 124)], np.uint8), (4096, 32))
    t[500:1500] = t[2000:3000]
    t[-1] = 0
    numbers = rnd.integers(0, 1 << 60, t.size).astype(np.uint64)

    def seconds(work):
        took = []
        for _ in range(3):
            began = time.process_time()
            work()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: suffixes.suffix_arrays(t)) < 60 * seconds(lambda: np.sort(numbers))


def test_spans_that_touch():
    rnd = random.Random(5)
    spans = [[(a, a + rnd.randrange(1, 30)) for a in (rnd.randrange(300) for _ in range(rnd.randrange(12)))] for _ in range(60)]
    got = substrings.merged(pa.array([None if not s else [{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))[3:])
    for s, merged in zip(spans[3:], got, strict=True):
        covered = sorted({i for a, b in s for i in range(a, b)} | {-2})
        touch = {b for _, b in s} & {a for a, _ in s}
        runs = [(a, b) for a, b in merged]
        assert sorted({i for a, b in runs for i in range(a, b)} | {-2}) == covered
        assert all(b < a2 for (_, b), (a2, _) in zip(runs, runs[1:], strict=False)) and not touch & {b for _, b in runs} & {a for a, _ in runs}


def test_repeats_in_shards():
    """Segments of several anchors, one row twice, against a search of each anchor's windows in their order."""
    rnd = random.Random(6)
    rows, want = [], set()
    for h in range(-3, 12):
        anchor = "".join(rnd.choices("abcé", k=18)).encode()[:36].ljust(36, b"x")
        left, right = (["".join(rnd.choices("ab", k=64)) for _ in range(2)] for _ in range(2))
        own = []
        for k in range(9):
            a, b = rnd.randrange(32, 65), rnd.randrange(32, 65)
            own.append((h, k // 2, k % 2, 1000 * k, a, rnd.choice(left)[64 - a :].encode() + anchor + rnd.choice(right)[:b].encode()))
        own.append(own[4])
        seen = {}
        for _, k, th, s0, _, data in sorted(own):
            for i in range(len(data) - 99):
                first = seen.setdefault(data[i : i + 100], (k, th, s0 + i))
                if first != (k, th, s0 + i):
                    want |= {(k, th, s0 + i + j) for j in range(100)}
        rnd.shuffle(own)
        rows += own
    names = ("h", "k", "th", "s0", "place", "bytes")
    table = pa.table({n: pa.array(x, pa.binary() if n == "bytes" else pa.int64()) for n, x in zip(names, zip(*rows, strict=True), strict=True)})
    found = substrings.repeats_in_shards(table).to_pylist()
    assert {(r["k"], r["th"], i) for r in found for i in range(r["start"], r["stop"])} == want and want
