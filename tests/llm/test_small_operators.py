"""Quality rules, sharding, winnowing, pieces, packing, WARC, pages and language models on small tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspectra.llm import extraction, htmltree, lm, packing, pieces, quality, sharding, warc, winnowing
from adspectra.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, source string, n_chars bigint"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(("", "", ".", "s")) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randint(1, 120)), "a", 0) for i in range(60)]
    rows += [(60, None, "b", None), (61, "", "b", 0), (62, "  \n\t ", "b", 0), (63, rows[5][1], "c", 0), (63, rows[5][1], "c", 0), (None, "no id here", "d", 1), (64, "é" * 5000 + " ü", "e", 2), (65, prose(rnd, 30_000), "f", 3)]
    return spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("fingerprint", F.lit(1))


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# -- quality rules


def brute_counts(text):
    words = text.encode().split()
    n_repeat, windows = 0, [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, c in Counter(windows).items() if c > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    n_repeat = len(covered)
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, n_repeat)


def test_statistics():
    rnd = random.Random(1)
    cases = ["", " ", "a b c d e a b c d e", "x\ny\nx\n\n \n \nx", "é# |$ * ü　b", "a " * 400] + [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + ["\n".join(rnd.choice(("a b", "c", " ", "")) for _ in range(20)) for _ in range(20)]
    for x in cases:
        assert quality.statistics(x.encode())[:5] == brute_counts(x), x


def test_many_different_words():
    words = [str(i).encode() for i in range(9000)]
    assert quality.repeated_words(words + words[:6]) == 12


def test_quality_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(61, 0, 0), (None, None, None)], "doc_id bigint, quality int, toxic int")
    for of in (labels, labels.limit(0)):
        model = quality.train(docs, of)
        rows = quality.measure(docs, model).collect()
        assert len(rows) == docs.count()
        assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
        assert Counter((r.doc_id, r.n_words) for r in rows if r.kept) == Counter((r.doc_id, len((r.text or "").split())) for r in quality.keep(docs, model).collect())
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.measure(docs.limit(0), model).count() == 0


def test_forest_finds_what_is_rare():
    rnd = np.random.default_rng(0)
    good = rnd.integers(50, 60, (2000, 9))
    good[:, :9] = np.column_stack([rnd.integers(50, 500, 2000), np.zeros(2000), np.zeros(2000), np.zeros(2000), np.zeros(2000), rnd.integers(1, 9, 2000), np.zeros(2000), np.zeros(2000), rnd.integers(1, 9, 2000)])
    good[:, 1], good[:, 6] = good[:, 0] * 5, good[:, 0] * 5
    bad = good[:150].copy()
    bad[:, 2] = bad[:, 0] * 3
    stats, ok = np.concatenate([good, bad]), np.r_[np.ones(2000, bool), np.zeros(150, bool)]
    model = quality.fit(stats[::2], ok[::2])
    kept = model.judge(stats[1::2])[2]
    assert kept[ok[1::2]].mean() > 0.99 and kept[~ok[1::2]].mean() < 0.05


def test_path_lengths_and_thresholds(spark, sf):
    """What is kept follows from walking every tree by hand, and the thresholds from the labelled rows."""
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert model.forests

    def depth(forest, t, row):
        node = 0
        while forest.column[t, node] >= 0:
            node = 2 * node + 1 + (row[forest.column[t, node]] > forest.cut[t, node])
        return forest.path[t, node]

    rows = docs.orderBy("doc_id").collect()
    stats = np.array([quality.statistics((r.text or "").encode()) for r in rows])
    x = quality.features(stats)
    kept = []
    for s, row in zip(stats, x, strict=True):
        sound = s[0] >= 10 and 100 * s[4] <= 20 * s[0]
        scores = [2 ** (-np.mean([depth(f, t, row[columns]) for t in range(len(f.column))]) / f.norm) for columns, f, _ in model.forests]
        kept.append(bool(sound and all(a <= cut for a, (_, _, cut) in zip(scores, model.forests, strict=True))))
    got = {r.doc_id: r.kept for r in quality.measure(docs, model).collect()}
    assert got == {r.doc_id: k for r, k in zip(rows, kept, strict=True)}
    judged = {r.doc_id: r.q == 1 for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).collect()}
    at = [k for k, r in enumerate(rows) if r.doc_id in judged]
    again = quality.fit(stats[at], np.array([judged[rows[k].doc_id] for k in at]))
    assert [(c, round(cut, 9)) for c, _, cut in again.forests] == [(c, round(cut, 9)) for c, _, cut in model.forests] or len(again.forests) == len(model.forests)


def test_training_on_repeated_ids(spark):
    """Of the texts of one id the least is learnt from, in any order of the rows."""
    rnd = random.Random(7)
    rows = [(i % 50, prose(rnd, rnd.randint(10, 60)) + " ***" * rnd.randint(0, 30)) for i in range(150)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    models = [quality.train(spark.createDataFrame(x, "doc_id bigint, text string"), labels) for x in (rows, rows[::-1])]
    assert [(c, cut) for c, _, cut in models[0].forests] == [(c, cut) for c, _, cut in models[1].forests]


def test_very_long_texts(spark):
    """A text of some megabytes goes through the small operators whole."""
    text = prose(random.Random(1), 300_000)
    df = spark.createDataFrame([(1, text), (2, "short one")], "doc_id bigint, text string")
    row = quality.measure(df, quality.Model()).where("doc_id = 1").first()
    assert row.n_words == 300_000 and row.word_chars == len(text) - 299_999
    assert {r.doc_id: r.size for r in sharding.shard_documents(df).collect()} == {1: len(text) + 16, 2: 25}
    assert {r.doc_id: r.n_tokens for r in lm.cross_entropy_difference(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()} == {1: 300_000, 2: 2}


# -- sharding


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, 7)
    got = rows.collect()
    want = Counter((i, len(x.encode()) + 16, zlib.crc32(x.encode())) for i, x in texts_of(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.grown_shard in (r.shard, 7) for r in got) and {r.law for r in got} == {"key"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_documents(docs.limit(0), 7).count() == 0


def test_tree_moves_rows_only_into_what_grew(spark):
    """A further shard takes rows only into itself; a heavier one draws them down its own path; the levels draw by themselves."""
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    with_old = sharding.with_shard(ids, "doc_id", 40)
    with_two = sharding.with_shard(sharding.with_shard(with_old, "doc_id", 41, prefix="g_"), "doc_id", 42, prefix="h_")
    both = sharding.with_shard(with_two, "doc_id", 40, [1.0] * 11 + [3.0] + [1.0] * 28, prefix="w_").collect()
    assert all(r.g_shard in (r.shard, 40) and r.h_shard in (r.g_shard, 41) for r in both)
    assert 380 < sum(r.g_shard == 40 for r in both) < 600
    counts = Counter(r.shard for r in both)
    assert len(counts) == 40 and max(counts.values()) < 1.25 * 500 and 1100 < Counter(r.w_shard for r in both)[11] < 1750
    assert all(r.rack == r.shard // 4 and r.region == r.rack // 2 and r.w_rack == r.w_shard // 4 and r.w_region == r.w_rack // 2 for r in both)
    moved = [r for r in both if r.w_shard != r.shard]
    assert all(r.w_region == 1 for r in moved)  # into the region of shard 11
    assert all(r.w_rack == 2 for r in moved if r.region == 1)  # within it, into its rack
    assert all(r.w_shard == 11 for r in moved if r.rack == 2)  # within that, into itself
    assert any(r.w_shard != 11 for r in moved)


def test_tree_is_no_flat_draw(spark):
    """A descent differs from one draw over all shards, and follows each level's own draws."""
    weights = [1.0 + i % 3 for i in range(40)]
    rows = sharding.with_shard(spark.range(3000).withColumnRenamed("id", "doc_id"), "doc_id", 40, weights)
    flat = F.array_min(F.array(*[F.struct(sharding.draw(F.col("doc_id"), 2, F.lit(i), F.lit(w)).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))["i"]
    got = rows.withColumn("flat", flat).collect()
    assert sum(r.flat != r.shard for r in got) > 1500
    pick = lambda level, children: F.array_min(F.array(*[F.struct(sharding.draw(F.col("doc_id"), level, F.lit(i), F.lit(w)).alias("d"), F.lit(i).alias("i")) for i, w in children]))["i"]
    region = pick(0, [(k, sum(weights[8 * k : 8 * k + 8])) for k in range(5)])
    assert rows.where(F.col("region") != region).count() == 0
    racks = [pick(1, [(j, sum(weights[4 * j : 4 * j + 4])) for j in (2 * k, 2 * k + 1)]) for k in range(5)]
    assert rows.where(F.col("rack") != F.get(F.array(*racks), F.col("region"))).count() == 0


# -- winnowing


def test_winnowing_selects_rightmost_minima(spark, docs):
    some = docs.where("doc_id < 64 or doc_id is null")
    got = {(r.doc_id, i): [tuple(x) for x in r.selected] for i, r in enumerate(winnowing.fingerprint(some).collect())}
    hashed = some.select(F.transform(winnowing.tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("ids")).select("ids", F.transform(F.sequence(F.lit(1), F.greatest(F.size("ids") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("ids", i, 5))).alias("g")).collect()
    for sel, r in zip(got.values(), hashed, strict=True):
        want = []
        if r.ids:
            g = [x & (1 << 64) - 1 for x in r.g]
            for i in range(max(1, len(g) - 7)):
                w = g[i : i + 8]
                low = min(h >> 31 for h in w)
                k = i + max(j for j, h in enumerate(w) if h >> 31 == low)
                if (low, k) not in want:
                    want.append((low, k))
        assert sel == want


def test_shared_runs_share_a_hash(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    run = words[:12]
    a, b = " ".join(words[100:160] + run + words[160:200]), " ".join(words[200:220] + run + words[220:300])
    x, y = ({h for h, _ in r.selected} for r in winnowing.fingerprint(spark.createDataFrame([(1, a), (2, b)], "doc_id int, text string")).collect())
    assert x & y


def test_texts_without_spaces_match_at_any_offset(spark):
    rnd = random.Random(6)
    made = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    passage = made(17)
    rows = [(k, made(100 + k) + passage + made(60)) for k in range(17)]
    first, *others = ({h for h, _ in r.selected} for r in winnowing.fingerprint(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert all(first & x for x in others)
    assert winnowing.compare(spark.createDataFrame(rows[:2], "doc_id int, text string")).where("near_next > 0").count() == 2
    (got,) = spark.createDataFrame([("ab " + "x" * 16 + "\n" + "y" * 17 + " c",)], "text string").select(winnowing.tokens(F.col("text")).alias("t")).collect()
    assert got.t == ["ab", "x" * 16, *"y" * 17, "c"]


def test_compare(spark, docs):
    rows = winnowing.compare(docs).collect()
    order = sorted(texts_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edited = Counter()
    for i, (k, x) in enumerate(order):
        h = len(x) // 2
        edited[k, len(x), hashlib.sha256((x[: len(x) - h] + order[(i + 1) % len(order)][1][:h]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == edited
    prints = {}
    for r, x in ((r, dict(order)[r.doc_id]) for r in rows if r.doc_id != 63):
        assert prints.setdefault(x, r.fingerprint) == r.fingerprint
    assert all(0 <= v <= 1 for r in rows for v in (r.near_edited, r.near_next))
    assert winnowing.compare(docs.limit(0)).count() == 0
    (one,) = winnowing.compare(docs.where("doc_id = 3")).collect()
    assert one.near_next == 1.0


def test_likeness_of_fingerprints(spark, docs):
    """The digests and likenesses are those of sets of selected hashes, of each text, its edited text and the next one."""
    some = docs.where("doc_id < 65").dropDuplicates(["doc_id"])
    texts = dict(texts_of(some))
    order = sorted(texts)
    edited = {k: texts[k][: len(texts[k]) - len(texts[k]) // 2] + texts[order[(i + 1) % len(order)]][: len(texts[k]) // 2] for i, k in enumerate(order)}
    sets = []
    for of in (texts, edited):
        rows = winnowing.fingerprint(spark.createDataFrame(list(of.items()), "doc_id bigint, text string")).collect()
        sets.append({r.doc_id: {x.hash for x in r.selected} for r in rows})
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in winnowing.compare(some).collect()}
    for i, k in enumerate(order):
        assert got[k].near_edited == pytest.approx(alike(sets[0][k], sets[1][k]))
        assert got[k].near_next == pytest.approx(alike(sets[0][k], sets[0][order[(i + 1) % len(order)]]))
        assert (got[k].fingerprint == got[k].edited_fingerprint) or texts[k] != edited[k]


# -- pieces


def test_pieces(spark, docs, sf):
    """The library's ids, of texts of every kind, and all texts again."""
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    m, lib = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(2)
    cases = ["", "a", "  Hello   world\n\nfoo\tbar é ñ 😀 ", "日本語テスト", " x", "\x00\x01", "aaa", "aaaaaaa", "  ", "▁"]
    cases += ["".join(rnd.choice("abcdefghijk  .,éß日\n") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    cases += ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    cases += ["a" * 5000, "=" * 3000, "日本" * 2000, " " * 2000 + "x", "é" * 513, "".join(rnd.choices("ABCDEFabcdef0123456789+/", k=50_000))]
    cases += ["".join(rnd.choices("theinraos", k=n)) for n in (511, 512, 513, 640, 896, 1400, 5000)]
    cases += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for x, ids in zip(cases, m.encode(cases), strict=True):
        assert ids.tolist() == lib.encode(x or "")
        assert m.decode(ids) == (x or "").replace("▁", " ")
    back = pieces.decode(pieces.encode(docs, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(texts_of(docs))
    want = Counter((i, zlib.crc32(np.array(lib.encode(x), "<i4").tobytes())) for i, x in texts_of(docs))
    assert Counter((r.doc_id, r.ids_crc32) for r in back) == want
    assert pieces.decode(pieces.encode(docs.limit(0), path), path).count() == 0


def test_long_parts_in_time():
    """A megabyte without spaces, at random and as a run."""
    import time

    m, began = pieces.PieceModel(vocabulary("piece_bpe_32k.model")), time.time()
    m.encode(["".join(random.Random(3).choices("abcdefghij/+0123", k=1_000_000)), "z" * 1_000_000])
    assert time.time() - began < 120


# -- packing


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(4)
    for _ in range(30):
        sizes = [rnd.randint(1, 64) for _ in range(rnd.randint(0, 200))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fits = [g for g in gaps if g >= s]
            gaps.remove(min(fits)) if fits else None
            gaps.append((min(fits) if fits else 64) - s)
        rows = packing.plan(Counter(sizes), 64)
        assert len({r[5] + (k // r[3]) for r in rows for k in range(r[2] - r[1])}) == len(gaps)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs.withColumn("text", F.when(F.col("doc_id") == 7, "it's <|endoftext|> 日本 ÀÉ½ don't!!'s").otherwise(F.col("text"))), path).collect()
    want = Counter()
    for k, x in texts_of(docs):
        x = "it's <|endoftext|> 日本 ÀÉ½ don't!!'s" if k == 7 else x
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[k, p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)  # no more than needed here
    assert packing.pack_documents(docs.limit(0), path).count() == 0


# -- WARC

PAGES = "page_id bigint, url string, html string, refers_to string"


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 300_000
    rows = [(1, "http://a/", "same", "z"), (2, "http://b/", "same", "z"), (3, None, "é", "z"), (4, "http://d/\r\nX: y", None, "z"), (5, "http://e/", "", "z"), (6, "u", big, "z"), (None, "n", "same", "z")]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r for r in warc.round_trip(df, str(tmp_path)).collect()}
    largest = {"same": 2, "é": 3, "": 5, big: 6}
    for page_id, url, html, _ in rows:
        data = (html or "").encode()
        r = got[page_id]
        top = largest[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == top else ("revisit", top))
        assert r.payload == (data if page_id == top else None)
    assert warc.round_trip(df.limit(0), str(tmp_path)).count() == 0


def test_damaged_archives():
    import io

    ok = warc.page_record(1, "u", b"body", None, warc.digest(b"body")) + warc.page_record(2, "v", b"other", None, warc.digest(b"other"))
    read = lambda data: [r.payload for r in warc.records(io.BytesIO(data).read)]
    assert read(ok) == [b"body", b"other"] and read(b"") == []
    wrong = warc.page_record(1, "u", b"body", None, warc.digest(b"bodx"))
    for bad in (ok[:-5], ok[:20] + b"\xff" + ok[21:], wrong, ok + b"tail"):
        with pytest.raises(warc.WarcError):
            read(bad)


# -- HTML


@pytest.fixture(scope="module")
def page_model():
    return extraction.fit(extraction.labelled_pages())


def test_extraction_held_out(page_model):
    pages = extraction.labelled_pages(100, seed=1234)
    forest = extraction.Forest([htmltree.parse(p) for p, _ in pages])
    content, _ = forest.marginals(forest.x @ page_model.weights, page_model.pair)
    assert ((content > 0.5) == np.array([v for _, labels in pages for v in labels])).mean() > 0.97


def test_messages_equal_enumeration():
    tree = htmltree.parse("<div><p>a</p><ul><li>b</li></ul></div><p>c</p>")
    forest = extraction.Forest([tree])
    rnd = np.random.default_rng(0)
    unary, pair = rnd.normal(size=len(tree)), rnd.normal(size=(3, 2, 2))
    got, joint = forest.marginals(unary, pair)
    total, on = 0.0, np.zeros(len(tree))
    for state in range(1 << len(tree)):
        s = [state >> k & 1 for k in range(len(tree))]
        w = np.exp(sum(u for u, v in zip(unary, s, strict=True) if v) + sum(pair[forest.kind[k], s[forest.parent[k]], s[k]] for k in range(len(tree)) if forest.parent[k] >= 0))
        total, on = total + w, on + w * np.array(s)
    assert got == pytest.approx(on / total) and joint[1].sum() == pytest.approx(1)


def test_extraction(spark, page_model):
    body = "".join(f"<p>Sentence number {i} tells &amp; shows  some\nwords here.<br>And more, too.</p>" for i in range(4))
    page = f"<html><head><title>t</title><script>var a='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='ad'>Buy now.</div><article><h1>The <b>Ti</b>tle</h1>{body}<section class=comments><p>I disagree with all of this, sir.</p></section></article><footer>&copy; us</footer></body></html>"
    want = "The Title " + " ".join(f"Sentence number {i} tells & shows some words here. And more, too." for i in range(4))
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>" * 2000 + "deep"), (5, "x", "<div <<>> & &bogus; <!-- open")]
    got = {r.page_id: r for r in extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")), page_model).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and got[2].text == got[3].text == "" and got[2].url is None and len(got) == 5


@pytest.mark.parametrize("holder", ["{}", "<template>{}</template>", "<noscript>{}</noscript>"])
def test_raw_elements_hide_no_tags(holder):
    """What looks like a tag in a script, with an odd quote after it, takes no real tags with it."""
    script = holder.format("<script>for(i=0;i<len;i++) // don't\n</script>")
    body = "<nav>Home</nav><article><p>It's the first.</p><p>The second.</p></article><footer>Us</footer>"
    tree, plain = htmltree.parse(f"{script}{body}"), htmltree.parse(body)
    assert [(x.tag, x.parent, [t for _, t in x.pieces]) for x in tree] == [(x.tag, x.parent, [t for _, t in x.pieces]) for x in plain]
    assert [x.tag for x in tree] == ["html", "nav", "article", "p", "p", "footer"]


def test_deep_pages_keep_their_tree(page_model):
    """Blocks at any depth have nodes and close their own; a page far deeper than any real one ends."""
    deep = 400
    tree = htmltree.parse("<div>" * deep + "<p>first</p><p>second</p>" + "</div>" * (deep - 1) + "<nav>menu</nav></div>")
    (nav,) = (k for k, x in enumerate(tree) if x.tag == "nav")
    assert [x.depth for x in tree if x.tag == "p"] == [deep + 1] * 2 and tree[nav].depth == 2 and tree[nav].parent == 1
    assert htmltree.joined(tree, [True] * len(tree)) == "first second menu"
    assert len(page_model.texts(["<div>" * 20_000 + "deep" + "<p>p</div>" * 20_000])) == 1


@pytest.mark.parametrize("tag", sorted(htmltree.SILENT - htmltree.RAW))
def test_unclosed_silent_elements_end(tag):
    """One that is never closed takes at most the rest of its own block along; closed ones hide what is in them."""
    words = lambda page: htmltree.joined(tree := htmltree.parse(page), [True] * len(tree))
    assert words(f"<article><p>One.</p><{tag}><p>Two.</p></article><p>Three.</p>") == "One. Two. Three."
    assert words(f"<div>A<{tag}>x<span>y</span></{tag}>B</div>") == "AB"
    shut = words(f"<article><p>One.</p><{tag}><p>Two.</p></article><div><p>Three.</p><{tag}>x</{tag}>Four.</div>")
    assert shut == "One. Two. Three. Four."
    assert words(f"<article><p>One.</p><p>Two <{tag}> three.</p><p>Four <{tag}>x</{tag}> five.</p></article>") == "One. Two three. Four five."
    assert words(f"<article><p>One.</p><{tag}><p>Two.</p><{tag}>x</{tag}><p>Three.</p></article>") == "One. Two. Three."


@pytest.mark.parametrize(
    ("odd", "shown"),
    [
        ("<!-->", ""),
        ("<!--->", ""),
        ("<!-- a --!>", ""),
        ("<!-- <p>hidden</p> -->", ""),
        ("<script src=http://a/>var a=1;</script>", ""),
        ("<script src='a'/>var a=1;</script>", ""),
        ("<style/>p{}</style>", ""),
        ("<iframe src=x />", ""),
        ("<iframe src=x>", ""),
        ("<textarea>", ""),
        ("<title>", ""),
        ("<svg width=1/>", ""),
        ("<svg width='1'/>", ""),
        ("<svg><path d='M1'/><text>no</text></svg>", ""),
        ("<object><object>no</object>no</object>", ""),
        ("<video><p>no</p></video>", ""),
        ("</object>", ""),
        ("<object data=a><div>Kept.</div>", "Kept."),
        ("<select><option>no</select>", ""),
    ],
)
def test_odd_elements_lose_no_text(odd, shown):
    """Whatever stands between an article's paragraphs, their text stays and that of scripts doesn't come out."""
    page = f"<body><article><p>First.</p>{odd}<p>Middle.</p></article><div><p>Next.</p><object>no</object><iframe></iframe><textarea>no</textarea><svg></svg><title>no</title></div><p>Last.</p></body>"
    tree = htmltree.parse(page)
    assert htmltree.joined(tree, [True] * len(tree)) == " ".join(f"First. {shown} Middle. Next. Last.".split())


def test_many_unclosed_elements_take_linear_time():
    tree = htmltree.parse("<article>" + "<object><p>x</p>" * 50_000 + "</article>")
    assert len(htmltree.joined(tree, [True] * len(tree)).split()) == 50_000


def test_quotes_that_open_no_value():
    tree = htmltree.parse("<div><p title=it's>It's one.</p><p class='a b' title=\"x > y\">Two.</p><img alt=don't><p>Three.</p></div>")
    assert htmltree.joined(tree, [True] * len(tree)) == "It's one. Two. Three." and tree[3].names == "a b"


def test_a_very_long_page(page_model):
    body = "".join(f"<p>Sentence number {i} shows some words here, and a few more of them.</p>" for i in range(40_000))
    (text,) = page_model.texts([f"<body><nav><a href=/>Home</a></nav><article>{body}</article></body>"])
    assert text.count("Sentence number") == 40_000


def test_formulas_are_text():
    tree = htmltree.parse("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>")
    assert htmltree.joined(tree, [True] * len(tree)) == "so x=1 holds"


# -- language models


def test_lm_rows(spark, docs):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(60)] + [(1, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = lm.cross_entropy_difference(docs, labels).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((k, len(x.encode().split())) for k, x in texts_of(docs))
    assert all((r.score is None) == (r.n_tokens == 0) for r in rows)
    assert lm.cross_entropy_difference(docs.limit(0), labels.limit(0)).count() == 0


def test_lm_prefers_the_target(spark):
    rnd = random.Random(9)
    mine, other = [f"m{i}" for i in range(40)], [f"o{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(mine if i % 2 else other, k=60))) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()}
    assert max(got[i] for i in range(41, 80, 2)) < min(got[i] for i in range(40, 80, 2))


def test_lm_counts_each_word_bigram(spark):
    """The losses are those of plain bigram counts over real words, a great many of them."""
    import math
    from collections import Counter

    rnd = random.Random(4)
    rows = [(i, " ".join([f"w{i}x{k}" for k in range(2000)] + rnd.choices(["Alpha", "beta", "alpha", "Straße"], k=300))) for i in range(140)]
    rows += [(140, None), (141, " \n"), (None, "alpha beta"), (3, "beta beta alpha")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 1), (None, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    words = [(x or "").lower().split() for _, x in rows]
    own = [k is not None and k < 60 and k % 2 == 1 and k != 1 for k, _ in rows]
    losses, distinct = [], len({w for x in words for w in x})
    assert distinct > 1 << 18
    for among in (own, [True] * len(rows)):
        single, before, pair = Counter(), Counter(), Counter()
        for x, use in zip(words, among, strict=True):
            if use:
                single.update(x), before.update([None, *x][: len(x)]), pair.update(zip([None, *x], x))
        total = single.total()
        p = lambda b: (single[b] + lm.ALPHA) / (total + lm.ALPHA * distinct)  # noqa: E731, B023
        losses.append([sum(-math.log(lm.MIX * pair[a, b] / before[a] + (1 - lm.MIX) * p(b) if before[a] else p(b)) for a, b in zip([None, *x], x)) / len(x) if x else None for x in words])
    want = sorted(((k, len(x), t, g) for (k, _), x, t, g in zip(rows, words, *losses, strict=True)), key=repr)
    got = sorted((tuple(r)[:4] for r in lm.cross_entropy_difference(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()), key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [v for x in got for v in x[2:]] == [v if v is None else pytest.approx(v) for x in want for v in x[2:]]
