"""Fill-in-middle, aligned tokenizers and language identification on small tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspectra.llm import alignment, infill, langid
from adspectra.llm.queries import vocabulary

DOCS = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    words = ["Alpha", "béta", "中文", "x1", "\U0001f600", "<P", ">", "don't", "\n", "  ", "▁", "\x00", "<|endoftext|>", "<0x41>"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice((" ", "", "\t")) for _ in range(rnd.randint(0, 40))), "en") for i in range(80)]
    rows += [(80, None, "en"), (81, "", None), (82, "a", "en"), (82, "a", "en"), (82, "other", "en"), (None, "no id at all", "en"), (83, "holds <M> itself", "en"), (84, "é", "fr"), (85, "ab 12 " * 60_000, "en"), (86, "z" * 300_000, "en"), (87, "  lead and trail  ", "en")]
    return spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("units", F.lit(1)).withColumn("form", F.lit(2))


# -- fill in the middle


def brute_arrangement(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.SENTINELS) or h3 % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_arrangements(docs):
    rows = infill.restore(infill.arrange(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    got = sorted(((r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in rows), key=key)
    assert got == sorted((brute_arrangement(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert all(r.restored == r.text for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_arrangements_by_other_parameters(docs):
    given = docs.select("doc_id", "text").where("doc_id < 80")
    for arranged, first, forms in ((100, 0, {"psm", "plain"}), (100, 100, {"spm", "plain"}), (0, 50, {"plain"})):
        rows = infill.restore(infill.arrange(given, "7", arranged, first, ("[pre]", "[suf]", "[mid]")), ("[pre]", "[suf]", "[mid]")).collect()
        assert {r.form for r in rows} <= forms and all(r.restored == r.text for r in rows)
    assert infill.arrange(docs.limit(0)).count() == 0


def test_arranging_shuffles_nothing(docs):
    plan = infill.restore(infill.arrange(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_arrangements_equal_their_sql(spark, sf):
    from oracle import assert_same

    from adspectra.llm.queries import ORACLES, op13_fill_in_middle

    assert_same(op13_fill_in_middle(spark, sf), ORACLES["op13_fill_in_middle"], sf)


# -- aligned tokenizers


def brute_tokens(texts):
    """Tokens of both libraries, whole texts at a time, as (id, bytes)."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    for text in texts:
        if not text:
            yield [], []
            continue
        of_a = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        yield (of_a, of_b) if b"".join(x for _, x in of_a) == b"".join(x for _, x in of_b) == whole else ([], [])


def brute_alignment(rows):
    found, counts = [], Counter()
    for (doc_id, _), (a, b) in zip(rows, brute_tokens([t for _, t in rows]), strict=True):
        spans = []
        for tokens in (a, b):
            at, own = 0, []
            for i, x in tokens:
                own.append((i, at, at := at + len(x)))
            spans.append(own)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        at, text, pairs, i, j = 0, [], [], 0, 0
        for end in ends:
            own = [[], []]
            while i < len(spans[0]) and spans[0][i][2] <= end:
                own[0].append(spans[0][i])
                i += 1
            while j < len(spans[1]) and spans[1][j][2] <= end:
                own[1].append(spans[1][j])
                j += 1
            text.append("|".join(",".join(str(x[0]) for x in side) for side in own))
            k = 0
            for x in own[0]:
                while own[1][k][2] <= x[1]:
                    k += 1
                m = k
                while m < len(own[1]) and own[1][m][1] < x[2]:
                    pairs.append((x[0], own[1][m][0]))
                    m += 1
        counts.update(pairs)
        found.append((doc_id, len(a), len(b), len(ends), pairs, hashlib.sha256(";".join(text).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(doc_id, a, b, g, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), text) for doc_id, a, b, g, pairs, text in found]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_aligned_tokens(spark, docs):
    rnd = random.Random(8)
    pieces = ["the", " ", "  ", "\n", " \n ", "\r\n", "\t", "'s", "'", "don't", "Ünï", "中文字", "👨\u200d👩", "12", "3.14", "<s>", "</s>", "<unk>", "<0x0A>", "\x1c", "\u00a0", "\u3000", "\u2028", "²", "e\u0301", "\ufeff", "zzz", "_", "-", ",", "%%%"]
    odd = [(100 + i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25))), None) for i in range(300)]
    given = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, DOCS)).withColumn("links", F.lit(0)).withColumn("chunk", F.lit(0))
    rows = [(r.doc_id, r.text) for r in given.collect()]
    got = alignment.align(given, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert set(got.columns) == set(ALIGNED)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.select(*ALIGNED).collect()), key=key) == sorted(brute_alignment(rows), key=key)
    assert alignment.align(given.limit(0), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 0


def test_groups_of_made_up_tokens(spark):
    """Ends that never meet but at the last byte make one group, whose links take no more steps than it has tokens."""
    n = 40_000
    tokens = spark.createDataFrame([(1, list(range(n + 1)), [*range(1, 2 * n, 2), 2 * n], list(range(n)), list(range(2, 2 * n + 1, 2))), (2, [7, 8], [1, 3], [5, 6], [1, 3]), (3, [], [], [], [])], "doc_id int, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>")
    rows = {r.doc_id: r for r in alignment.links(alignment.group_text(alignment.groups(alignment.aligned(tokens))), 1 << 16).collect()}
    assert [rows[i].n_groups for i in (1, 2, 3)] == [1, 2, 0] and len(rows[1].links) == 2 * n
    assert rows[1].links[:3] == [0, 1 << 16, (1 << 16) + 1] and rows[2].links == [(7 << 16) + 5, (8 << 16) + 6]
    assert [(g.a, g.b) for g in rows[2].groups] == [([7], [5]), ([8], [6])] and rows[2].group_text == "7|5;8|6" and rows[3].groups == []


# -- language identification


def test_codewords_keep_apart():
    for n in (2, 3, 4, 7, 8, 30):
        words = langid.codewords(n).astype(int)
        apart = (words.shape[1] - words @ words.T) // 2
        assert len(words) == n and (np.abs(words.sum(axis=0)) < n).all()
        assert apart[~np.eye(n, dtype=bool)].min() >= (2 ** (n - 2) if n <= langid.EXHAUSTIVE else words.shape[1] // 5)


def invented(n_languages, each, seed=0):
    """Texts of invented languages that share letters but not their frequent syllables."""
    rnd = random.Random(seed)
    syllables = [[rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") + rnd.choice(("", "n", "r", "s")) for _ in range(14)] for _ in range(n_languages)]
    draw = random.Random(seed + 1)
    return [(k * each + i, " ".join("".join(draw.choice(syllables[k]) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(8, 60))), f"l{k}") for k in range(n_languages) for i in range(each)]


@pytest.mark.parametrize("n_languages", [2, 4, 12])
def test_languages_of_held_out_texts(spark, n_languages):
    rows = spark.createDataFrame(invented(n_languages, 60), DOCS)
    fold = langid.held_out(F.col("doc_id"))
    found = langid.identify(rows, langid.train(rows.where(~fold))).join(rows.where(fold).select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 8 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_wrong_bits_are_corrected():
    """With the margins of two of seven bits turned round, the nearest codeword is still the language's."""
    words = langid.codewords(5)
    model = langid.Model(list("abcde"), words, np.zeros((1, words.shape[1])), np.zeros(words.shape[1]), np.ones(words.shape[1]))
    margins = 2.0 * words
    margins[:, [1, 5]] *= -1
    assert model.losses(margins).argmin(axis=1).tolist() == list(range(5))


def test_language_cases(spark, docs):
    learn = spark.createDataFrame(invented(3, 40), DOCS)
    model = langid.train(learn)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    und = {i for i, t in texts if not t or not re.search(r"[^\W\d_]", t)}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == und and all(r.score == 0 and r.ambiguous for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"und", "l0", "l1", "l2"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 82}) <= 2
    assert {r.lang_pred for r in langid.identify(docs, langid.train(learn.limit(0))).collect()} == {"und"}
    one = langid.identify(docs, langid.train(learn.where("lang = 'l1'"))).where("lang_pred <> 'und'").collect()
    assert one and all(r.lang_pred == "l1" and r.score == 1 and not r.ambiguous for r in one)
    assert langid.identify(docs.limit(0), model).count() == 0
    assert docs.select(langid.held_out(F.col("doc_id")).alias("h")).where("h is null").count() == 0


def test_sample_of_labelled_rows_is_bounded(spark):
    rows = spark.createDataFrame(invented(3, 50) + [(900 + i, "again and again", "l0") for i in range(200)] + [(1200, "none", None), (1201, "123", "l1"), (1202, None, "l1")], DOCS)
    got = langid.labelled(rows, each=20, sample=50).collect()
    assert len(got) == 50 and max(Counter(r.lang for r in got).values()) <= 20 and {r.lang for r in got} == {"l0", "l1", "l2"}
    assert sorted(map(tuple, langid.labelled(rows.repartition(5), each=20, sample=50).collect())) == sorted(map(tuple, got))


def test_languages_of_the_given_documents(spark, sf):
    from adspectra.llm.queries import op12_output_code_language_id

    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = op12_output_code_language_id(spark, sf).join(given, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert found and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
