"""Groups and links by numpy, and parts tokenised as one text."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

from adspectra.llm import alignment

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", None, "one", " ", "  two  spaces \n\n end  ", "a\u2581b", "\u00e9t\u00e9 e\u0301 \ufb01 \uff21\uff22 \u2026 x\u00b2", "\u4e2d\u6587\u6587\u672c\u3002\u3000\u7b2c\u4e8c", "<|endoftext|> </s> <s>", "\U0001f600 \U0001f600\u200d\U0001f525", "x" * 700 + " y", "1234567 12.5 a_b__c", "tab\tand\r\nline", "\u00a0nb\u00a0 sp", "\x00\x01 z"]


def test_groups_and_links_are_those_of_the_functions(spark, sf):
    """Rows of many texts at once against one text at a time, by Spark's functions."""
    odd = spark.createDataFrame(list(enumerate(ODD, -len(ODD))), "doc_id bigint, text string")
    docs = odd.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).coalesce(1)
    size_b = 32000
    slow = alignment.links(alignment.group_text(alignment.aligned(alignment.tokenized(docs, A, B))), size_b)
    want = slow.select("doc_id", F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b"), "n_groups", "group_text", "links").collect()
    got = {r.doc_id: r for r in alignment.linked(docs, A, B, size_b).collect()}
    assert len(got) == len(want) and sum(len(r.links) for r in want) > 10000
    for r in want:
        x = got[r.doc_id]
        assert (x.n_a, x.n_b, x.n_groups, x.links) == (r.n_a, r.n_b, r.n_groups, r.links)
        assert x.groups_sha256 == (hashlib.sha256(r.group_text.encode()).hexdigest() if r.n_a else "")


def test_plan_of_align_has_no_function_of_each_token(spark, sf):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = alignment.linked(docs, A, B, 32000)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_parts_as_one_text_are_parts_by_themselves(spark, sf):
    """Ids of parts joined, with some among them that the tokens don't give back, as of each part alone."""
    texts = [x for x in ODD if x] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text]
    parts = sorted({p for x in texts for p in alignment.PART.findall(" " + x)} | {" a" + alignment.SIGN + "b"})
    joined, each = alignment.TokenPair(A, B), alignment.TokenPair(A, B)
    joined._learn(parts)
    each._learn_each(parts)
    assert len(parts) > 3000 and None in each.by_a.values()
    assert joined.by_a == each.by_a and all(joined.by_b[p] == each.by_b[p] for p in parts if each.by_a[p] is not None)
