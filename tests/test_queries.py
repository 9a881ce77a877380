"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import assert_same

import __spark_entry__ as entry
from adspectra.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_keywords_of_every_document(spark, sf):
    """Texts of all languages have keywords: each that has a word of three letters that is no stop word."""
    import re

    from adspectra.operators.textprep import STOP_WORDS

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = {r.doc_id for r in docs if any(len(w) > 2 and w not in STOP_WORDS for w in re.split(r"[\W_]+", (r.text or "").lower()))}
    assert len({r.lang for r in docs if r.doc_id in want}) > 1
    assert {r.doc_id for r in QUERIES["keyword_extraction"](spark, sf).select("doc_id").distinct().collect()} == want
