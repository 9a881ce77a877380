"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, packing.

Each stage works on all rows that the one before kept; all but the last return the columns of documents, whatever they are
called, and only ``text`` and ``n_chars`` are ever changed.

Defined cases, stage by stage:

* null, empty and blank texts have fewer than ten words, so quality rules drop them; later stages, given them, keep one of
  them as the group of texts without words, leave them as they are, and pack the closing id alone;
* a null id is no label's; its row stays where its group of near-duplicates has no row with an id; it sorts first among repeats;
* rows that repeat an id and a text: one stays in near-duplicates; rows of one id with different texts are near-duplicates or
  not by their texts, and one row of each id that names a group stays;
* of ties (equal texts, equal fingerprints) the least id stays;
* very long texts are worked on whole;
* columns of any other name pass through untouched; an empty table gives empty stages and no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adspectra.llm import packing, quality, simhash, substrings
from adspectra.llm.common import dropped, stored, table
from adspectra.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the forests keep."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least id.

    Near-duplicates are texts whose fingerprints of 4-word shingles differ in at most 4 bits, and what such links
    chain together. This is not a bound on similarity: the README gives the share of similar pairs it finds.
    """
    return simhash.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 100 bytes that start earlier too."""
    return substrings.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the forests, the similarity links or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in turn, each written below the shared folder and read again; a stage's table goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        dropped(*before)
        before = [docs]
    return docs
