"""The queries op1_ to op13_: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, extraction, infill, langid, lm, packing, pieces, quality, sharding, simhash, substrings, warc, winnowing
from .common import table

#: Where the vocabulary files are; None: the installed ``public_tokenizers``.
TOKENIZERS: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_isolation_forest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.measure(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(table(spark, sf_dir, "documents"))


def op5_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids again."""
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    back = pieces.decode(pieces.encode(docs, path), path)
    return back.select("doc_id", "n_ids", "ids_crc32", F.char_length("text").alias("n_decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_dom_model_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_output_code_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.train(docs.where(F.col("doc_id").isNotNull() & ~fold)))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score", "ambiguous")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arranges every text and restores it from the arrangement."""
    back = infill.restore(infill.arrange(table(spark, sf_dir, "documents")))
    lengths = [F.char_length(x).cast("long").alias(f"{x}_chars") for x in ("prefix", "middle")]
    return back.select("doc_id", "n", "form", *lengths, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_isolation_forest_quality, op2_hash_tree_sharding, op3_simhash_near_dedup, op4_winnowing_fingerprints, op5_viterbi_pieces, op6_suffix_array_dedup, op7_best_fit_packing, op8_dom_model_extraction, op9_warc_round_trip, op10_cross_entropy_difference, op11_token_alignment, op12_output_code_language_id, op13_fill_in_middle)}
#: Base 32 of a SHA-1 from its hexadecimal digits: 32 groups of five bits, each out of two digits.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS top FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((((strpos('0123456789abcdef', substr(s, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) * 16 + strpos('0123456789abcdef', substr(s, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g
"""
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a+1:b], ''), '') AS mid, coalesce(array_to_string(u[b+1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
ORACLES: dict[str, str] = {"op9_warc_round_trip": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
