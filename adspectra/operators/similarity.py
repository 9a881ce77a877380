"""Exact vector search in blocks, and what is built on it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side in a block of the grid.
BLOCK = 2048
LEAST_SIMILARITY, MOST_CHUNKS, NEIGHBOURS = 0.2, 3, 50


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def best_of(queries: np.ndarray, items: np.ndarray, sim: np.ndarray, k: int | None) -> pd.DataFrame:
    """(q, i, similarity) of each row's k best columns (all, without k), in no order; of equal similarities the least item's."""
    if k is None or k >= sim.shape[1]:
        row, col = (x.ravel() for x in np.indices(sim.shape))
    else:
        row, col = np.nonzero(sim >= np.partition(sim, -k, axis=1)[:, -k][:, None])
        order = np.lexsort((items[col], -sim[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
    return pd.DataFrame({"q": queries[row], "i": items[col], "similarity": sim[row, col]})


def similarities(queries: DataFrame, items: DataFrame, query: str, item: str, k: int | None, least: float | None = None) -> DataFrame:
    """(query, item, similarity) of each query's ``k`` nearest items (all, without k) of at least a similarity.

    Both sides are dealt into blocks and meet in a grid, so a task holds one block of each and
    sends on at most k rows per query; the best k of all blocks follow from a window.
    """
    spark = queries.sparkSession
    n_q, n_i = (max(1, -(-df.count() // BLOCK)) for df in (queries, items))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    q = queries.select(F.col(query).alias("q"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(query), F.lit(n_q)).alias("qb"), F.explode(every(n_i)).alias("ib"))
    i = items.select(F.col(item).alias("i"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(item), F.lit(n_i)).alias("ib"), F.explode(every(n_q)).alias("qb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "i": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        out = best_of(left["q"].to_numpy(), right["i"].to_numpy(), _unit(left["v"]) @ _unit(right["v"]).T, k)
        return out if least is None else out[out["similarity"] >= least]

    found = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(meet, "q bigint, i bigint, similarity double")
    if k is not None:
        best = Window.partitionBy("q").orderBy(F.desc("similarity"), "i")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.withColumnsRenamed({"q": query, "i": item})


def best_by_label(queries: DataFrame, items: DataFrame, query: str, item: str) -> DataFrame:
    """(query, label, similarity): of each query and label (a whole number, or null) the best similarity of an item of that label.

    Blocks meet as in ``similarities``; each block sends on a row for each query and label, so similarities of pairs stay where they are worked out.
    """
    n_q, n_i = (max(1, -(-df.count() // BLOCK)) for df in (queries, items))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    q = queries.select(F.col(query).alias("q"), F.col("embedding").alias("v"), F.pmod(F.xxhash64(query), F.lit(n_q)).alias("qb"), F.explode(every(n_i)).alias("ib"))
    i = items.select("label", F.col("embedding").alias("v"), F.pmod(F.xxhash64(item), F.lit(n_i)).alias("ib"), F.explode(every(n_q)).alias("qb"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "label": pd.Series(dtype="Int64"), "similarity": pd.Series(dtype="float64")})
        right = right.sort_values("label", ignore_index=True)
        labels, code = right["label"].astype("Int64"), right["label"].factorize(use_na_sentinel=False)[0]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        best = np.maximum.reduceat(_unit(left["v"]) @ _unit(right["v"]).T, start, axis=1)
        return pd.DataFrame({"q": np.repeat(left["q"].to_numpy(), len(start)), "label": pd.concat([labels.iloc[start]] * len(left), ignore_index=True), "similarity": best.ravel()})

    found = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(meet, "q bigint, label bigint, similarity double")
    return found.groupBy(F.col("q").alias(query), F.col("label").cast(items.schema["label"].dataType).alias("label")).agg(F.max("similarity").alias("similarity"))


def knn(queries: DataFrame, items: DataFrame, query: str, item: str, k: int = NEIGHBOURS) -> DataFrame:
    return similarities(queries, items, query, item, k)


def similar(queries: DataFrame, items: DataFrame, query: str, item: str, threshold: float, limit: int) -> DataFrame:
    """The nearest items of at least a similarity."""
    return similarities(queries, items, query, item, limit, threshold)


def rank_ads(chunks: DataFrame, ads: DataFrame, candidates: DataFrame | Callable[[DataFrame], DataFrame] | None = None, k: int = NEIGHBOURS, least: float = LEAST_SIMILARITY, chunks_per_page: int = MOST_CHUNKS) -> DataFrame:
    """Each page's ads by their best similarity to the page's vector (chunk_index null) or its first chunks.

    The search is over all ads and only then cut to the candidates (page_id, ad_id, or what tells them among pairs that were found), so fewer than k may be left.
    """
    used = chunks.where(F.col("chunk_index").isNull() | (F.col("chunk_index") < chunks_per_page)).withColumn("chunk_id", F.xxhash64("page_id", "chunk_index"))
    near = knn(used, ads, "chunk_id", "ad_id", k).where(F.col("similarity") >= least)
    best = near.join(used.select("chunk_id", "page_id"), "chunk_id").groupBy("page_id", "ad_id").agg(F.max("similarity").alias("similarity"))
    if candidates is not None:
        given = candidates(best) if callable(candidates) else candidates
        best = best.join(given.select("page_id", "ad_id"), ["page_id", "ad_id"], "left_semi")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("similarity"), "ad_id")))


def mean_vector(vectors: DataFrame, key: str) -> DataFrame:
    """The mean of each key's vectors, by position."""
    each = vectors.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))
