"""Taxonomy trees and mappings, and classification by walking down a tree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAT = "id string, parent_id string, name string, tier int"


def flat_taxonomy(spark: SparkSession, nodes: list[dict]) -> DataFrame:
    """(id, parent_id, name, tier) of nested nodes, to any depth: each round takes the children out of the tier above."""
    root = spark.createDataFrame([(json.dumps(nodes),)], "tree string")
    field = lambda name, kind: F.try_variant_get("node", f"$.{name}", kind).alias(name)
    level = root.select(F.lit(None).cast("string").alias("parent_id"), F.explode(F.try_variant_get(F.parse_json("tree"), "$", "array<variant>")).alias("node"))
    out = None
    while not level.isEmpty():
        rows = level.select(field("id", "string"), "parent_id", field("name", "string"), field("tier", "int"))
        out = rows if out is None else out.unionByName(rows)
        level = level.select(field("id", "string"), F.explode(field("children", "array<variant>")).alias("node")).withColumnRenamed("id", "parent_id")
    return in_order(spark.createDataFrame([], FLAT) if out is None else out)


def in_order(flat: DataFrame) -> DataFrame:
    return flat.orderBy("tier", F.col("id").try_cast("int"), "id")


def nested(flat: list[tuple]) -> list[dict]:
    """The tree of flat rows; a node that is its own parent is a root."""
    nodes = {i: {"id": i, "name": name, "tier": tier, "children": []} for i, _, name, tier in flat}
    roots = []
    for i, parent, _, _ in flat:
        (nodes[parent]["children"] if parent in nodes and parent != i else roots).append(nodes[i])
    return roots


def children(flat: DataFrame, parent: str | None = None, tier: int | None = None) -> DataFrame:
    """The nodes of a parent, of a tier, or both."""
    rows = flat if parent is None else flat.where((F.col("parent_id") == parent) & (F.col("id") != parent))
    return rows if tier is None else rows.where(F.col("tier") == tier)


def with_paths(flat: DataFrame) -> DataFrame:
    """Adds ``path`` (names from the root); nodes that no root reaches are left out.

    Every node knows the names up to some ancestor; each round joins it with what that ancestor knows, so a tree of
    any depth d takes log2(d) rounds. Each round is kept, so that it is worked out once. Nodes on a cycle never get to
    a root: after as many rounds as the number of nodes has bits, what still looks for an ancestor is one of them.
    """
    root = F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id"))
    reach = flat.withColumns({"path": F.array("name"), "up": F.when(~root, F.col("parent_id"))}).persist()
    for _ in range(flat.count().bit_length()):
        if reach.where("up is not null").isEmpty():
            break
        known = reach.select(F.col("id").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"))
        further = reach.where("up is not null").join(known, "up").withColumns({"path": F.concat("head", "path"), "up": F.col("next")})
        reach = reach.where("up is null").unionByName(further.select(reach.columns)).persist()
    return reach.where("up is null").drop("up")


def with_tiers(topics: DataFrame, flat: DataFrame) -> DataFrame:
    """Topics (topic_id, relevance_score and other columns) with their tier in the taxonomy; others are left out."""
    tiers = flat.select(F.col("id").alias("topic_id"), "tier")
    return topics.join(tiers, "topic_id").select(*(c for c in topics.columns if c != "relevance_score"), "tier", "relevance_score")


def merged_mapping(product_to_content: DataFrame, content_to_product: DataFrame) -> DataFrame:
    """(product_id, content_id) pairs of both directions, once each; ids stay text."""
    return product_to_content.select("product_id", "content_id").unionByName(content_to_product.select("product_id", "content_id")).distinct()


def numeric_ids(mapping: DataFrame) -> DataFrame:
    """Pairs whose ids are numbers over 0."""
    return mapping.where((F.col("product_id").try_cast("int") > 0) & (F.col("content_id").try_cast("int") > 0))


def leading(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows among which are each group's best ``n``: those of each batch, so that what has to be sorted and shuffled is a small part."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(["score", "id"], ascending=[False, True], na_position="first").groupby(by, dropna=False, sort=False).head(n)

    return scored.mapInPandas(cut, scored.schema)


def walk(scored: DataFrame, key: str, threshold: float, top_k: int = 2, paths: int = 5, tiers: int = 4) -> DataFrame:
    """(key, leaf_id, score, path): the best paths down the tree.

    scored: key, id, parent_id, tier, score.  From the best ``top_k`` roots of at least the
    threshold a path goes on through the best children of at least the threshold; where there is
    none it ends.  A path's score is the product of its nodes'; of paths to one leaf the best stays.
    """

    def best(df: DataFrame, *by: str) -> DataFrame:
        able = leading(df.where(F.col("score") >= threshold), [key, *by], top_k)
        return able.withColumn("r", F.row_number().over(Window.partitionBy(key, *by).orderBy(F.desc("score"), "id"))).where(F.col("r") <= top_k).drop("r")

    branch = best(scored.where("tier = 1")).select(key, F.col("id").alias("leaf_id"), F.col("score").alias("cum"), F.array("id").alias("path"))
    for tier in range(2, tiers + 1):
        children = best(scored.where(F.col("tier") == tier), "parent_id").select(key, F.col("parent_id").alias("leaf_id"), F.col("id").alias("child"), F.col("score").alias("s"))
        joined = branch.join(children, [key, "leaf_id"], "left")
        on = F.col("child").isNotNull()
        branch = joined.select(key, F.coalesce("child", "leaf_id").alias("leaf_id"), F.when(on, F.col("cum") * F.col("s")).otherwise(F.col("cum")).alias("cum"), F.when(on, F.concat("path", F.array("child"))).otherwise(F.col("path")).alias("path"))
    leaves = branch.groupBy(key, "leaf_id").agg(F.max_by(F.struct("cum", "path"), "cum").alias("b")).select(key, "leaf_id", F.col("b.cum").alias("score"), F.col("b.path").alias("path"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "leaf_id")
    return leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths)


def tier_scores(chunk_scores: DataFrame, key: str, mean: bool = True) -> DataFrame:
    """The scores (key, chunk, id, parent_id, tier, score) of a text's chunks as scores of the text: their mean, or their maximum."""
    return chunk_scores.groupBy(key, "id", "parent_id", "tier").agg((F.avg if mean else F.max)("score").alias("score"))


def column_scores(chunk_scores: DataFrame, scores: list[str], mean: bool = True) -> DataFrame:
    """As ``tier_scores``, of rows that hold a node's scores of a text's chunks in columns: nothing is grouped. Nulls don't count; ``score`` is null without any."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in scores), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in scores), F.lit(0))
    return chunk_scores.withColumn("score", total / F.nullif(known, F.lit(0)) if mean else F.greatest(*scores)).drop(*scores)


def first_wins(topics: DataFrame, key: str) -> DataFrame:
    """One entry per topic id of each key: the first by position."""
    return topics.groupBy(key, "topic_id").agg(F.min_by(F.struct("tier", "relevance_score"), "pos").alias("t")).select(key, "topic_id", "t.*")
