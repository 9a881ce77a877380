"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

The tree has regions of racks of shards.  A subtree's weight is the sum of its shards' weights.  A
document descends from the root: among the children of where it stands it goes to the one of the
least exponential draw ``-ln(u) / weight``, with ``u`` from a hash of (document, level, child).  So a
level costs a draw per child there (5, 2 and 4 of 40 shards), and each child gets documents in proportion to its weight.

A changed weight changes draws only on the path from that shard to the root.  Documents move only
into that region (out of it, if its weight falls), and of those that stay in the region only into or out of that rack.  No
two other regions, racks or shards exchange documents.

Growth.  The tree is built over ``built`` shards.  Every further shard is a child of the root by
itself, a region of one rack of one shard, so it takes documents only into itself, from all others in proportion.
(Put into a region that has shards already, it would draw documents into the region, some of which would go to old shards.)

Law: ``key``.  The document's id and the number (and weights) of the shards decide; ``built`` is a constant
(of fewer shards than that, the tree holds all, and growth is counted from it).

Defined cases: a null id is a key like any other; null text has no bytes and the CRC of an empty
string; repeated rows share a shard and get different slots; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked_within

RACK_SHARDS, REGION_RACKS = 4, 2
#: Shards of the tree as it was built.
BUILT_SHARDS = 40
SIZE_OVERHEAD = 16


def draw(key: Column, level: int, child: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight``; ``u`` has 53 bits and is never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child), 11)
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def tree(weights: Sequence[float], built: int, rack_shards: int, region_racks: int) -> list[list[list[int]]]:
    """The shards of each rack of each region."""
    first = min(built, len(weights))
    racks = [list(range(i, min(i + rack_shards, first))) for i in range(0, first, rack_shards)]
    return [racks[i : i + region_racks] for i in range(0, len(racks), region_racks)] + [[[i]] for i in range(first, len(weights))]


def with_shard(df: DataFrame, key: str, n_shards: int, weights: Sequence[float] | None = None, prefix: str = "", rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS, built: int = BUILT_SHARDS) -> DataFrame:
    """Adds ``{prefix}region``, ``{prefix}rack`` and ``{prefix}shard`` by descending the tree; racks and shards are numbered through."""
    weights = [float(w) for w in (weights or [1.0] * n_shards)]
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("one positive weight per shard is needed")
    regions = tree(weights, built, rack_shards, region_racks)
    racks = [r for region in regions for r in region]
    weigh = lambda shards: sum(weights[i] for i in shards)

    def descend(df: DataFrame, level: int, parent: str | None, child: str, children: list[int], weights: list[float]) -> DataFrame:
        """children: how many each parent has; weights: of all children, parent by parent."""
        n, all_weights = F.array(*map(F.lit, children)), F.array(*map(F.lit, weights))
        if parent is None:
            first, count = F.lit(0), F.lit(children[0])
        else:
            starts = [sum(children[:k]) for k in range(len(children))]
            first, count = F.get(F.array(*map(F.lit, starts)), F.col(parent)), F.get(n, F.col(parent))
        among = F.transform(F.sequence(first, first + count - 1), lambda j: F.struct(draw(F.col(key), level, j, F.get(all_weights, j)).alias("draw"), j.alias("child")))
        return df.withColumn(child, F.array_min(among)["child"].cast("int"))

    df = descend(df, 0, None, f"{prefix}region", [len(regions)], [sum(map(weigh, r)) for r in regions])
    df = descend(df, 1, f"{prefix}region", f"{prefix}rack", [len(r) for r in regions], [weigh(r) for r in racks])
    return descend(df, 2, f"{prefix}rack", f"{prefix}shard", [len(r) for r in racks], weights)


def shard_documents(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard of every row.

    One scan of the texts gives rows of fixed width, which are written once; the slots then take
    two shuffles of those rows (see ``ranked_within``), none of text.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.octet_length(text) + SIZE_OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    built = min(BUILT_SHARDS, n_shards)
    base = with_shard(base, "doc_id", n_shards, weights, built=built)
    base = with_shard(base, "doc_id", n_shards + 1, [*(weights or [1.0] * n_shards), grown_weight], prefix="grown_", built=built).drop("grown_region", "grown_rack")
    spread = F.xxhash64("doc_id", "text_crc32", "size")
    placed = ranked_within(cut(base), ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "slot", spread)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", "slot", "grown_shard")
