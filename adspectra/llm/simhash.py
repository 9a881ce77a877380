"""SimHash near-duplicates found in vantage-point trees.

Fingerprint: a text's A-Z are lower-cased, its words (runs of bytes other than ASCII white space)
taken in shingles joined by spaces, repeats included; a bit is 1 if it is set in over half of the
shingles' XXH64 (seed 42).  A shorter text is one shingle; one without words has fingerprint 0.

Links: two fingerprints link at ``RADIUS`` or fewer differing bits.  The 64 bits are cut into
``BLOCKS`` blocks; of two linked fingerprints at least one block differs in at most
``RADIUS // BLOCKS`` bits, so each block is a Hamming space of its own that is searched with that
small radius and whose finds are then checked over all bits.  No pair is lost.

Search: a block's space is partitioned by a vantage-point tree.  A node holds a vantage value and
a distance ``cut``; values within the cut go left, others right.  A query visits a side only if the triangle
bound allows a find there: left if its distance is at most cut + radius, right if it is over
cut - radius.  The top of the tree is grown from a bounded sample of the distinct fingerprints,
its depth from their number, and is all that is broadcast.  Every distinct fingerprint goes to its
home shard, and as a query to each shard that its ball overlaps.  Within a shard the same descent
goes on over arrays, homes and queries together, until few are left to compare.  Where many have one
value in the block, so that no vantage divides them, the other bits are cut into ``RADIUS + 1`` parts, of which two linked
fingerprints have at least one in common, and only those of one part value go on together.  Links inside a
shard are reduced to a spanning forest (no group is ever emitted as all its pairs) and the
components over all shards are found by ``components``.

Equal fingerprints are one node, so a large group of copies costs one row.

Defined cases: null text is a text without words; a null id takes part in links but never names a
component that has another id; repeated rows get equal results; an empty table gives an empty result; other
columns are ignored by ``fingerprints`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, parts, raw
from .components import roots

SHINGLE, SEED, RADIUS = 4, 42, 4
BLOCKS = 3
#: Least number of distinct fingerprints that the trees' tops are grown from.
LEAST_SAMPLE = 4096
#: Distinct fingerprints to a home shard, and the pairs that are compared at once within one.
SHARD, PAIRS = 12_000, 1 << 19
#: Most levels of a tree's top (for some 1.6 billion distinct fingerprints; beyond, shards grow), and sampled fingerprints for each leaf of it.
TOP, LEAF_SAMPLE = 17, 8


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = [*ends[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fp = np.array([simhash(x, shingle) for x in raw(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(hashed, own)


def tagged(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows with all their columns and their fingerprint as ``__asx_fp``."""
    own = T.StructType([*docs.schema.fields, T.StructField("__asx_fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            fp = np.array([simhash(x, shingle) for x in raw(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], own.names)

    return docs.mapInArrow(hashed, own)


def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def distance(values: np.ndarray, vantage: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ vantage) & mask)


def vantage(values: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """A vantage value and the cut that halves the values best; None if no value tried divides them."""
    best = None
    for v in values[np.linspace(0, len(values) - 1, min(8, len(values))).astype(int)]:
        counts = np.cumsum(np.bincount(distance(values, v, mask), minlength=65))
        at = int(np.argmin(np.abs(counts - len(values) / 2)))
        side = min(counts[at], len(values) - counts[at])
        if side and (best is None or side > best[0]):
            best = (side, v, at)
    return best and best[1:]


def grow(values: np.ndarray, mask: np.uint64, depth: int) -> list:
    """A tree's top as nested [vantage, cut, left, right]; a leaf is None."""
    found = vantage(values, mask) if depth and len(values) > 1 else None
    if found is None:
        return None
    near = distance(values, found[0], mask) <= found[1]
    return [int(found[0]), found[1], grow(values[near], mask, depth - 1), grow(values[~near], mask, depth - 1)]


def deal(tree: list | None, values: np.ndarray, mask: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, leaf, is home) of every visit: each value at its home leaf, and at later leaves that its ball overlaps.

    A pair whose homes differ meets at the later of the two, where one is home and one a query.
    """
    index, leaf, home = [], [], []

    def down(node, at: np.ndarray, own: np.ndarray, number: int, level: int) -> None:
        if not len(at):
            return
        if node is None:
            index.append(at)
            leaf.append(np.full(len(at), number << (TOP - level), np.int64) if level else np.zeros(len(at), np.int64))
            home.append(own)
            return
        v, at_most, left, right = node
        d = distance(values[at], np.uint64(v), mask).astype(np.int64)
        near = d <= at_most
        down(left, at[near], own[near], 2 * number, level + 1)  # a query never goes back to an earlier leaf than its home
        queries = ~near & ~own & (d <= at_most + radius)
        if queries.any():
            down(left, at[queries], own[queries], 2 * number, level + 1)
        far = ~near
        visits = near & (d > at_most - radius)
        down(right, np.concatenate([at[far], at[visits]]), np.concatenate([own[far], np.zeros(visits.sum(), bool)]), 2 * number + 1, level + 1)

    down(tree, np.arange(len(values)), np.ones(len(values), bool), 0, 0)
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(index), np.concatenate(leaf), np.concatenate(home)


def bit_parts(mask: int, n: int) -> list[int]:
    """The bits of a mask in ``n`` parts of like size."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    return [sum(bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def alike(h: np.ndarray, q: np.ndarray, homes: np.ndarray, queries: np.ndarray, part: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The homes and queries of each value that both have in some bits."""
    h, q = h[np.argsort(homes[h] & part, kind="stable")], q[np.argsort(queries[q] & part, kind="stable")]
    a, b = homes[h] & part, queries[q] & part
    for v in np.intersect1d(a, b):
        yield h[np.searchsorted(a, v) : np.searchsorted(a, v, "right")], q[np.searchsorted(b, v) : np.searchsorted(b, v, "right")]


def near_pairs(homes: np.ndarray, queries: np.ndarray, mask: np.uint64, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, query) within ``most`` bits of all 64, given that they are within ``radius`` in the block; some come again.

    On the stack: homes, queries, whether a vantage may divide them, and the bits that they may differ in.
    """
    stack = [(np.arange(len(homes)), np.arange(len(queries)), True, (1 << 64) - 1)]
    while stack:
        h, q, whole, free = stack.pop()
        if not len(h) or not len(q):
            continue
        many = len(h) * len(q) > PAIRS and len(h) > 64
        found = vantage(homes[h], mask) if many and whole else None
        if found is not None:
            v, at = found
            dh, dq = distance(homes[h], v, mask), distance(queries[q], v, mask).astype(np.int64)
            stack.append((h[dh <= at], q[dq <= at + radius], True, free))
            stack.append((h[dh > at], q[dq > at - radius], True, free))
            continue
        rest = free & ~int(mask) if whole else free
        if many and rest.bit_count() > 2 * most:
            for part in bit_parts(rest, most + 1):
                stack.extend((*both, False, rest & ~part) for both in alike(h, q, homes, queries, np.uint64(part)))
            continue
        step = max(1, PAIRS // len(h))
        for k in range(0, len(q), step):
            part = q[k : k + step]
            i, j = np.nonzero(np.bitwise_count(homes[h][:, None] ^ queries[part][None, :]) <= most)
            if len(i):
                yield h[i], part[j]


class Forest:
    """Union-find over arrays of node numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(values: np.ndarray, home: np.ndarray, mask: np.uint64, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one shard that touch a home; values may repeat."""
    own, other = values[home], values[~home]
    forest = Forest(len(own) + len(other))
    for i, j in near_pairs(own, own, mask, radius, most):
        forest.union(i[i < j], j[i < j])
    for i, j in near_pairs(own, other, mask, radius, most):
        forest.union(i, j + len(own))
    every = np.concatenate([own, other])
    top = forest.find(np.arange(len(every)))
    linked = np.flatnonzero(top != np.arange(len(every)))
    return every[linked], every[top[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(u, v): links that connect what is connected at ``radius`` bits, among distinct fingerprints in column fp."""
    n = distinct.count()
    depth = min(TOP, max(0, math.ceil(math.log2(max(1, n) / shard))))
    small = distinct.orderBy(F.xxhash64("fp")).limit(max(LEAST_SAMPLE, LEAF_SAMPLE << depth)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    masks, near = block_masks(blocks), radius // blocks
    trees = [grow(small, np.uint64(m), depth) for m in masks]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for b, (tree, mask) in enumerate(zip(trees, masks, strict=True)):
                at, leaf, home = deal(tree, fp, np.uint64(mask), near)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * blocks + b), pa.array(fp[at].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.uint64(masks[int(key[0]) % blocks])
        u, v = shard_links(rows["fp"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool), mask, near, radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(visits, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, root (the component's least fingerprint) and component_id (its least id) of every row."""
    each = cut(fingerprints(docs, shingle))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = roots(links(distinct, radius))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "root", "component_id")
    return each.join(by_fp, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The row of the least id of each component, with all its columns.

    Rows of one id are one document: of rows that repeat a kept id one stays.  Rows without an id
    go where their component has an id; where it has none, one of its rows stays.
    """
    marked = cut(near_duplicates(docs, radius, shingle))
    ids = marked.where("doc_id = component_id").groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("__asx_again")).withColumnRenamed("doc_id", "__asx_id")
    kept = docs.join(ids, docs["doc_id"] == F.col("__asx_id")).drop("__asx_id")
    once = kept.where("not __asx_again").drop("__asx_again")
    again = kept.where("__asx_again").drop("__asx_again").dropDuplicates(["doc_id"])
    lone = marked.where("doc_id is null and component_id is null and fp = root").select(F.col("fp").alias("__asx_fp")).distinct()
    if lone.isEmpty():
        return once.unionByName(again)
    rest = tagged(docs.where("doc_id is null"), shingle).join(lone, "__asx_fp").dropDuplicates(["__asx_fp"]).drop("__asx_fp")
    return once.unionByName(again).unionByName(rest)
