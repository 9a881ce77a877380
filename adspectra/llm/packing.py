"""Bulk-synchronous best-fit packing of token sequences.

Documents are tokenized where they are read; only (document, piece, start, length, CRC) rows are
shuffled.  A document longer than a sequence is cut into pieces, the last of which may be shorter.

Packing goes in rounds, from the longest pieces to the shortest.  In a round all pieces of one
length meet all gaps left so far, both in order of size.  The sweep gives each piece the successor
of its length among the gaps: the smallest gap that still holds it; conflicts between pieces that
want one gap are resolved by the pieces' rank within their length, so gap k of a size takes pieces
``k*m .. k*m+m-1`` where ``m`` is how many it holds; what no gap holds opens new sequences; the
gaps are updated, and the next round follows.  The result is best-fit decreasing over all pieces.

A length is a whole number up to the sequence length, so a round needs no piece and no gap by
itself, only how many there are of each size.  The sweep runs over these counts (at most one per
length, whatever the size of the input) and yields a plan of rank intervals.  Ranks are dealt out
in parallel (``ranked_within``), and each piece finds its interval by a join on length.

Defined cases: null or empty text is its closing id alone; repeated rows are packed once each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, parts, ranked_within

SEQUENCE, CLOSING_ID = 2048, 0
#: Rows whose texts are encoded together.
ROWS = 512
_ENCODERS: dict[str, object] = {}

PLAN = "length long, first long, stop long, holds long, at long, sequence long"


def encoder(path: str):
    """One encoder per worker process."""
    if path not in _ENCODERS:
        from .wordbpe import WordBpe

        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        closing = np.array([CLOSING_ID], "<u4")
        for batch in parts(batches, ROWS):
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode([x or "" for x in batch.column(1).to_pylist()])):
                ids = np.concatenate([ids, closing])
                for k in range(0, len(ids), sequence):
                    part = ids[k : k + sequence]
                    rows.append(i)
                    piece.append(k // sequence)
                    start.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))])
    return docs.select("doc_id", "text").mapInArrow(pieces, own)


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit over counts of each length.

    Rows (length, first, stop, holds, at, sequence): pieces of that length with ranks first..stop-1
    go ``holds`` to a sequence, from sequence number ``sequence`` on, the first of each at ``at``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap size -> runs (first sequence, how many)
    sizes: list[int] = []  # of gaps, ascending
    rows, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left, later = 0, counts[length], []
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop(0)
                if not gaps[gap]:
                    del gaps[gap], sizes[k]
            else:
                gap, first = sequence, opened
                n = -(-left // (sequence // length))
                opened += n
            holds = gap // length
            full, rest = divmod(min(left, n * holds), holds)
            rows.append((length, rank, rank + full * holds + rest, holds, sequence - gap, first))
            later.append((gap - holds * length, first, full))
            if rest:
                later.append((gap - rest * length, first + full, 1))
            later.append((gap, first + full + bool(rest), n - full - bool(rest)))
            rank += full * holds + rest
            left -= full * holds + rest
        for x in later:  # no gap that this round leaves holds one more piece of its length, unless no piece is left
            leave(*x)
    return rows


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``sequence``)."""
    pieces = cut(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one per length
    steps = pieces.sparkSession.createDataFrame(plan(counts, sequence), PLAN)
    ranked = ranked_within(pieces, ["length"], [F.col("doc_id"), F.col("piece")], "__asx_rank", F.xxhash64("doc_id", "piece", "ids_crc32"))
    p, q = ranked.alias("p"), F.broadcast(steps).alias("q")  # its size depends on ``sequence`` alone
    within = F.col("__asx_rank") - F.col("q.first")
    joined = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("__asx_rank") >= F.col("q.first")) & (F.col("__asx_rank") < F.col("q.stop")))
    return joined.select("p.*", (F.col("q.sequence") + F.floor(within / F.col("holds"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(within, F.col("holds")) * F.col("p.length")).alias("offset")).drop("__asx_rank")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, sequence), sequence)
