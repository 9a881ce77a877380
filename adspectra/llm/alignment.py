"""Alignment of two tokenizers' tokens over the same bytes.

``align`` tokenises texts and finds groups and links in one pass over Arrow batches (``linked``, by numpy; the texts of a batch are marked
side by side in one array of bytes).  For tables of tokens, groups and links there is the same in Spark's functions: ``tokenized`` makes each text,
after a space, the ids and the byte ends of its tokens by a byte-level BPE file (A) and by a SentencePiece file (B); then, by higher-order functions:

* ``array_intersect`` of the two arrays of ends gives the bytes at which tokens of both end: the ends of the groups.
* The ends of both, each with its side and place, are sorted together.  Where an end stands in that order, less its own
  place, is the number of the other side's ends before it.  So each entry knows the token of either side that it lies in,
  and an end of B that closes a group knows how many tokens of A and B stand up to it (``cuts``).
* Between two neighbouring ends of the two together lies one piece of one token of A and of one of B, and each pair of
  overlapping tokens shares one such piece.  So the links of a group are the entries of its ``sequence`` of places, but for the last
  (which repeats the end of the entry before it): a group of m and n tokens has m + n - 1 links, and work is in proportion to tokens.

Counts of linked ids over all documents (``weigh``): the aligned rows are written once, in buckets by chunk (a chunk: what one task
read).  Links are counted by chunk and pair where they lie, and only these counts are shuffled: by pair for the sums, and back to the chunks,
where each link finds its pair's sum in a hash table.  So no link and no text is shuffled, a pair that fills the corpus is one
row a chunk, and nothing is broadcast or collected.

Texts are tokenised chunk by chunk of text: before a space after a character that isn't white space no token of either file
goes on (A's words begin there, and B has no piece with a space sign after another character), so each different such part is tokenised
once by the libraries, many parts as one text, and remembered.

Defined cases: null and empty texts, and texts whose bytes the tokens of either side don't give back (such as those with U+2581), have
no tokens, no groups and no links, and their sums are 0; special tokens' strings are plain text; rows that repeat an id stay rows of their
own and count each; a null id is kept; of ties for an id's best partner all are best; texts of any length are aligned whole, with
arrays in proportion to the text in one task's memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _remove, dropped, freed_shuffles, partitions, shared_folder, spark_of, stored
from .wordbpe import byte_letters

SIGN = "▁"
#: A part: spaces, then all up to the next space that follows a character that is no white space.
PART = re.compile(r" \s*+(?:\S++(?:[^\S ]\s*+)?+)*+")
#: Characters of the parts that a worker remembers, and the longest part that it remembers.
CACHE_CHARS, LONGEST = 1 << 22, 256
#: Rows tokenised at once.
ROWS = 500
#: Texts aligned at once, by arrays in proportion to them.
ALIGNED = 64
#: Parts tokenised as one text, and so few that they are tokenised each by itself where that fails.
JOINED, LEAST_JOINED = 2000, 16
#: Bits of a place in the sorted ends and in ``cuts``; B's entries have one bit more set, so that of equal ends A's come first.
BITS = 31
SIDE, PLACE = 1 << BITS, (1 << BITS) - 1
_PAIRS: dict[tuple[str, str], TokenPair] = {}


class TokenPair:
    """The two tokenizers of one worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: i for i, c in enumerate(byte_letters())}
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = {i: bytes(letters[c] for c in x) for x, i in vocabulary.items()}
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(SIGN, " ").encode() for i in range(self.b.get_piece_size())]
        self.bytes_a |= {i: b"" for i in range(self.a.get_vocab_size()) if i not in self.bytes_a}
        self.alone = self.b.piece_to_id(SIGN)
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int32)
        self.sizes_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int32)
        self.by_a: dict[str, bytes | None] = {}
        self.by_b: dict[str, bytes] = {}
        self.cached = 0

    @staticmethod
    def _packed(ids: list[list[int]]) -> list[bytes]:
        """Each list as little-endian 32-bit integers."""
        flat = np.fromiter(chain.from_iterable(ids), "<i4").tobytes()
        stops = (4 * np.cumsum([len(x) for x in ids])).tolist()
        return [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def _learn(self, parts: list[str]) -> None:
        """The ids of parts by A and by B; None by A where the tokens of either don't give the part's bytes."""
        joined = [p for p in parts if len(p) <= LONGEST and not p[-1].isspace()]
        for k in range(0, len(joined), JOINED):
            self._learn_joined(joined[k : k + JOINED])
        self._learn_each([p for p in parts if p not in self.by_a])

    def _learn_joined(self, parts: list[str]) -> None:
        """Parts that end in no white space, as one text: neither file's tokens go on from one to the next.

        Left out, or tried by halves, where the tokens don't give the text's bytes or don't end where the parts do.
        """
        whole = "".join(parts)
        raw, bounds = whole.encode(), np.cumsum([len(p.encode()) for p in parts])
        found = []
        for ids, table, sizes in ((self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.bytes_a, self.sizes_a), (self.b.encode(whole[1:]), self.bytes_b, self.sizes_b)):
            array = np.array(ids, "<i4")
            ends = np.cumsum(sizes[array])
            at = np.searchsorted(ends, bounds)
            if b"".join(map(table.__getitem__, ids)) != raw or not np.array_equal(ends[at], bounds):
                if len(parts) > LEAST_JOINED:
                    self._learn_joined(parts[: len(parts) // 2])
                    self._learn_joined(parts[len(parts) // 2 :])
                return
            flat, stops = array.tobytes(), (4 * (at + 1)).tolist()
            found.append([flat[i:j] for i, j in zip([0, *stops], stops, strict=False)])
        self.by_a.update(zip(parts, found[0], strict=True))
        self.by_b.update(zip(parts, found[1], strict=True))

    def _learn_each(self, parts: list[str]) -> None:
        if not parts:
            return
        a = [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.b.encode([x[1:] for x in parts], num_threads=1)  # the library adds the space again, but to nothing
        b = [x or [self.alone] for x in b]
        self.by_a.update(zip(parts, self._packed(a), strict=True))
        self.by_b.update(zip(parts, self._packed(b), strict=True))
        whole = "".join(parts).encode()
        if any(b"".join(map(table.__getitem__, chain.from_iterable(ids))) != whole for table, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            for part, *both in zip(parts, a, b, strict=True):
                if any(b"".join(map(table.__getitem__, ids)) != part.encode() for table, ids in zip((self.bytes_a, self.bytes_b), both, strict=True)):
                    self.by_a[part] = None

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text after a space."""
        if self.cached > CACHE_CHARS:
            self.by_a, self.by_b, self.cached = {}, {}, 0
        split = [PART.findall(" " + x) if x and SIGN not in x else [] for x in texts]
        new = list(set(chain.from_iterable(split)).difference(self.by_a))
        if new:
            self._learn(new)
        out = [], []
        for parts in split:
            a = list(map(self.by_a.__getitem__, parts))
            given = None not in a
            out[0].append(np.frombuffer(b"".join(a) if given else b"", "<i4"))
            out[1].append(np.frombuffer(b"".join(map(self.by_b.__getitem__, parts)) if given else b"", "<i4"))
        self.cached += sum(map(len, new))
        for p in new:
            if len(p) > LONGEST:
                del self.by_a[p], self.by_b[p]
        return out


def _pair(path_a: str, path_b: str) -> TokenPair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = TokenPair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def tokenized(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """doc_id, and a_ids, a_ends, b_ids, b_ends (byte offsets after the space put before the text) of every row."""

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32, copy=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                a, b = pair.encode(part.column(1).to_pylist())
                ends = ([np.cumsum(sizes[x], dtype=np.int32) for x in ids] for ids, sizes in ((a, pair.sizes_a), (b, pair.sizes_b)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists(a), lists(next(ends)), lists(b), lists(next(ends))], ["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"])

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.ArrayType(T.IntegerType(), False)) for x in ("a_ids", "a_ends", "b_ids", "b_ends"))])
    return docs.select("doc_id", text).mapInArrow(run, own)


class Texts:
    """Groups, their text and links of many texts at once, by numpy: texts side by side are one text whose tokens all end where each text does."""

    def __init__(self, pair: TokenPair, size_b: int):
        self.sizes, self.size_b = (pair.sizes_a, pair.sizes_b), size_b
        n = max(map(len, self.sizes))
        cells = np.array([f"{i}{mark}" for mark in ",|;" for i in range(n)], "S8")  # an id and what stands after it
        self.lengths, self.cells, self.n = np.char.str_len(cells), cells.view("<u8"), n

    def align(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """By text its tokens of A and B, its groups, its links and its groups' SHA-256; then the links of all texts, A's and B's ids."""
        counts = [np.array([len(x) for x in ids], np.int64) for ids in (a, b)]
        ids = [np.concatenate([np.zeros(0, np.int32), *x]) for x in (a, b)]
        last = [np.cumsum(sizes[x], dtype=np.int64) - 1 for sizes, x in zip(self.sizes, ids, strict=True)]  # each token's last byte
        at = np.zeros(last[0][-1] + 1 if len(ids[0]) else 0, np.uint8)
        at[last[0]] |= 1
        at[last[1]] |= 2
        kind = at[at > 0]  # at each byte where a token of either side ends: which side's
        ends_a, ends_b = np.cumsum(kind & 1, dtype=np.int64), np.cumsum(kind >> 1, dtype=np.int64)
        link_a, link_b = ids[0][ends_a - (kind & 1)], ids[1][ends_b - (kind >> 1)]
        both = np.flatnonzero(kind == 3)
        cut_a, cut_b = ends_a[both], ends_b[both]  # tokens of A and of B up to the end of each group

        def by_text(places: np.ndarray) -> np.ndarray:
            """How many of the groups, or of the ends, lie in each text."""
            up_to = np.concatenate([[0], places])[np.searchsorted(cut_a, np.cumsum(counts[0]), "right")]
            return np.diff(up_to, prepend=0)

        closes = [at[x] == 3 for x in last]
        group = [np.cumsum(x) - x for x in closes]
        cells = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        cells[np.arange(len(ids[0])) + np.concatenate([[0], cut_b])[group[0]]] = ids[0] + self.n * closes[0]
        cells[np.arange(len(ids[1])) + cut_a[group[1]]] = ids[1] + 2 * self.n * closes[1]
        text = self.cells[cells].view(np.uint8)
        text = text[text > 0].tobytes()
        stops = np.concatenate([[0], np.cumsum(self.lengths[cells])])[np.concatenate([[0], np.cumsum(counts[0] + counts[1])])].tolist()
        digests = [hashlib.sha256(text[i : j - 1]).hexdigest() if i < j else "" for i, j in zip(stops, stops[1:], strict=False)]
        return counts[0], counts[1], by_text(np.arange(1, len(both) + 1)), by_text(both + 1), digests, link_a, link_b


def linked(docs: DataFrame, path_a: str, path_b: str, size_b: int, text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and ``links`` (A's id times ``size_b`` plus B's) of every row: what ``links`` and ``group_text`` give, by numpy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        texts = Texts(pair, size_b)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                a, b = pair.encode(part.column(1).to_pylist())
                for i in range(0, part.num_rows, ALIGNED):
                    n_a, n_b, n_groups, n_links, digests, link_a, link_b = texts.align(a[i : i + ALIGNED], b[i : i + ALIGNED])
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n_links)]).astype(np.int32))
                    links = pa.ListArray.from_arrays(offsets, pa.array(link_a.astype(np.int64) * size_b + link_b))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, ALIGNED), pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(digests, pa.string()), links], own.names)

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("n_a", "n_b", "n_groups")), T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.LongType(), False))])
    return docs.select("doc_id", text).mapInArrow(run, own)


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns once and for all: the optimizer can't copy their expressions into the functions that use them."""
    return df.select(F.inline(F.array(F.struct(*df.columns, *(c.alias(x) for x, c in columns.items())))))


def aligned(tokens: DataFrame) -> DataFrame:
    """Adds ``ends`` (all ends with side and place, in order), ``n_groups`` and ``cuts`` (tokens of A, shifted, and of B up to the end of each group)."""

    def entries(ends: str, side: int) -> Column:
        return F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), BITS + 1).bitwiseOR(i.cast("long") + F.lit(side)))

    both = _made(tokens, ends=F.sort_array(F.concat(entries("a_ends", 0), entries("b_ends", SIDE))), n_groups=F.size(F.array_intersect("a_ends", "b_ends")).cast("long"))

    def closes(x: Column, k: Column) -> Column:
        """An entry of B right after one of A of the same end."""
        return (x.bitwiseAND(F.lit(SIDE)) != 0) & (F.shiftright(x, BITS + 1) == F.get("a_ends", k - x.bitwiseAND(F.lit(PLACE)).cast("int") - 1))

    # Such an entry at place k, B's token j, closes its group after k - j tokens of A and j + 1 of B.
    cuts = F.filter(F.transform("ends", lambda x, k: F.when(closes(x, k), F.shiftleft(k.cast("long") - x.bitwiseAND(F.lit(PLACE)), BITS) + x.bitwiseAND(F.lit(PLACE)) + 1)), lambda c: c.isNotNull())
    return _made(both, cuts=cuts)


def _sides(cut: Column) -> tuple[Column, Column]:
    return F.shiftright(cut, BITS).cast("int"), cut.bitwiseAND(F.lit(PLACE)).cast("int")


def _before(k: Column) -> Column:
    return F.coalesce(F.get("cuts", k - 1), F.lit(0).cast("long"))


#: A cut less the one before it, where the group has one token of each side.
ONE_EACH = SIDE + 1


def groups(pairs: DataFrame) -> DataFrame:
    """Adds ``groups``: an array of (a, b), the ids of each group in order."""

    def group(cut: Column, k: Column) -> Column:
        (a0, b0), (a1, b1) = _sides(_before(k)), _sides(cut)
        return F.struct(F.slice("a_ids", a0 + 1, a1 - a0).alias("a"), F.slice("b_ids", b0 + 1, b1 - b0).alias("b"))

    return pairs.withColumn("groups", F.transform("cuts", group))


def group_text(pairs: DataFrame) -> DataFrame:
    """Adds ``group_text``: ids joined by commas, the sides by a bar, groups by semicolons."""

    def joined(ids: str, start: Column, stop: Column) -> Column:
        return F.array_join(F.slice(ids, start + 1, stop - start).cast("array<string>"), ",")

    def text(cut: Column, k: Column) -> Column:
        (a0, b0), (a1, b1) = _sides(_before(k)), _sides(cut)
        several = F.concat(joined("a_ids", a0, a1), F.lit("|"), joined("b_ids", b0, b1))
        one_each = F.concat(F.get("a_ids", a1 - 1).cast("string"), F.lit("|"), F.get("b_ids", b1 - 1).cast("string"))
        return F.when(cut - _before(k) == ONE_EACH, one_each).otherwise(several)

    return pairs.withColumn("group_text", F.array_join(F.transform("cuts", text), ";"))


def links(pairs: DataFrame, size_b: int) -> DataFrame:
    """Adds ``links``: a number for each overlapping pair of tokens, A's id times ``size_b`` plus B's."""

    def number(a: Column, b: Column) -> Column:
        return F.get("a_ids", a).cast("long") * size_b + F.get("b_ids", b)

    def link(k: Column) -> Column:
        x = F.get("ends", k)
        own = x.bitwiseAND(F.lit(PLACE)).cast("int")
        return F.when(x.bitwiseAND(F.lit(SIDE)) == 0, number(own, k - own)).otherwise(number(k - own, own))

    def group(cut: Column, k: Column) -> Column:
        (a0, b0), (a1, b1) = _sides(_before(k)), _sides(cut)
        return F.when(cut - _before(k) == ONE_EACH, F.array(number(a1 - 1, b1 - 1))).otherwise(F.transform(F.sequence(a0 + b0, a1 + b1 - 2), link))

    return pairs.withColumn("links", F.flatten(F.transform("cuts", group)))


@contextmanager
def _meeting_by_chunk(spark: SparkSession) -> Iterator[None]:
    """Lets rows that are already together by chunk be joined by chunk and pair without another shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "false")
        with freed_shuffles(spark):
            yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def weigh(linked: DataFrame, size_b: int) -> DataFrame:
    """Every row, without ``links``, with n_links, n_best (links whose count is the greatest of their B id, ties included) and count_sum.

    A link's count is how many links of all rows hold its pair.
    """
    spark = spark_of(linked)
    name = f"adspectra_links_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    kept = [c for c in linked.columns if c != "links"]
    placed = linked.withColumn("chunk", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).withColumn("n_links", F.size("links").cast("long"))
    try:
        placed.write.bucketBy(partitions(spark), "chunk").option("path", path).format("parquet").saveAsTable(name)
        rows = spark.table(name)
        each = rows.select("chunk", "row", F.explode("links").alias("pair"))
        by_chunk = stored(each.groupBy("chunk", "pair").agg(F.count(F.lit(1)).alias("n")))
        total = by_chunk.groupBy("pair").agg(F.sum("n").alias("total"))
        best = F.max("total").over(Window.partitionBy(F.col("pair") % size_b))
        known = by_chunk.select("chunk", "pair").join(total.select("pair", "total", (F.col("total") == best).cast("long").alias("best")), "pair")
        with _meeting_by_chunk(spark):
            sums = each.join(known.hint("shuffle_hash"), ["chunk", "pair"]).groupBy("chunk", "row").agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
            zero = F.lit(0).cast("long")
            out = stored(rows.select(*kept, "n_links", "chunk", "row").join(sums, ["chunk", "row"], "left").select(*kept, "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum")))
        dropped(by_chunk)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, path)
    return out


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, group_text's SHA-256 ('' without tokens), n_links, n_best and count_sum of every row."""
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    return weigh(linked(docs, path_a, path_b, size_b), size_b)
