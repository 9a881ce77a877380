"""Removal of repeated substrings by sharded suffix arrays.

A byte goes if a ``LENGTH``-byte string that covers it also starts earlier: in a document of a
smaller id, or before in the same one.  Documents are byte strings; matches never cross them.

Shards.  Every window of ``LENGTH`` bytes names an anchor: the least hash among its ``ANCHOR``-byte
grams, the rightmost on ties.  Equal windows name equal anchors at the same place, so the windows
may be judged anchor by anchor.  Windows of one anchor are consecutive: they form one segment of at
most ``2 * LENGTH - ANCHOR`` bytes.  A document of n bytes has about ``2 n / 65`` segments.

1. All anchors are counted by 32 bits of their hash, shuffled as packed numbers.  Those seen once
   can't hold a repeat and go.  A bit map of fixed size of the others is all that is broadcast; it only saves
   shuffling and loses nothing when it fills up.
2. Segments of repeated anchors are grouped by (anchor, content).  All but the first segment of a
   group are repeats as a whole.  Those that the texts of half a megabyte hold before are known at once and never
   shuffled, so a passage in a third of all documents costs a row for each.
3. The first segments of an anchor with several contents are the shards' texts.  Suffix arrays are
   built by prefix doubling (``suffixes``), permuted common prefixes give runs of suffixes that
   share ``LENGTH`` bytes, and in each run all but the earliest window are repeats.  Only these
   segments are ever shuffled with their bytes.
   An anchor with more than ``SHARD_SEGMENTS`` different contents is split by its context: its windows are
   dealt out by the least 4, then 16, then all of their grams' hashes with the places around the anchor.  Equal
   windows have equal contexts, and windows side by side with one context stay one segment.  The smaller
   groups go to suffix arrays in their turn, and groups by all grams have one content each.
4. Spans are gathered by document and cut out.

Contents of one anchor are told apart by one 64-bit hash in step 2, as bytes in the suffix arrays.

A document is known by its id and the hash of its text.  Defined cases: null text is empty; a null
id sorts first; rows that repeat both id and text are one document and get equal results; rows of
one id and different texts are ordered by the text's hash; an empty table gives an empty
result; other columns are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, dropped, freed_shuffles, mix64, partitions, parts, raw, stored
from .suffixes import permuted_common_prefixes, suffix_arrays
from .wordbpe import powers

LENGTH, ANCHOR = 100, 36
SHARD_SEGMENTS = 256
#: Numbers of least grams that deal out the windows of larger groups, in turn; the last is all grams of a window.
CONTEXTS = (4, 16, LENGTH - ANCHOR + 1)
#: log2 of the bits of the broadcast map of repeated anchors.
FILTER_BITS = 27
#: Bytes hashed at once, which stay in the processor's cache; of texts whose segments are held against each other at once; and of
#: segments of which one suffix array is built.
BLOCK, KNOWN, SYMBOLS = 1 << 16, 1 << 19, 1 << 18
#: Bytes of segments that a task takes.
TASK_BYTES = 1 << 23
POSITION = np.uint64((1 << 21) - 1)
FIRST_ID = -(1 << 63)

SEGMENT = "h long, seg long, k long, th long, s0 long, windows int"
WITH_BYTES = SEGMENT + ", place int, bytes binary"
SPAN = "k long, th long, start long, stop long"


class Segments:
    """The segments of one block of texts."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor = length, anchor
        sizes = np.array([len(x) for x in texts], np.int64)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.first = np.cumsum(sizes) - sizes
        n = len(self.text)
        self.up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.total[1:])
        owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
        starts = np.arange(len(owner)) + np.repeat(self.first - np.cumsum(np.maximum(sizes - length + 1, 0)) + np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
        if not len(starts):
            self.owner = self.start = self.windows = np.zeros(0, np.int64)
            self.h, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        grams = mix64((self.total[anchor:] - self.total[:-anchor]) * self.down[: n - anchor + 1] + np.uint64(anchor))
        least = grams & ~POSITION | POSITION - np.arange(len(grams), dtype=np.uint64)
        span, wide = 1, length - anchor + 1
        while 2 * span <= wide:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        at = (POSITION - (least[starts] & POSITION)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        run = np.flatnonzero(new)
        self.owner, self.start, self.windows = owner[run], starts[run], np.diff(np.append(run, len(at)))
        self.h = grams[at[run]]
        self.at = at[run] - self.start

    def hash(self, starts: np.ndarray, size) -> np.ndarray:
        return mix64((self.total[starts + size] - self.total[starts]) * self.down[starts] + np.uint64(1) * np.asarray(size, np.uint64))

    def content(self) -> np.ndarray:
        return self.hash(self.start, self.windows + self.length - 1)

    def keep(self, mask: np.ndarray) -> None:
        self.owner, self.start, self.windows, self.h, self.at = (x[mask] for x in (self.owner, self.start, self.windows, self.h, self.at))


def blocks(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Texts in blocks of at most ``BLOCK`` bytes: pieces, the text each is of, and where it begins there.

    Pieces of one text overlap so that each window is in exactly one of them.
    """
    pieces, of, begin, room = [], [], [], BLOCK
    for i, x in enumerate(texts):
        for k in range(0, max(1, len(x) - length + 1), BLOCK - length):
            piece = x[k : k + BLOCK - 1]
            if len(piece) > room and pieces:
                yield pieces, of, begin
                pieces, of, begin, room = [], [], [], BLOCK
            pieces.append(piece)
            of.append(i)
            begin.append(k)
            room -= len(piece)
    if pieces:
        yield pieces, of, begin


def texts_of(column) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of an Arrow column, ``ROWS`` at a time, with the row of the first."""
    for row in range(0, len(column), ROWS):
        yield row, raw(column.slice(row, ROWS))


def key_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))


def identified(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(k and th, which identify a document, and its text; th as an expression of the input).

    th tells rows of one id apart; it is 0 where no id repeats.
    """
    text = F.coalesce("text", F.lit(""))
    again = not docs.groupBy(key_of(docs).alias("k")).count().where("count > 1").isEmpty()
    th = F.xxhash64(text) if again else F.lit(0).cast("long")
    return docs.select(key_of(docs).alias("k"), th.alias("th"), text.alias("text")), th


def anchor_numbers(docs: DataFrame, ranges: int) -> DataFrame:
    """(r, f): the upper 32 bits of the anchors' hashes, packed, one row for each range of them that some texts have.

    Of one number at most two copies are sent for each ``2**22`` anchors or so, as they are only asked whether there
    are two; so a range's rows don't grow with an anchor that a long run or a hot passage repeats.
    """
    per = (1 << 32) // ranges

    def send(parts: list[np.ndarray]) -> pa.RecordBatch:
        f = np.sort(np.concatenate(parts))
        f = np.concatenate([f[:2], f[2:][f[2:] != f[:-2]]])
        edges = np.searchsorted(f, np.arange(1, ranges, dtype=np.uint64) * np.uint64(per))
        own = [(k, x.tobytes()) for k, x in enumerate(np.split(f, edges)) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], ["r", "f"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                for pieces, _, _ in blocks(texts):
                    parts.append((Segments(pieces).h >> np.uint64(32)).astype(np.uint32))
                    held += len(parts[-1])
                if held > 1 << 22:
                    yield send(parts)
                    parts, held = [], 0
        if held:
            yield send(parts)

    return docs.select("text").mapInArrow(found, "r int, f binary")


def repeated_anchors(docs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The map of anchors that may occur more than once, by 32 bits of their hash.

    A task sends its anchors as packed 32-bit numbers, one row for each range of them; a range's
    numbers are counted together and give a slice of the map.
    """
    ranges = 1 << max(6, (4 * partitions(docs.sparkSession) - 1).bit_length())

    def count(rows: pa.Table) -> pa.Table:
        f = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("f").to_pylist()]))
        again = f[1:][f[1:] == f[:-1]]
        return pa.table({"r": pa.array([rows.column("r")[0].as_py()], pa.int32()), "w": pa.array([slice_of(again, bits).tobytes()], pa.binary()), "at": pa.array([int(again[0] >> np.uint32(32 - bits)) >> 6 if len(again) else 0], pa.int64())})

    with freed_shuffles(docs.sparkSession):
        got = anchor_numbers(docs, ranges).groupBy("r").applyInArrow(count, "r int, w binary, at long").toArrow()
    return assembled(zip(got.column("at").to_pylist(), got.column("w").to_pylist(), strict=True), bits)


def slice_of(f: np.ndarray, bits: int) -> np.ndarray:
    """Words of the map from the one that holds the first of sorted 32-bit hashes."""
    slot = f.astype(np.uint64) >> np.uint64(32 - bits)
    if not len(slot):
        return np.zeros(0, np.uint64)
    word = (slot >> np.uint64(6)).astype(np.int64)
    out = np.zeros(int(word[-1] - word[0]) + 1, np.uint64)
    np.bitwise_or.at(out, word - word[0], np.uint64(1) << (slot & np.uint64(63)))
    return out


def assembled(slices, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits - 6, np.uint64)
    for at, data in slices:
        words = np.frombuffer(data, np.uint64)
        out[at : at + len(words)] |= words
    return out


def bit_map(anchors: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The map of the anchors in column h, made of at most ``2**bits / 64`` words."""
    slot = F.call_function("shiftrightunsigned", F.col("h"), F.lit(64 - bits))
    words = anchors.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    with freed_shuffles(anchors.sparkSession):
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def position_hash(h: np.ndarray, k: np.ndarray, s0: np.ndarray) -> np.ndarray:
    return mix64(h ^ mix64(k.view(np.uint64) * np.uint64(3) + s0.astype(np.uint64)))


def position_map(chosen: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """The map of segments by anchor and position; chosen: h, k, s0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, k, s0 = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(position_hash(h.view(np.uint64), k, s0).view(np.int64))], ["h"])

    return bit_map(chosen.select("h", "k", "s0").mapInArrow(hashed, "h long"), bits)


def again_here(h: np.ndarray, seg: np.ndarray, k: np.ndarray, th: np.ndarray, s0: np.ndarray) -> np.ndarray:
    """Which segments have a content that another segment here has at an earlier place."""
    order = np.lexsort((s0, th, k, seg, h))
    h, seg, k, th, s0 = (x[order] for x in (h, seg, k, th, s0))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.zeros(len(h), bool)
    out[order] = (k != k[first]) | (th != th[first]) | (s0 != s0[first])
    return out


def segments(docs: DataFrame, bitmap, with_bytes: bool, again: bool = False, bits: int = FILTER_BITS) -> DataFrame:
    """The segments whose anchors the bit map holds, or with bytes: those whose positions it holds; bitmap: a broadcast variable.

    Without bytes, those that are known to be repeats as a whole, by others among ``KNOWN`` bytes of texts, are left out;
    again: the spans of these, those that touch as one.
    """
    names = [x.split()[0] for x in (SPAN if again else WITH_BYTES if with_bytes else SEGMENT).split(", ")]

    def told(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        h, seg, k, th, place, windows, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        known = again_here(h, seg, k, th, place)
        if again:
            of_row, start, stop = touching(row[known], place[known], (place + windows + LENGTH - 1)[known])
            heads, first = np.unique(row, return_index=True)
            at = first[np.searchsorted(heads, of_row)]
            columns = [k[at], th[at], start, stop]
        else:
            columns = [x[~known] for x in (h, seg, k, th, place, windows)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        parts, size, rows = [], 0, 0
        for batch in batches:
            k, th = (batch.column(i).to_numpy() for i in (0, 1))
            for base, texts in texts_of(batch.column(2)):
                for pieces, of, begin in blocks(texts):
                    s = Segments(pieces)
                    row = base + np.asarray(of, np.int64)[s.owner]
                    place = s.start - s.first[s.owner] + np.asarray(begin, np.int64)[s.owner]
                    slot = (position_hash(s.h, k[row], place) if with_bytes else s.h) >> np.uint64(64 - bits)
                    wanted = (held[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) == 1
                    s.keep(wanted)
                    row, place = row[wanted], place[wanted]
                    columns = [s.h.view(np.int64), s.content().view(np.int64), k[row], th[row], place, s.windows.astype(np.int32)]
                    if with_bytes:
                        whole = s.text.tobytes()
                        columns.append(s.at.astype(np.int32))
                        bytes_of = pa.array([whole[a : a + n] for a, n in zip(s.start.tolist(), (s.windows + LENGTH - 1).tolist(), strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), bytes_of], names)
                        continue
                    parts.append([*columns, row + rows])
                    size += len(s.text)
                    if size > KNOWN:
                        yield told(parts)
                        parts, size = [], 0
            rows += batch.num_rows
        if parts:
            yield told(parts)

    return docs.mapInArrow(found, SPAN if again else WITH_BYTES if with_bytes else SEGMENT)


def touching(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs (row, start, stop) of the union of each row's spans, in their order."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # A row's stops are shifted beyond those of the rows before, so that one running maximum serves all.
    far = (np.cumsum(np.append(0, row[1:] != row[:-1]))) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + far)
    new = np.append(True, start[1:] + far[1:] > reach[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return row[head], start[head], (reach - far)[last]


def repeats_in_shards(rows: pa.Table, length: int = LENGTH, anchor: int = ANCHOR) -> pa.RecordBatch:
    """Spans (k, th, start, stop) of repeated windows among the segments (h, k, th, s0, place, bytes) of each anchor h.

    The anchor (at ``place``) is the same in all segments of one h and in all their windows, so one
    symbol stands for it.  All segments are one text, in the order of their anchors, documents and places.
    """
    h, k, th, s0 = (rows.column(x).to_numpy() for x in ("h", "k", "th", "s0"))
    order = np.lexsort((s0, th, k, h))
    rows, h, k, th, s0 = rows.take(order), h[order], k[order], th[order], s0[order]
    data = rows.column("bytes").cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    text = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] + SHIFT
    sizes, at = np.diff(ends), ends[:-1] - ends[0] + rows.column("place").to_numpy()
    edges = np.zeros(len(text) + 1, np.int8)
    edges[at + 1] += 1
    edges[at + anchor] -= 1
    text[at] = MARK
    sizes = sizes - anchor + 1
    text = np.append(np.insert(text[np.cumsum(edges[:-1], dtype=np.int8) == 0], np.cumsum(sizes), 1), np.uint8(0))
    base = np.cumsum(sizes + 1) - sizes - 1
    # Windows in suffix order; a window like the one before belongs to its run, where anchors still differ.
    symbols = length - anchor + 1
    windows = sizes - symbols + 1
    owner = np.full(len(text), -1, np.int32)
    owner[np.arange(windows.sum()) + np.repeat(base - np.cumsum(windows) + windows, windows)] = np.repeat(np.arange(len(h), dtype=np.int32), windows)
    t = text[:, None]
    sa = suffix_arrays(t, symbols)
    like = permuted_common_prefixes(t, sa, symbols, owner[:, None] >= 0)[:, 0] >= symbols
    place = sa[owner[sa[:, 0]] >= 0, 0]
    joined = np.append(like[place], False)
    alike = joined[:-1] | joined[1:]
    place, run = place[alike], np.cumsum(~joined[:-1])[alike]
    place = np.sort(run << 32 | place) & 0xFFFFFFFF
    run = np.sort(run)
    seg = owner[place].astype(np.int64)
    start = s0[seg] + place - base[seg]
    later = np.zeros(len(run), bool)
    later[1:] = (run[1:] == run[:-1]) & (h[seg[1:]] == h[seg[:-1]])
    # A window equal to the first in document and place is the first itself, met in another row.
    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(run))))
    later &= ~((k[seg] == k[seg[first]]) & (th[seg] == th[seg[first]]) & (start == start[first]))
    place = np.sort(place[later])
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = (place[1:] != place[:-1] + 1) | (owner[place[1:]] != owner[place[:-1]])
    head, tail = place[new[:-1]], place[new[1:]]
    seg = owner[head].astype(np.int64)
    start = s0[seg] - base[seg]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (k[seg], th[seg], start + head, start + tail + length)], ["k", "th", "start", "stop"])


#: Symbols: 0 ends the text, 1 stands after each segment, bytes of UTF-8 follow (none is over 244), then the anchor.
SHIFT, MARK = np.uint8(2), np.uint8(255)


def shard_spans(several: DataFrame, n_segments: int) -> DataFrame:
    """Spans found in the suffix arrays of the anchors' segments; several: h, k, th, s0, place, bytes."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts(batches, SYMBOLS // (2 * LENGTH)):
            held.append(batch)
            size += batch.num_rows * (2 * LENGTH - ANCHOR)
            if size > SYMBOLS:
                rows = pa.Table.from_batches(held)
                h = rows.column("h").to_numpy()
                last = int(np.searchsorted(h, h[-1]))
                if last:
                    yield repeats_in_shards(rows.slice(0, last))
                    held, size = rows.slice(last).to_batches(), (len(h) - last) * (2 * LENGTH - ANCHOR)
        if held:
            yield repeats_in_shards(pa.Table.from_batches(held))

    tasks = max(several.sparkSession.sparkContext.defaultParallelism, -(-n_segments * (2 * LENGTH - ANCHOR) // TASK_BYTES))
    dealt = several.select("h", "k", "th", "s0", "place", "bytes").repartition(tasks, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(search, SPAN)


def contexts(texts: list[bytes], place: np.ndarray, h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' windows dealt out by the ``least`` least of their grams: text, first window, number of windows, key and content of each run.

    place: where the anchor starts in each text.  A gram counts by its hash and its place from the anchor, so that no two of
    a window are alike, and equal windows around one anchor have equal grams.
    """
    s = Segments(texts)
    sizes = np.array([len(x) - LENGTH + 1 for x in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = (s.first[of] + step)[:, None] + np.arange(LENGTH - ANCHOR + 1)
    around = (grams - (s.first + place)[of][:, None] + LENGTH).astype(np.uint64)
    every = s.hash(np.arange(len(s.text) - ANCHOR + 1), ANCHOR)
    value = every[grams] & ~np.uint64(255) | around
    if least < value.shape[1]:
        value = np.partition(value, least - 1, axis=1)[:, :least]
    value.sort(axis=1)
    key = h.view(np.uint64)[of]
    for column in value.T:
        key = mix64(key ^ column) * np.uint64(0x9E3779B97F4A7C15)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
    head = np.flatnonzero(new)
    windows = np.diff(np.append(head, len(of)))
    return of[head], step[head], windows, key[head], s.hash(s.first[of[head]] + step[head], windows + LENGTH - 1)


def dealt(rows: DataFrame, least: int) -> DataFrame:
    """The runs of windows of segments with bytes, dealt out by context, as segments with bytes."""
    names = [x.split()[0] for x in WITH_BYTES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, k, th, s0, place = (part.column(i).to_numpy() for i in range(5))
                texts = raw(part.column(5))
                of, first, windows, key, content = contexts(texts, place, h, least)
                bytes_of = pa.array([texts[i][a : a + n + LENGTH - 1] for i, a, n in zip(of.tolist(), first.tolist(), windows.tolist(), strict=True)], pa.binary())
                columns = [key.view(np.int64), content.view(np.int64), k[of], th[of], s0[of] + first, windows.astype(np.int32), (place[of] - first).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), bytes_of], names)

    return rows.select("h", "k", "th", "s0", "place", "bytes").mapInArrow(run, WITH_BYTES)


def fetched(named: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen segments (h, k, th, s0, m) with their bytes and the anchor's place in them."""
    bitmap = named.sparkSession.sparkContext.broadcast(position_map(chosen))
    return segments(named, bitmap, with_bytes=True).select("h", "k", "th", "s0", "place", "bytes").join(chosen, ["h", "k", "th", "s0"])


def by_content(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first segment of each content of an anchor, the spans of all others); found: as ``SEGMENT``."""
    same = ["h", "seg"]
    contents = found.groupBy(*same).agg(F.min(F.struct("k", "th", "s0")).alias("f"), F.count(F.lit(1)).alias("n"))
    contents = stored(contents.select(*same, "f.k", "f.th", "f.s0", (F.col("n") > 1).alias("again")))
    firsts = contents.where("again").select(*same, F.col("k").alias("k1"), F.col("th").alias("th1"), F.col("s0").alias("s1"))
    copies = found.join(firsts, same).where("k <> k1 or th <> th1 or s0 <> s1")
    return contents, whole_spans(copies)


def whole_spans(found: DataFrame) -> DataFrame:
    return found.selectExpr("k", "th", "s0 as start", f"s0 + windows + {LENGTH - 1} as stop")


def of_several(contents: DataFrame) -> DataFrame:
    """The contents' first segments (h, k, th, s0) of anchors that have more than one, with their number m."""
    return contents.join(contents.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "h").select("h", "k", "th", "s0", "m")


def repeats(named: DataFrame) -> DataFrame:
    """(k, th, spans): the spans to remove of each document that has any, overlapping and in any order."""
    spark = named.sparkSession
    bitmap = spark.sparkContext.broadcast(repeated_anchors(named))
    found = segments(named, bitmap, with_bytes=False)
    contents, copies = by_content(found)
    spans = [stored(segments(named, bitmap, with_bytes=False, again=True).union(copies))]
    several = stored(of_several(contents))
    dropped(contents)
    # Only now are bytes needed, and only of these segments.
    rows = stored(fetched(named, several))
    dropped(several)
    shards, used = [rows.where(F.col("m") <= SHARD_SEGMENTS)], [rows]
    for least in CONTEXTS:
        large = rows.where(F.col("m") > SHARD_SEGMENTS)
        if large.isEmpty():
            break
        runs = stored(dealt(large, least))
        contents, copies = by_content(runs.drop("place", "bytes"))
        spans.append(stored(copies))
        rows = stored(runs.select("h", "k", "th", "s0", "place", "bytes").join(of_several(contents), ["h", "k", "th", "s0"]))
        dropped(runs, contents)
        used.append(rows)
        # A group by all grams holds one content, unless keys clash.
        shards.append(rows if least == CONTEXTS[-1] else rows.where(F.col("m") <= SHARD_SEGMENTS))
    several = reduce(DataFrame.unionByName, shards)
    spans.append(stored(shard_spans(several, several.count())))
    dropped(*used)
    out = stored(reduce(DataFrame.unionByName, spans).groupBy("k", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    dropped(*spans)
    return out


def merged(spans: pa.Array) -> list[list[tuple[int, int]]]:
    """Maximal runs of the union of each row's spans."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(spans))]
    every = spans.flatten()
    row, start, stop = touching(pc.list_parent_indices(spans).to_numpy(), *(every.field(x).to_numpy() for x in ("start", "stop")))
    for i, a, b in zip(row.tolist(), start.tolist(), stop.tolist(), strict=True):
        out[i].append((a, b))
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of which a part stays."""
    inner = lambda i: 0 < i < len(text) and 0x80 <= text[i] < 0xC0
    out = []
    for a, b in spans:
        while a < b and inner(a):
            a += 1
        while b > a and inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remaining(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows with all their columns and the spans to remove as ``__asx_spans`` (null: none)."""
    named, th = identified(docs)
    found = repeats(named).withColumnsRenamed({"k": "__asx_k", "th": "__asx_th", "spans": "__asx_spans"})
    return docs.join(found, (key_of(docs) == F.col("__asx_k")) & (th == F.col("__asx_th")), "left").drop("__asx_k", "__asx_th")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the remaining bytes' SHA-256, and the spans of every row."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, spans = raw(batch.column(1)), merged(batch.column(2))
            columns = [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                       pa.array([hashlib.sha256(remaining(x, s)).hexdigest() for x, s in zip(texts, spans, strict=True)], pa.string()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind)]
            yield pa.RecordBatch.from_arrays(columns, own.names)

    return with_spans(docs.select("doc_id", "text")).select("doc_id", "text", "__asx_spans").mapInArrow(apply, own)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with repeats cut from ``text`` (whole characters only) and ``n_chars``, if any, counted anew."""
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts, out = batch.column(names.index("text")).to_pylist(), []
            for x, s in zip(texts, merged(batch.column(len(names))), strict=True):
                if x is not None and s:
                    data = x.encode()
                    x = remaining(data, whole_characters(data, s)).decode()
                out.append(x)
            columns = list(batch.columns[:-1])
            columns[names.index("text")] = pa.array(out, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if x is None else len(x) for x in out], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return with_spans(docs).mapInArrow(apply, docs.schema)
