"""SentencePiece encoding and decoding with a batched Viterbi search.

The vocabulary, its scores, byte fallback and white-space rules come from a SentencePiece file of
byte-pair kind, and the ids are the library's.  There the best segmentation isn't the one of the
greatest sum of scores (they are merge ranks) but the one that merging leaves.  Merging a text gives one
segmentation; each prefix of it is what merging that prefix gives; and pieces side by side are such a
segmentation if each two neighbours are, by themselves, one that merging leaves (``left_alone``).  So the
search admits a piece that ends at a place only if the last piece of the text before it leaves it alone, and
exactly one is admitted: its score counts, all others count as minus infinity.

No piece has a space sign after another character, so texts fall apart before each run of space
signs that follows a character, and each part is searched by itself.  The different parts of a batch are
grouped by length and advance together: hashes of all substrings that end at a place are looked up
among the sorted hashes of the pieces, and the one candidate that is admitted at each place is kept as
its backpointer; the paths are read back together.  Characters without a piece become byte pieces.
A part of over ``LONGEST`` characters is searched as chunks of that length, side by side, that overlap by
``OVERLAP``; the chunks' paths are joined where both end a piece at one place and the pieces around it leave each
other alone, which makes the joined path the whole part's.  Where there is no such place (a run, a pattern), the chunks
are searched in turn, each from where the one before ends a piece, and where that fails too the part is searched at one go.

Defined cases: null text is empty; empty text has no pieces; a literal space sign (U+2581) decodes as a
space, all else round-trips; repeated rows get equal results; an empty table gives an empty result;
``encode`` and ``decode`` keep the id column only; texts of any length are encoded in time in proportion to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix64
from .wordbpe import powers

SIGN = "▁"
PART = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")
#: Characters of the parts kept between batches in one worker, parts searched at once, and the longest part that is searched at one go.
CACHE_CHARS, ROWS, LONGEST, OVERLAP = 1 << 21, 20_000, 512, 128
#: Pairs of pieces whose relation a worker remembers, a power of two.
REMEMBERED = 1 << 18
NEVER = np.int32(1 << 30)
UNKNOWN, START = -1, -2
_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.byte_ids = np.zeros(256, "<i4")
        self.byte_of = np.full(n, -1, np.int32)
        for i in range(n):
            if lib.is_byte(i):
                b = int(self.pieces[i][3:5], 16)
                self.byte_ids[b], self.byte_of[i] = i, b
        if any(SIGN in self.pieces[i].lstrip(SIGN) for i in normal):
            raise ValueError("a piece has a space sign after another character")
        self.prefix = lib.encode("a", out_type=str)[0].startswith(SIGN)
        self.longest = max(len(self.pieces[i]) for i in normal)
        scores = np.array([lib.get_score(i) for i in normal])
        self.rank = np.zeros(len(normal), np.int32)  # of merges from 1; characters are there from the start
        self.rank[np.lexsort((np.arange(len(normal)), -scores))] = np.arange(1, len(normal) + 1, dtype=np.int32)
        self.ids = np.array(normal, np.int32)
        self._learn([self.pieces[i] for i in normal])
        keys = np.array([self._key(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)[self.made[np.argsort(keys)]]
        self.keys, self.of = keys[order], order.astype(np.int32)
        # Most probes miss; 20 bits of the hash tell most of them.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.asked, self.told = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, bool)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def _learn(self, texts: list[str]) -> None:
        """The merges: which pieces join to which, the last merge that makes each piece, and whether merging makes it at all."""
        index = {x: i for i, x in enumerate(texts)}
        sizes = np.array([len(x) for x in texts])
        self.rank[sizes == 1] = 0
        splits = [(index[x[:k]], index[x[k:]], i) for i, x in enumerate(texts) for k in range(1, len(x)) if x[:k] in index and x[k:] in index]
        left, right, whole = (np.array(c, np.int32) for c in zip(*splits, strict=True)) if splits else (np.zeros(0, np.int32),) * 3
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        order = np.argsort(pair)
        self.pairs, self.joined = pair[order], self.rank[whole[order]]
        self.left, self.right = np.arange(len(texts), dtype=np.int32), np.arange(len(texts), dtype=np.int32)
        self.made = sizes == 1
        for size in range(2, int(sizes.max()) + 1):
            at = np.flatnonzero(sizes[whole] == size)
            a, b, w = left[at], right[at], whole[at]
            before = self.made[a] & self.made[b] & (self.rank[a] < self.rank[w]) & (self.rank[b] < self.rank[w])
            a, b, w = a[before], b[before], w[before]
            alone = self.left_alone(a, b, self.rank[w])
            self.left[w[alone]], self.right[w[alone]], self.made[w[alone]] = a[alone], b[alone], True

    def left_alone(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the text of pieces a, b leaves a and b; limit: only merges of a lesser rank count.

        The merges of both pieces are undone, the latest first.  Between two of them the pieces that touch are fixed,
        and had they a merge of a lesser rank than the one undone last, it would have come before. On equal ranks the left one comes first.
        """
        out = np.ones(len(a), bool)
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        live = np.arange(len(a))
        while len(live) and len(self.pairs):
            pair = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joins = (self.pairs[at] == pair) & (self.joined[at] < limit)
            out[live[joins]] = False
            undo_a, undone = self.rank[a] > self.rank[b], np.maximum(self.rank[a], self.rank[b])
            on = ~joins & (undone > 0)
            limit = np.where(undo_a, undone, undone + 1)[on]
            a, b, live = np.where(undo_a, self.right[a], a)[on], np.where(undo_a, b, self.left[b])[on], live[on]
        return out

    def _admitted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``left_alone``, remembered; what has no piece, and the start, leave all pieces alone."""
        out = (a < 0) | (b < 0)
        ask = np.flatnonzero(~out)
        pair = a[ask].astype(np.uint64) << np.uint64(32) | b[ask].astype(np.uint64)
        slot = (mix64(pair) & np.uint64(REMEMBERED - 1)).astype(np.int64)
        known = self.asked[slot] == pair + np.uint64(1)
        out[ask[known]] = self.told[slot[known]]
        if not known.all():
            new, first = np.unique(pair[~known], return_index=True)
            at = ask[~known][first]
            told, slot = self.left_alone(a[at], b[at]), slot[~known][first]
            self.asked[slot], self.told[slot] = new + np.uint64(1), told
            out[ask[~known]] = told[np.searchsorted(new, pair[~known])]
        return out

    @staticmethod
    def _key(piece: str) -> int:
        codes = np.array([[ord(c) for c in piece]], np.uint64)
        return int(PieceModel._hashes(codes)(0, len(piece))[0])

    @staticmethod
    def _hashes(codes: np.ndarray):
        """A function of (start, stop) giving each row's substring hash."""
        up, down = powers(codes.shape[1] + 1)
        total = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
        np.cumsum(((codes + np.uint64(1)) * up[: codes.shape[1]]).T, axis=0, out=total[1:])
        return lambda a, b: mix64((total[b] - total[a]) * down[a] + np.uint64(b - a))

    def _paths(self, parts: list[str]) -> np.ndarray:
        """For each place but the first of parts of equal length, the piece that starts there (-1: none has the character; -2: no piece starts)."""
        n, length = len(parts), len(parts[0])
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length)
        substring = self._hashes(codes.astype(np.uint64))
        last = np.full((length + 1, n), UNKNOWN, np.int32)
        last[0] = START
        back = np.repeat(np.arange(-1, length, dtype=np.int32)[:, None], n, axis=1)
        for stop in range(1, length + 1):
            rows, found, starts = [], [], []
            for start in range(max(0, stop - self.longest), stop):
                key = substring(start, stop)
                row = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, key[row]), len(self.keys) - 1)
                hit = self.keys[at] == key[row]
                if hit.any():
                    rows.append(row[hit])
                    found.append(self.of[at[hit]])
                    starts.append(np.full(len(rows[-1]), start, np.int32))
            if rows:
                row, piece, start = np.concatenate(rows), np.concatenate(found), np.concatenate(starts)
                ok = self._admitted(last[start, row], piece)
                row, piece, start = row[ok], piece[ok], start[ok]
                last[stop, row], back[stop, row] = piece, start
        path = np.full((length, n), START, np.int32)
        at, rows = np.full(n, length), np.arange(n)
        for _ in range(length):
            live = at > 0
            if not live.any():
                break
            rows, at = rows[live], at[live]
            before = back[at, rows]
            path[before, rows] = last[at, rows]
            at = before
        return np.ascontiguousarray(path.T)

    def _search(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of equal length, as little-endian 32-bit integers."""
        table = self._paths(parts)
        used = table != START
        ids, stops = self.ids[table[used]].astype("<i4").tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for i in np.flatnonzero((table == UNKNOWN).any(axis=1)).tolist():
            out[i] = self._ids(parts[i], table[i])
        return out

    def _ids(self, part: str, path: np.ndarray) -> bytes:
        used = path[path != START]
        return self._with_bytes(part, used) if (used == UNKNOWN).any() else self.ids[used].astype("<i4").tobytes()

    def _long(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of over ``LONGEST`` characters, all of whose chunks are searched together."""
        begins = [[*range(0, len(x) - LONGEST, LONGEST - OVERLAP), len(x) - LONGEST] for x in parts]
        chunks = [x[a : a + LONGEST] for x, own in zip(parts, begins, strict=True) for a in own]
        step = (1 << 22) // LONGEST
        paths = (row for k in range(0, len(chunks), step) for row in self._paths(chunks[k : k + step]))
        return [self._spliced(x, own, [next(paths) for _ in own]) for x, own in zip(parts, begins, strict=True)]

    def _spliced(self, part: str, begins: list[int], paths: list[np.ndarray]) -> bytes:
        out = np.full(len(part), START, np.int32)
        out[:LONGEST] = paths[0]
        for last, a, path in zip(begins, begins[1:], paths[1:], strict=False):
            stop = last + LONGEST
            both = a + np.flatnonzero((out[a:stop] != START) & (path[: stop - a] != START))
            both = both[both > a]
            known = np.flatnonzero(out[:stop] != START)
            before = out[known[np.searchsorted(known, both) - 1]]
            joins = both[self._admitted(before, path[both - a])]
            if not len(joins):
                return self._in_turn(part)
            # In the overlap's middle either chunk has text enough around it.
            at = int(joins[np.abs(joins - (a + stop) // 2).argmin()])
            out[at : a + LONGEST] = path[at - a :]
        return self._ids(part, out)

    def _in_turn(self, part: str) -> bytes:
        """As ``_long``, each chunk from a place at which the one before ends a piece; a chunk seen before (in a run or a pattern) isn't searched again."""
        out, seen, begin = np.full(len(part), START, np.int32), {}, 0

        def path(at: int) -> np.ndarray:
            chunk = part[at : at + LONGEST]
            if chunk not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[chunk] = self._paths([chunk])[0]
            return seen[chunk]

        own = path(0)
        while True:
            out[begin : begin + len(own)] = own
            if begin + len(own) == len(part):
                return self._ids(part, out)
            known = np.flatnonzero(own != START)
            for at in known[(known > 0) & (known < LONGEST - OVERLAP // 2)][: -9 : -1].tolist():
                following = path(begin + at)
                if self._admitted(own[known[known < at][-1:]], following[:1])[0]:
                    begin, own = begin + at, following
                    break
            else:
                return self._ids(part, self._paths([part])[0])

    def _with_bytes(self, part: str, pieces: np.ndarray) -> bytes:
        out, at = [], 0
        for i in pieces.tolist():
            if i >= 0:
                out.append(self.ids[i])
                at += len(self.pieces[self.ids[i]])
            else:
                out.extend(self.byte_ids[list(part[at].encode("utf-8", "replace"))].tolist())
                at += 1
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.cached > CACHE_CHARS:
            self.cache, self.cached = {}, 0
        cache = self.cache
        split = [PART.findall((SIGN if self.prefix else "") + x.replace(" ", SIGN)) if x else [] for x in texts]
        new = {p for parts in split for p in parts if p not in cache}
        self.cached += sum(map(len, new))
        by_size: dict[int, list[str]] = {}
        for p in new:
            by_size.setdefault(len(p), []).append(p)
        long = [p for size in [x for x in by_size if x > LONGEST] for p in by_size.pop(size)]
        cache.update(zip(long, self._long(long), strict=True))
        for size, parts in by_size.items():
            step = max(1, min(ROWS, (1 << 22) // size))
            for k in range(0, len(parts), step):
                cache.update(zip(parts[k : k + step], self._search(parts[k : k + step]), strict=True))
        return [np.frombuffer(b"".join([cache[p] for p in parts]), "<i4") for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        out: list[str] = []
        held = bytearray()
        for i in np.asarray(ids).tolist():
            b = int(self.byte_of[i])
            if b >= 0:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SIGN, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and ``ids`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = model(path).encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], ["doc_id", "ids"])

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", text).mapInArrow(run, own)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit integers) and the decoded text of every row of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = part.column(1)
                ids = [np.asarray(x.values.to_numpy(zero_copy_only=False), "<i4") if x.is_valid else np.zeros(0, "<i4") for x in column]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([model(path).decode(x) for x in ids], pa.string())], ["doc_id", "n_ids", "ids_crc32", "text"])

    own = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, own)
