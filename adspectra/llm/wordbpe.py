"""Ids of a word-level BPE tokenizer file (BPE with an end-of-word suffix, lower case, white space dropped).

The ids are those of the ``tokenizers`` library with ``add_special_tokens=False``.  A text of
Latin-1 characters without apostrophes (contractions are words of their own) and without the
tokenizer's special strings takes the fast way: the different words of a batch of texts are merged
in numpy, words of one length advancing together.  Any other text is given to the library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import mix64

#: No such pair. Ids and ranks have 16 bits.
INF = np.uint16(65535)
#: Longest symbol count of the batched merge; longer words go to the library.
LONGEST = 48
#: Characters whose words are merged together.
BATCH_CHARS = 1 << 20
BASE = 0x9E3779B97F4A7C15

#: The letters and numbers of Latin-1, as the pre-tokenizer's pattern tells them; it takes a run of letters, one number, or a run of neither as a word.
LETTERS = re.compile("[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]")
NUMBERS = re.compile("[0-9\xb2\xb3\xb9\xbc-\xbe]")
SPACES = (9, 10, 11, 12, 13, 0x85, 0xA0)
LOWER = bytes(32 if i in SPACES else i + 32 if 65 <= i <= 90 or 0xC0 <= i <= 0xDE and i != 0xD7 else i for i in range(256))
#: 0 white space, 1 letter, 2 number, 3 other.
KIND = np.array([0 if i == 32 or i in SPACES else 1 if LETTERS.match(chr(i)) else 2 if NUMBERS.match(chr(i)) else 3 for i in range(256)], np.uint8)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.uint16)
        self.final = np.array([vocab[c + end] for c in letters], np.uint16)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        made = np.array([vocab[a + b] for a, b in pairs], np.uint16)
        if max(len(vocab), len(pairs)) >= 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self._index(keys, made)

    def _index(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Two hash tables without chains: what meets an earlier key in the first goes to the second."""
        self.made = made
        self.first, left = self._table(keys, np.arange(len(keys), dtype=np.uint16), 21, 2654435761)
        for factor in range(2246822519, 2246822519 + 4000, 2):
            self.second, rest = self._table(keys[left], left, 18, factor)
            if not len(rest):
                return
        raise RuntimeError("no hash without collisions was found")

    @staticmethod
    def _table(keys: np.ndarray, ranks: np.ndarray, bits: int, factor: int):
        shift = np.uint32(32 - bits)
        at = keys * np.uint32(factor) >> shift
        order = np.argsort(at, kind="stable")
        head = np.ones(len(at), bool)
        head[1:] = at[order][1:] != at[order][:-1]
        keep = order[head]
        slots, value = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, INF, np.uint16)
        slots[at[keep]], value[at[keep]] = keys[keep], ranks[keep]
        return (slots, value, np.uint32(factor), shift), np.sort(ranks[order[~head]])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slots, value, factor, shift = self.first
        at = key * factor >> shift
        out = np.where(slots[at] == key, value[at], INF)
        slots, value, factor, shift = self.second
        at = key * factor >> shift
        return np.where(slots[at] == key, value[at], out)

    def _merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (rows of equal length) and how many of each row count; words: uint8 [n, length]."""
        n, length = words.shape
        ids = self.inner[words]
        ids[:, -1] = self.final[words[:, -1]]
        out, sizes = np.zeros((n, length), np.uint16), np.full(n, length, np.int64)
        live = np.arange(n)
        ranks = self._rank(ids[:, :-1], ids[:, 1:]) if length > 1 else np.zeros((n, 0), np.uint16)
        for width in range(length, 0, -1):
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(live), np.int64)
            least = ranks[np.arange(len(live)), best] if width > 1 else np.full(len(live), INF)
            done = least == INF
            if done.any():
                out[live[done], :width], sizes[live[done]] = ids[done], width
                go = ~done
                live, ids, ranks, best, least = live[go], ids[go], ranks[go], best[go], least[go]
            if not len(live):
                break
            row = np.arange(len(live))
            ids[row, best] = self.made[least]
            ids = np.where(np.arange(width - 1) <= best[:, None], ids[:, :-1], ids[:, 1:])
            if width > 2:
                ranks = np.where(np.arange(width - 2) < best[:, None], ranks[:, :-1], ranks[:, 1:])
                r = np.flatnonzero(best < width - 2)
                ranks[r, best[r]] = self._rank(ids[r, best[r]], ids[r, best[r] + 1])
                r = np.flatnonzero(best > 0)
                ranks[r, best[r] - 1] = self._rank(ids[r, best[r] - 1], ids[r, best[r]])
        return out, sizes

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _words(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words at ``starts`` of UTF-8 bytes: all ids, and each word's first and number."""
        n = len(starts)
        at, count, parts, used = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            for k in range(0, len(own), 20_000):
                part = own[k : k + 20_000]
                if size > LONGEST:
                    ids = [self._library(text[x : x + size].tobytes().decode()) for x in starts[part].tolist()]
                    made = np.array([len(x) for x in ids])
                    flat = np.concatenate(ids)
                else:
                    ids, made = self._merge(text[starts[part, None] + np.arange(size)])
                    flat = ids[np.arange(size) < made[:, None]].astype("<u4")
                at[part], count[part] = used + np.cumsum(made) - made, made
                parts.append(flat)
                used += len(flat)
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), at, count

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of lower-cased Latin-1 texts without apostrophes."""
        joined = b" ".join(texts) + b" "
        chars = np.frombuffer(joined, np.uint8)
        kind = KIND[chars]
        edge = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == 2
        edges = np.flatnonzero(edge)
        word = kind[edges] != 0
        ends = np.append(edges[1:], len(kind))[word]
        starts = edges[word]
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in texts]))
        text = chars
        if chars.max(initial=0) >= 128:
            text = np.frombuffer(joined.decode("latin-1").encode(), np.uint8)
            place = np.zeros(len(chars) + 1, np.int64)
            np.cumsum((chars >= 128) + 1, out=place[1:])
            starts, ends = place[starts], place[ends]
        sizes = ends - starts
        up, down = powers(len(text))
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        key = mix64((total[ends] - total[starts]) * down[starts] + sizes.astype(np.uint64))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        # The hashes only find equal words; their bytes are compared as well.
        before = np.cumsum(sizes) - sizes
        step = np.arange(sizes.sum(), dtype=np.int32)
        own, other = (np.repeat((x - before).astype(np.int32), sizes) + step for x in (starts, starts[first][which]))
        if not np.array_equal(sizes, sizes[first][which]) or not np.array_equal(text[own], text[other]):
            return [self._library(x.decode("latin-1")) for x in texts]
        flat, at, count = self._words(text, starts[first], sizes[first])
        count, at = count[which], at[which]
        stop = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(at - stop[:-1], count) + np.arange(stop[-1])]
        cuts = stop[bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        held, room = [], BATCH_CHARS

        def flush():
            nonlocal held, room
            for (i, _), ids in zip(held, self._plain([x for _, x in held]), strict=True):
                out[i] = ids
            held, room = [], BATCH_CHARS

        for i, x in enumerate(texts):
            try:
                if "'" in x or "<|" in x and any(s in x for s in self.special):
                    raise UnicodeEncodeError("latin-1", "", 0, 0, "not plain")
                held.append((i, x.encode("latin-1").translate(LOWER)))
                room -= len(x)
                if room <= 0:
                    flush()
            except UnicodeEncodeError:
                out[i] = self._library(x)
        if held:
            flush()
        return out


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(1 << max(1, n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]
