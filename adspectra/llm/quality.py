"""Quality rules: rule statistics, fixed rules, and an isolation forest over the statistics.

Words are runs of bytes other than ASCII white space.  Per document: ``n_words``; ``word_chars``
(code points in words); ``n_symbols`` (characters of ``#*$%&|<>``); ``n_dup_lines`` (lines with a
word that equal an earlier line); ``n_repeat_words`` (words in 5-word windows found twice or more
in the text, the first included).  A document fails the base rules with under 10 words or with
more than a fifth of its words repeated.

Isolation forests isolate documents by random splits of ratios of these statistics: one for each
group of statistics and one for all, so that what is rare in one rule isn't hidden by the others.
A short mean path over the trees makes a document an anomaly.  Each forest's threshold is
calibrated on the labelled rows: it catches as many poor rows as it can while it loses at most
``KEPT_LOSS`` of the good ones; a forest that catches none is dropped.  Fitting takes a bounded
sample of labelled rows (``SAMPLE``, the least hashes of their ids); all else covers every row.

Plan: one scan for the sample's statistics (a broadcast semi join on at most ``SAMPLE`` ids), one
scan for all rows; no shuffle of documents.

Defined cases: null or empty text has no words and fails the base rules; without labelled rows of
both kinds there is no forest and the base rules alone decide; duplicate or null labels: an id
counts as good only if all its labels are 1; repeated rows get equal results; an empty table gives
an empty result; all columns of the input are kept by ``keep`` and ignored by ``measure``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, raw

LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SAMPLE = 8192
TREES, TREE_ROWS, DEPTH, SEED = 100, 256, 8, 20240
#: At most this share of the good labelled rows may be lost by a forest's threshold, and each lost share must be outweighed so many times by what it catches.
KEPT_LOSS, WORTH = 0.002, 20
#: Columns of ``features`` that one forest takes: word length; symbols; lines; repeats; capitals and shouts; all.
GROUPS = ([0], [1], [2], [3], [4, 5], [0, 1, 2, 3, 4, 5])
#: Words of usual length that every text counts as having besides its own, so that a short text's ratios aren't extreme by chance.
PRIOR_WORDS, PRIOR_CHARS = 40, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further statistics of the forest's rows.
MORE = ("n_upper", "n_letters", "n_shouts", "n_lines")
_SPACE = bytes(range(9, 14)) + b" "
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(0x80, 0x100))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of ``WINDOW`` words that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base, key = len(ids), code[: n]
    for k in range(1, WINDOW):
        if int(key.max()) * base >= 1 << 62:  # renumber before the keys outgrow 64 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * base + code[k : k + n]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[which] > 1)
    if not len(often):
        return 0
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, often, 1)
    np.add.at(mark, often + WINDOW, -1)
    return int((np.cumsum(mark) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of one text in UTF-8."""
    words = text.split()
    solid = text.translate(None, _SPACE)
    continued = len(solid) - len(solid.translate(None, bytes(range(0x80, 0xC0))))
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            if line in seen:
                n_dup += 1
            else:
                seen.add(line)
    left = len(solid)
    drop = lambda chars: left - len(solid.translate(None, chars))
    return (len(words), left - continued, drop(SYMBOLS), n_dup, repeated_words(words), drop(_UPPER), drop(_LETTERS), solid.count(b"!"), n_lines)


def features(stats: np.ndarray) -> np.ndarray:
    """The forest's columns from rows of COUNTS and MORE."""
    s = stats.astype(np.float64)
    words, letters = s[:, 0] + PRIOR_WORDS, s[:, 6] + PRIOR_WORDS * PRIOR_CHARS
    return np.column_stack([(s[:, 1] + PRIOR_WORDS * PRIOR_CHARS) / words, s[:, 2] / words, s[:, 3] / (s[:, 8] + 1), s[:, 4] / words, s[:, 5] / letters, s[:, 7] / words])


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as arrays: ``column`` (-1: leaf), ``cut``, ``path`` (depth plus the leaf's expected rest); node k has children 2k+1, 2k+2."""

    def __init__(self, rows: np.ndarray, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        take = min(TREE_ROWS, len(rows))
        self.norm = float(expected_path(take)) or 1.0
        nodes = (1 << (DEPTH + 1)) - 1
        self.column = np.full((TREES, nodes), -1, np.int16)
        self.cut = np.zeros((TREES, nodes))
        self.path = np.zeros((TREES, nodes))
        for t in range(TREES):
            self._grow(t, 0, 0, rows[rnd.choice(len(rows), take, replace=False)], rnd)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rnd: np.random.Generator) -> None:
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth == DEPTH or len(rows) < 2 or not len(wide):
            self.path[t, node] = depth + float(expected_path(len(rows)))
            return
        k = int(rnd.choice(wide))
        at = rnd.uniform(low[k], high[k])
        self.column[t, node], self.cut[t, node] = k, at
        # A value beyond all that were seen leaves the tree on the side of the fewest rows, as in any isolation tree.
        self._grow(t, 2 * node + 1, depth + 1, rows[rows[:, k] <= at], rnd)
        self._grow(t, 2 * node + 2, depth + 1, rows[rows[:, k] > at], rnd)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score: near 1 for rows that a few splits isolate, under 0.5 for usual ones."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for t in range(TREES):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                k = self.column[t, node]
                inner = k >= 0
                if not inner.any():
                    break
                right = rows[every, np.maximum(k, 0)] > self.cut[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.path[t, node]
        return 2.0 ** (-total / TREES / self.norm)


class Model:
    """Base rules, and one calibrated forest for each group of statistics where labelled rows allowed it."""

    def __init__(self, forests: list[tuple[list[int], IsolationForest, float]] = ()):
        self.forests = list(forests)

    def judge(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base_failed, the largest excess of a forest's score over its threshold (-1 without forests), kept."""
        n, repeated = stats[:, 0], stats[:, 4]
        failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
        x = features(stats)
        excess = np.full(len(stats), -1.0)
        for columns, forest, threshold in self.forests if len(stats) else ():
            excess = np.maximum(excess, forest.score(x[:, columns]) - threshold)
        return failed, excess, ~failed & (excess <= 0)


def fit(stats: np.ndarray, good: np.ndarray) -> Model:
    """From the statistics of labelled rows and whether each is good."""
    usable = stats[:, 0] >= LEAST_WORDS if len(stats) else np.zeros(0, bool)
    usable &= 100 * stats[:, 4] <= MOST_REPEATED * stats[:, 0]
    fine, poor = usable & good, usable & ~good
    if fine.sum() < 2 or not poor.any():
        return Model()
    x, forests = features(stats), []
    for columns in GROUPS:
        forest = IsolationForest(x[usable][:, columns])
        score = forest.score(x[:, columns])
        at_good, at_poor = np.sort(score[fine]), np.sort(score[poor])
        cuts = np.unique(score[usable])
        lost = 1 - np.searchsorted(at_good, cuts, side="right") / len(at_good)
        caught = 1 - np.searchsorted(at_poor, cuts, side="right") / len(at_poor)
        worth = np.where(lost <= KEPT_LOSS, caught - WORTH * lost, -1)
        k = len(worth) - 1 - int(np.argmax(worth[::-1]))
        # Between two scores seen, so that neither side's rows lie at the threshold itself.
        if worth[k] > 0:
            forests.append((columns, forest, float((cuts[k] + cuts[k + 1]) / 2)))
    return Model(forests)


def measured(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.array([statistics(x) for x in raw(batch.column(text))], np.int64).reshape(-1, len(COUNTS) + len(MORE))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows."""
    judged = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("__asx_good")).where("doc_id is not null")
    chosen = F.broadcast(judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            s = measured(batch, "text")
            yield pa.RecordBatch.from_arrays([batch.column("__asx_good").cast(pa.int64()), *map(pa.array, s.T)], ["good", *COUNTS, *MORE])

    own = T.StructType([T.StructField(x, T.LongType()) for x in ("good", *COUNTS, *MORE)])
    # A repeated id may bring more rows than ids; its least text is taken.
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__asx_good").alias("__asx_good")).select("text", "__asx_good").mapInArrow(stats, own)
    got = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 1 + len(COUNTS) + len(MORE))  # at most ``sample`` rows of counts
    got = got[np.lexsort(got.T[::-1])]
    return fit(got[:, 1:], got[:, 0] == 1)


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            s = measured(batch, "text")
            failed, score, kept = model.judge(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, s[:, : len(COUNTS)].T), pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(judge, own)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the rules and the forest keep, with all their columns."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(model.judge(measured(batch, "text"))[2]))

    return docs.mapInArrow(passing, docs.schema)
