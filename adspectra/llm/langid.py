"""Language identification by error-correcting output codes.

Each language has a codeword of bits, and for each bit a binary classifier over character n-grams tells the languages with a
1 from those with a 0.  Up to ``EXHAUSTIVE`` languages have the exhaustive code (every way to part them in two), more have random
words of ``BITS_EACH`` * log2(languages) bits, the draw of the greatest least distance of several.  A text gets the language whose codeword has the
least loss: the sum over bits of the logistic loss of the classifier's margin against the word's bit, weighted by how well that
classifier tells texts it wasn't fitted on.  Where the second-least loss is near, or the texts's n-grams are unknown, the row is flagged.

Features: n-grams of 1 to 3 code points of the lower-cased text, runs of anything but letters taken as one space; hashed to
``CELLS`` cells; the square roots of their shares of the text, scaled to length 1.  The whole text is read.

Fitting: on a bounded sample of rows with a text that has a letter and a language, at most ``EACH`` rows of a language, the least by a
hash of text and id, and ``SAMPLE`` rows in all; every fourth of them weighs the classifiers instead of fitting them.  The rows are chosen
first within buckets of each language and then among the chosen, so no language is ranked by one task; what the driver
gets is bounded by ``SAMPLE`` rows of at most ``CELLS`` counts.

Defined cases: null text, and text without a letter, is ``und`` with score 0; a text is judged whole at any length; without any
labelled row all are ``und``; with one language all texts with a letter are that language's, with score 1; rows that repeat an id or
a text are judged alike; a null id is held in no fold (``held_out`` false) and never learned from; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64

UNDETERMINED = "und"
LONGEST_GRAM, CELLS = 3, 1 << 14
#: Rows of a language, and rows in all, that the fit looks at; buckets in which a language's rows are ranked first.
EACH, SAMPLE, BUCKETS = 256, 8192, 64
EXHAUSTIVE, BITS_EACH, DRAWS = 7, 10, 32
ROUNDS, RATE, DECAY = 60, 0.5, 1e-4
#: A loss less than this part above the least is near it.
NEAR = 0.05
NO_LETTER = re.compile(r"[\W\d_]+")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a text's n-grams and how often each occurs."""
    plain = f" {NO_LETTER.sub(' ', text.lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    key, cells = np.zeros(len(codes), np.uint64), np.zeros(CELLS, np.int64)
    for n in range(1, LONGEST_GRAM + 1):
        if len(codes) < n:
            break
        key = key[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        cells += np.bincount((mix64(key + np.uint64(n)) >> np.uint64(50)).astype(np.int64), minlength=CELLS)
    at = np.flatnonzero(cells)
    return at, cells[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(NO_LETTER.sub("", text))


def scaled(n: np.ndarray) -> np.ndarray:
    return np.sqrt(n / max(int(n.sum()), 1))


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` languages, no bit alike for all and no two bits alike or opposite."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        bits = np.arange(1, 1 << (n - 1))
        return np.array([np.where((bits >> k) & 1, -1, 1) if k < n - 1 else np.ones(len(bits)) for k in range(n)], np.int8)
    rnd, best, reach = np.random.default_rng(seed), None, -1
    for _ in range(DRAWS):
        words = np.where(rnd.random((n, math.ceil(BITS_EACH * math.log2(n)))) < 0.5, -1, 1).astype(np.int8)
        apart = (words.shape[1] - words.astype(np.int32) @ words.T.astype(np.int32)) // 2
        least = int(apart[~np.eye(n, dtype=bool)].min())
        split = np.abs(words.sum(axis=0)) < n
        if split.all() and least > reach:
            best, reach = words, least
    if best is None:
        raise ValueError("no code was found; give more bits")
    return best


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray
    #: Cells by bits, a constant and a weight for each bit.
    weights: np.ndarray
    constants: np.ndarray
    trust: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Rows by languages: the weighted mean logistic loss against each codeword."""
        against = np.logaddexp(0, -margins[:, None, :] * self.words[None])
        return (against * self.trust).sum(axis=2) / max(float(self.trust.sum()), 1e-12)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, the score (the share of the likeliest in the likelihoods that the losses stand for) and whether it is unsure."""
        lettered = np.array([has_letter(x) for x in texts], bool) if self.languages else np.zeros(len(texts), bool)
        out, score, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), ~lettered
        rows = np.flatnonzero(lettered)
        if not len(rows):
            return out, score, unsure
        margins = np.zeros((len(rows), self.words.shape[1]))
        for k, i in enumerate(rows.tolist()):
            at, n = counts(texts[i])
            margins[k] = scaled(n) @ self.weights[at] + self.constants
        losses = self.losses(margins)
        best = losses.argmin(axis=1)
        like = np.exp((losses.min(axis=1)[:, None] - losses) * max(self.words.shape[1], 1))
        score[rows] = 1 / like.sum(axis=1)
        if len(self.languages) > 1:
            first, second = np.partition(losses, 1, axis=1)[:, :2].T
            unsure[rows] = second - first < NEAR * np.maximum(first, 1e-9)
        for k, i in enumerate(rows.tolist()):
            out[i] = self.languages[best[k]]
        return out, score, unsure


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """From (language, cells, counts) of each row."""
    languages = sorted({r[0] for r in rows})
    words = codewords(len(languages))
    n_bits = words.shape[1]
    weights, constants, trust = np.zeros((CELLS, n_bits), np.float32), np.zeros(n_bits), np.ones(n_bits)
    if not n_bits:
        return Model(languages, words, weights, constants, trust)
    index = {x: i for i, x in enumerate(languages)}
    seen: dict[str, int] = {}
    for_fit = []
    for r in rows:  # every fourth row of a language weighs
        seen[r[0]] = seen.get(r[0], 0) + 1
        for_fit.append(seen[r[0]] % 4 != 0)
    for_fit = np.array(for_fit)
    sizes = np.array([len(r[1]) for r in rows])
    row, cell = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[1] for r in rows])
    value = np.concatenate([scaled(r[2]) for r in rows]).astype(np.float32)
    target = words[[index[r[0]] for r in rows]].astype(np.float32)
    # Each language counts alike, and each side of a bit by its languages.
    many = np.bincount([index[r[0]] for r in rows], for_fit, minlength=len(languages))
    share = (for_fit / np.maximum(many, 1)[[index[r[0]] for r in rows]] / len(languages)).astype(np.float32)[:, None]
    by_cell = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[by_cell], return_index=True)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    steps, level = np.full((len(cells), n_bits), 1e-8, np.float32), np.full(n_bits, 1e-8)
    own = np.zeros((len(cells), n_bits), np.float32)
    place = np.searchsorted(cells, cell)

    def margins() -> np.ndarray:
        out = np.empty((len(rows), n_bits), np.float32)
        for b in range(n_bits):
            out[:, b] = np.add.reduceat(value * own[place, b], begins)
        return out + constants

    for _ in range(ROUNDS):
        pull = share * target / (1 + np.exp(np.minimum(target * margins(), 30)))
        for b in range(n_bits):
            slope = np.add.reduceat((value * pull[row, b])[by_cell], starts) - DECAY * own[:, b]
            steps[:, b] += slope * slope
            own[:, b] += RATE * slope / np.sqrt(steps[:, b])
        slope = pull.sum(axis=0)
        level += slope * slope
        constants += RATE * slope / np.sqrt(level)
    weights[cells] = own
    if (~for_fit).any():
        right = (margins()[~for_fit] * target[~for_fit] > 0).mean(axis=0)
        trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, words, weights, constants, trust)


def labelled(docs: DataFrame, each: int = EACH, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (lang, text) with a letter and a language, at most ``each`` of a language."""
    of = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text")
    # The same text again teaches nothing, and its hash alone is shuffled until the rows are chosen.
    hashed = of.select("lang", F.xxhash64("text", "lang").alias("h"))
    first = hashed.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))).groupBy("lang", "bucket", "h").agg(F.count(F.lit(1)).alias("n"))

    def least(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("at") <= each)

    chosen = least(least(first, "lang", "bucket").select("lang", "h"), "lang").orderBy("at", "h", "lang").limit(sample)
    return of.withColumn("h", F.xxhash64("text", "lang")).join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def train(docs: DataFrame, each: int = EACH, sample: int = SAMPLE) -> Model:
    """Fits on ``labelled`` rows; only their n-gram counts come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary())], ["lang", "h", "cells", "counts"])

    own = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    got = labelled(docs, each, sample).select("lang", "h", "text").mapInArrow(counted, own).collect()  # at most ``sample`` rows
    got.sort(key=lambda r: (r.lang, r.h))
    return fit([(r.lang, np.frombuffer(r.cells, "<i4"), np.frombuffer(r.counts, "<i8")) for r in got])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x bits of the code

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                languages, score, unsure = shared.value.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(judge, own)
