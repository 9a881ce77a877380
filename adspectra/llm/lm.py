"""Cross-entropy difference of two matched n-gram models.

A target model of the documents labelled good and a background model of all documents give each
document's mean loss per token; their difference (target less background) is its score: the lower,
the more it reads like the target.

Both models share one vocabulary and one form.  Words are runs of bytes other than ASCII white space,
A-Z lower-cased, and the vocabulary is every word of the corpus.  The models are word bigrams
smoothed by words:
``P(b | a) = MIX * c(a b) / c(a) + (1 - MIX) * (c(b) + ALPHA) / (n + ALPHA * V)``, the second part
alone where a model never met ``a``, with a start mark before the first word.  ``c`` counts the
model's own documents (``c(a)`` only where a word follows), ``n`` is its tokens and ``V`` the number of
distinct words of all documents, so each model is a proper distribution over the vocabulary.  Every
word and every bigram of every document is counted by itself: it goes by a 64-bit hash, of which among
three thousand million distinct ones some 0.25 pairs are expected to be equal.

Plan: documents and good ids are dealt by id into parts of about ``PART`` bytes in one shuffle.  A part
sends each of its distinct words and bigrams with its counts to the one of as many ranges of
hashes that holds it; a range adds up the counts of all parts and answers every part in the order it was asked;
a part meets its answers and scores.  So the counts are spread over all tasks, a task holds one part or one range, a
word that every document has is sent once by each part, and nothing is collected or broadcast.

Defined cases: null or empty text has no tokens and null losses; an id counts as good only if
its least quality is 1 and its greatest toxicity 0 (null: not toxic); without good labels the target is the
uniform model; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, partitions, raw
from .wordbpe import BASE, powers

MIX, ALPHA = 0.6, 0.1
#: Bytes hashed at once; bytes of text of a part.
BLOCK, PART = 1 << 21, 1 << 24
#: Stands before a text's first word.
START = np.uint64(0xA0761D6478BD642F)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, and how many words each text has."""
    data = b"\n".join(texts).lower() + b"\n"
    text = np.frombuffer(data, np.uint8)
    space = SPACE[text]
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(space[1:] & solid[:-1]) + 1
    up, down = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=total[1:])
    word = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(x) + 1 for x in texts])
    at = np.searchsorted(starts, bounds)
    return word, np.diff(at)


def parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes."""
    a = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= BLOCK:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def good_ids(labels: DataFrame) -> DataFrame:
    """The ids that count as good, each once."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("__asx_good")).where("__asx_good")


class Grams:
    """The distinct words (the start mark with them) and bigrams of some texts, by hash in rising order, and each token's places among them."""

    def __init__(self, texts: list[bytes]):
        found = [token_hashes(texts[a:b]) for a, b in parts(texts)]
        word = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in found)])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        self.words, at = np.unique(np.append(word, START), return_inverse=True)
        self.word = at[:-1]
        self.before = np.empty(len(word), np.int64)
        self.before[1:] = self.word[:-1]
        first = np.cumsum(self.sizes) - self.sizes
        self.before[first[self.sizes > 0]] = at[-1]
        self.pairs, self.pair = np.unique(mix64(self.words[self.before] * np.uint64(BASE) + word), return_inverse=True)

    def counts(self, among: np.ndarray) -> list[np.ndarray]:
        """Of some tokens: how often each word occurs and goes before another, and how often each bigram occurs."""
        return [np.bincount(at[among], minlength=n) for at, n in ((self.word, len(self.words)), (self.before, len(self.words)), (self.pair, len(self.pairs)))]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits by planes of bytes, without the upper planes that are empty."""
    top = int(numbers.max(initial=0)).bit_length() + 7 >> 3
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T[:top]).tobytes()


def unpacked(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((8, n), np.uint8)
    if planes:
        out[: len(planes) // n] = np.frombuffer(planes, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def apart(spark: SparkSession, n: int) -> list[int]:
    """Numbers of which each goes to another one of ``n`` partitions."""
    place = F.pmod(F.hash("id"), F.lit(n))
    return [r.id for r in spark.range(64 * n).groupBy(place.alias("place")).agg(F.min("id").alias("id")).orderBy("place").collect()]


#: Counts of words in the background and the target, of words before another, and of bigrams.
COUNTED = ("word_all", "word_own", "before_all", "before_own", "pair_all", "pair_own")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of every row; losses per token, in nats."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-size // PART))
    places = apart(spark, n)
    kind = docs.schema["doc_id"].dataType
    part = F.get(F.lit(places), F.pmod(F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64("text")), F.lit(len(places))).cast("int")).cast("bigint").alias("part")
    good = good_ids(labels.select(F.col("doc_id").cast(kind).alias("doc_id"), "quality", "toxic"))
    rows = docs.select("doc_id", "text", F.lit(False).alias("label")).unionAll(good.select("doc_id", F.lit(None).cast("string"), F.lit(True))).select(part, "doc_id", "text", "label")
    dealt = rows.repartition(n, "part")

    def send(rows: pa.Table) -> pa.Table:
        own = rows.filter(pc.invert(rows["label"]))
        good = pc.is_in(own["doc_id"], value_set=rows.filter(rows["label"])["doc_id"].combine_chunks()).to_numpy().astype(bool)
        found = Grams(raw(own["text"]))
        every, target = (found.counts(x) for x in (slice(None), np.repeat(good, found.sizes)))
        out = {name: [] for name in sent_schema.names}
        if own.num_rows:
            words, pairs = (edges(x, len(places)) for x in (found.words, found.pairs))
            for k, place in enumerate(places):
                w, p = slice(*words[k : k + 2]), slice(*pairs[k : k + 2])
                values = [place, rows["part"][0].as_py(), k, w.stop - w.start, p.stop - p.start, packed(steps(found.words[w])), packed(steps(found.pairs[p]))]
                values += [packed(x) for x in (every[0][w], target[0][w], every[1][w], target[1][w], every[2][p], target[2][p])]
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
        return pa.table(out, sent_schema)

    def answer(sent: pa.Table) -> pa.Table:
        got = {name: sent[name].to_pylist() for name in sent.column_names}
        out = {name: got[name] for name in ("part", "range")}
        for of, n_of, names in (("words", "n_words", COUNTED[:4]), ("pairs", "n_pairs", COUNTED[4:])):
            keys = np.concatenate([np.cumsum(unpacked(x, m), dtype=np.uint64) for x, m in zip(got[of], got[n_of], strict=True)])
            distinct, at = np.unique(keys, return_inverse=True)
            ends = np.cumsum([0, *got[n_of]])
            for name in names:
                own = np.concatenate([unpacked(x, m) for x, m in zip(got[name], got[n_of], strict=True)])
                total = np.bincount(at, weights=own, minlength=len(distinct)).astype(np.uint64)
                out[name] = [packed(total[at[a:b]]) for a, b in zip(ends, ends[1:])]
                if of == "words" and name in COUNTED[:2]:
                    out[f"n_{name}"] = [int(total.sum())] * len(sent)
                    if name == "word_all":
                        out["n_distinct"] = [int(np.count_nonzero(total))] * len(sent)
        return pa.table({name: out[name] for name in answer_schema.names}, answer_schema)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows.filter(pc.invert(rows["label"]))
        found = Grams(raw(rows["text"]))
        answers = answers.sort_by("range")
        bounds = [np.diff(edges(x, len(places))) for x in (found.words, found.pairs)]
        if rows.num_rows and answers["range"].to_pylist() != list(range(len(places))):
            raise RuntimeError("a part lacks answers: the documents changed between two reads")
        got = [np.concatenate([np.zeros(0), *(unpacked(x, m) for x, m in zip(answers[name].to_pylist(), bounds[name.startswith("pair")], strict=True))]) if rows.num_rows else np.zeros(0) for name in COUNTED]
        distinct = pc.sum(answers["n_distinct"]).as_py() or 0
        first = np.concatenate([[0], np.cumsum(found.sizes)])
        means, none = [], found.sizes == 0
        for k, name in ((1, "n_word_own"), (0, "n_word_all")):
            word, before, pair = got[k::2]
            tokens = pc.sum(answers[name]).as_py() or 0
            single = (word[found.word] + ALPHA) / (tokens + ALPHA * distinct) if len(found.word) else np.zeros(0)
            met = before[found.before]
            step = np.divide(pair[found.pair], met, out=single.copy(), where=met > 0)
            losses = -np.log(np.where(met > 0, MIX * step + (1 - MIX) * single, single))
            sums = np.diff(np.concatenate([[0], np.cumsum(losses)])[first])
            means.append(np.divide(sums, found.sizes, out=np.zeros(len(sums)), where=~none))
        return pa.table([rows["doc_id"], pa.array(found.sizes, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1]))], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    sent_schema = pa.schema([("place", pa.int64()), ("part", pa.int64()), ("range", pa.int32()), ("n_words", pa.int32()), ("n_pairs", pa.int32()), *((x, pa.binary()) for x in ("words", "pairs", *COUNTED))])
    answer_schema = pa.schema([("part", pa.int64()), ("range", pa.int32()), *((x, pa.binary()) for x in COUNTED), *((x, pa.int64()) for x in ("n_word_all", "n_word_own", "n_distinct"))])
    binary = lambda names: ", ".join(f"{x} binary" for x in names)
    sent = dealt.groupBy("part").applyInArrow(send, f"place long, part long, range int, n_words int, n_pairs int, {binary(('words', 'pairs', *COUNTED))}")
    answers = sent.repartition(n, "place").groupBy("place").applyInArrow(answer, f"part long, range int, {binary(COUNTED)}, n_word_all long, n_word_own long, n_distinct long")
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("target_loss", "background_loss", "score"))])
    return dealt.groupBy("part").cogroup(answers.repartition(n, "part").groupBy("part")).applyInArrow(score, out)


def edges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of hashes begins among sorted keys, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, np.arange(1, n, dtype=np.uint64) * np.uint64((1 << 64) // n)), [len(keys)]]).astype(np.int64)


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as the first and the differences."""
    return np.diff(keys, prepend=np.uint64(0))
