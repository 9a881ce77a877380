"""Winnowing fingerprints, in DataFrame functions alone.

A text is cut into tokens: runs of characters other than ASCII white space of at most ``TOKEN``
characters, and each single character of longer runs, so that texts without spaces match wherever a
passage begins in them.  Every run of ``GRAM`` tokens has a hash; of every ``WINDOW`` consecutive hashes
the least is chosen, the rightmost on ties, and kept with its position.  So any ``GRAM + WINDOW -
1`` tokens that two texts share give both a common hash, and matches shorter than ``GRAM`` tokens never do.
Of a passage without white space of over ``TOKEN`` characters every character is a token in both texts.
A gram's hash is the XXH64 of its tokens' XXH64, made afresh for each gram and not rolled on: rolling would
give other hashes but the same guarantee.
A text of fewer than ``GRAM`` tokens has one hash of all of them; of fewer hashes than a window,
one window.

A hash's top 33 bits and its position, counted down in the low 30 bits, are packed in one long, so
the least long of a slice is the least hash at its rightmost position, and a text is fingerprinted
in one pass of array functions.  No string has more tokens than 30 bits count.

``compare`` needs each document's successor by id.  The ids are dealt into ranges by bounded
quantiles; the texts are shuffled once, into their range; the first row of each range is sent along
to the range before it.  No window spans the table.

Defined cases: null text is empty and has an empty fingerprint; two empty fingerprints are alike
(1.0), an empty one and another aren't (0.0); null ids come first; rows of one id follow each other
by text; a single row is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

TOKEN, GRAM, WINDOW = 16, 5, 8
POSITION_BITS = 30
LAST = (1 << POSITION_BITS) - 1
FIRST_ID = -(1 << 63)


def tokens(text: Column) -> Column:
    """Runs of at most ``TOKEN`` characters other than ASCII white space, and the characters of longer runs."""
    own = "[^\\x20\\x09-\\x0D]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?<!{own}){own}{{1,{TOKEN}}}+(?!{own})|{own}"), F.lit(0))


def selection(words: Column, gram: int = GRAM, window: int = WINDOW) -> list:
    """Steps (name, expression of the names before it) that end in ``sel``: the chosen hashes and positions, packed."""
    packed = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice("__asx_ids", i, gram)), POSITION_BITS + 1), POSITION_BITS) + (F.lit(LAST) - i)
    size = lambda c, k: F.sequence(F.lit(1), F.greatest(F.size(c) - k + 1, F.lit(1)))
    return [
        ("__asx_ids", F.transform(words, lambda w: F.xxhash64(w))),
        ("__asx_grams", F.transform(size("__asx_ids", gram), packed)),
        ("__asx_sel", F.when(F.size("__asx_ids") > 0, F.array_distinct(F.transform(size("__asx_grams", window), lambda i: F.array_min(F.slice("__asx_grams", i, window))))).otherwise(F.array().cast("array<long>"))),
    ]


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: array of (hash, position from 0) of the selected grams, packed; see ``unpacked``."""
    kept = df.columns
    for name, made in selection(tokens(F.col(text)), gram, window):
        df = df.withColumn(name, made)
    return df.select(*kept, F.col("__asx_sel").alias(out))


def unpacked(packed: Column) -> Column:
    """Array of struct(hash, position) from a packed selection."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, POSITION_BITS).alias("hash"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST)) - 1).alias("position")))


def hash_set(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, POSITION_BITS)))


def digest(packed: Column) -> Column:
    """32 hexadecimal digits of a selection: equal for equal selections."""
    part = lambda *c: F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0"))
    return F.concat(part(packed), part(F.lit(1), packed))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprint(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id and ``selected``: the (hash, position) pairs of every row."""
    found = with_fingerprint(docs.select("doc_id", "text"), "text", "__asx_packed", gram, window)
    return found.select("doc_id", unpacked(F.col("__asx_packed")).alias("selected"))


def in_ranges(docs: DataFrame) -> tuple[DataFrame, object]:
    """doc_id, text, ``last`` (a copy of the next range's first row) and the window of a range in order."""
    n = partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST_ID))
    cuts = []
    if n > 1:
        row = docs.agg(F.percentile_approx(key, [k / n for k in range(1, n)], F.lit(max(10_000, 20 * n))).alias("q")).first()
        cuts = sorted(set(row["q"] or []))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < key)) if cuts else F.lit(0)
    ranged = docs.withColumn("__asx_key", key).withColumn("__asx_range", at)
    least = sorted((r[0], r[1]) for r in ranged.groupBy("__asx_range").agg(F.min("__asx_key")).collect())  # at most one row per range
    before = {b: least[k - 1][0] for k, (b, _) in enumerate(least)}
    own = F.struct(F.col("__asx_range").alias("r"), F.lit(False).alias("last"))
    places = F.array(own)
    if least:
        firsts = F.create_map(*[x for b, k in least for x in (F.lit(b), F.struct(F.lit(k).alias("k"), F.lit(before[b]).alias("to")))])
        first = firsts[F.col("__asx_range")]
        places = F.when(F.col("__asx_key") == first["k"], F.array(own, F.struct(first["to"].alias("r"), F.lit(True).alias("last")))).otherwise(places)
    placed = ranged.select("doc_id", "text", "__asx_key", F.explode(places).alias("p")).select("doc_id", "text", "__asx_key", F.col("p.r").alias("__asx_range"), F.col("p.last").alias("last"))
    return placed, Window.partitionBy("__asx_range").orderBy("last", "__asx_key", "text")


def compare(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, the edited text's hash, both fingerprints and the likenesses of every row.

    The edited text has its last half replaced by the first characters of the next document.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed, order = in_ranges(rows)
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    followed = placed.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("next")
    found = with_fingerprint(with_fingerprint(followed, "text", "own", gram, window), "edited", "other", gram, window)
    found = found.withColumns({"edited_sha256": F.sha2("edited", 256), "fingerprint": digest(F.col("own")), "edited_fingerprint": digest(F.col("other")), "a": hash_set(F.col("own")), "b": hash_set(F.col("other"))}).drop("edited", "own", "other")
    found = found.withColumn("c", F.lead("a").over(order)).where("not last")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
