"""Keywords and vectors of texts worked out in the rows of the texts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from adspectra.operators import embedding, textprep
from adspectra.plans import reading  # noqa: F401  it registers its queries
from adspectra.registry import QUERIES


def brute_keywords(rows, n, least):
    counts, out = defaultdict(Counter), []
    for k, t in rows:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if len(x) > 2 and x not in textprep.STOP_WORDS]
        counts[k].update(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    for k, c in counts.items():
        weight = {x: m * (2 + (" " in x)) for x, m in c.items()}
        best = max(weight.values(), default=1)
        out += [(k, x, weight[x] / best, r) for r, x in enumerate(sorted(weight, key=lambda x: (-weight[x], x.encode()))[:n], 1) if weight[x] / best >= least]
    return sorted(out, key=repr)


def test_keywords_of_rows_and_keys(spark):
    """Texts of any kind, by themselves and in several rows of one key; many ties at the last place that is kept."""
    rows = [(1, "red shoes, red hats; red shoes"), (2, None), (3, ""), (4, "the of"), (5, "alone"), (6, " ".join(f"w{i:03d}" for i in range(400))), (7, "x9y " * 3000 + "Été été ÉTÉ 𝒜bc")]
    rows += [(8, "one two"), (8, "two one two"), (8, None), (None, "null key"), (None, "key null key"), (9, None), (9, None), (10, "aaa bbb aaa bbb aaa ccc ccc ddd")]
    df = spark.createDataFrame(rows, "id int, text string")
    for n, least in ((20, 0.1), (3, 0.0), (1, 0.5), (1000, 0.0)):
        assert sorted(map(tuple, textprep.keywords(df, "id", "text", n, least).collect()), key=repr) == brute_keywords(rows, n, least)


def test_words_are_grouped_only_for_keys_of_several_rows(spark):
    df = spark.createDataFrame([(1, "red shoes")], "id int, text string")
    plan = textprep.keywords(df, "id", "text", 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and re.search(r"__rows#\d+L > 1", plan[plan.index("Aggregate [") :]), plan


def test_words_are_hashed_once(spark):
    """Frequencies and vectors read one shuffle of features."""
    df = spark.createDataFrame([(1, "red shoes"), (2, "red"), (None, None)], "id int, text string")
    found = embedding.embeddings(df, "id", "text")
    assert len(found.collect()) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReusedExchange.*hashpartitioning\(id#", plan[: plan.index("Initial Plan")]), plan


def test_chunks_are_shuffled_by_document_alone(spark, sf):
    """Sentences, their sums and their vectors stay where their document was dealt to."""
    plan = QUERIES["document_semantic_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"(doc_id|feature)#\d+L?", x) for x in dealt), dealt
