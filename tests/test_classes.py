"""Classes of alike rows: pairs out of pairs of classes, and scores worked out once for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from adspectra.operators import classes, evaluation, targeting, taxonomy
from adspectra.plans import matching
from adspectra.sources.driver import Tables


def test_pairs_of_classes_are_all_pairs_of_rows(spark):
    """Classes of many blocks, of null features and of one row; some pairs left out."""
    left = spark.range(3000).select(F.col("id").alias("p"), F.when(F.col("id") % 7 > 0, (F.col("id") > 20).cast("int")).alias("f"))
    right = spark.range(500, 540).select(F.col("id").alias("a"), (F.col("id") % 3).alias("g"))
    here = classes.placed(left, "p", "f")
    assert {r.n for r in here.collect()} == {18, 429, 2553} and classes.blocks(here, "p").agg(F.max(F.size("ids"))).first()[0] < 2000
    blocks = classes.blocks(here.where("p > 1"), "p").withColumn("skip", F.lit(None).cast("array<bigint>"))
    alone = here.where("p < 2").select("class", F.array("p").alias("ids"), F.array(F.lit(501).cast("bigint"), F.lit(9).cast("bigint")).alias("skip"))
    met = classes.classes(left, "p", "f").select(F.col("class").alias("l"), F.col("f")).crossJoin(classes.classes(right, "a", "g").select(F.col("class").alias("r"), "g")).where("g < 2")
    found = classes.expanded(met, blocks.unionByName(alone), classes.blocks(classes.placed(right, "a", "g"), "a"), "p", "a")
    want = left.crossJoin(right).where("g < 2 and not (p < 2 and a = 501)").select("p", "a", "f", "g")
    assert found.count() == want.count() and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_groups_meet_in_parts(spark):
    """Every row meets every item of its group's partners once, in groups of several parts and blocks."""
    left = spark.range(3000).select(F.col("id").alias("l"), (F.col("id") % 2 * F.col("id") % 3).alias("p"))
    right = spark.range(2500).select(F.col("id").alias("r"), (F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("x"))
    held = classes.blocked(right, "a", F.lit(1), "r", "x")
    assert held.count() == 4 and held.agg(F.max(F.size("held"))).first()[0] < 1000
    pairs = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25), (1, 1, 0.75), (9, 1, 1.0)], "p bigint, a bigint, s double")
    columns = ["l", "p", "r", "a", "x", "s"]
    found, want = classes.met_in_place(pairs, left, held, "p", "a").select(columns), left.join(pairs, "p").join(right, "a").select(columns)
    assert found.count() == want.count() > 2000 * 1250
    total = lambda df: df.agg(F.sum(F.xxhash64(*columns).cast("decimal(38, 0)"))).first()[0]
    assert total(found) == total(want)


def test_pairs_of_rows_come_one_by_one(spark, sf):
    """Compiled code holds back all rows that it makes of one row, so of two arrays the outer isn't read by it."""
    blocks = spark.range(4).select(F.sequence(F.lit(0).cast("bigint"), "id").alias("ls"), F.sequence("id", F.lit(9).cast("bigint")).alias("rs"), "id")
    plan = classes.rows_of(blocks, "p", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(transform(ls" in plan and ") Generate explode(transform(ls" not in plan and ") Generate explode(rs" in plan, plan
    for name in ("entity_score", "candidate_match", "candidate_match_bitmaps"):
        assert "explode(transform(" in getattr(matching, name)(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString(), name


def test_pairs_of_classes_are_not_shuffled(spark, sf):
    """Classes of pages and ads meet, are scored and become rows, or are ranked, in one task."""
    for name in ("quality_score", "auction_top_n"):
        plan = getattr(matching, name)(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
        here = plan[plan.index("_score"):plan.index("explode(transform(held")]
        assert name == "auction_top_n" or ("Join" not in here and "Repartition" not in here), here
        below = plan[plan.index("explode(transform(held"):]
        assert below.count("RepartitionByExpression") == 2, name


def test_scores_are_worked_out_by_lists(spark, sf):
    """As many scores as there are pairs of different lists, whatever the pages that have them."""
    t = Tables(spark, sf)
    pages, lists = matching.Sides(t).of["p_names"]
    assert lists.count() < pages.count() and matching.Sides(t).scores("names").count() <= lists.count() ** 2
    plan = matching.entity_score(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(rs") < plan.index("array_contains"), plan  # the score lies below the making of pairs


def test_given_pairs_are_checked_without_others(spark):
    """Pairs that match, and requests that they fit, as the search over all ads finds them."""
    index = spark.createDataFrame([("keyword", "a", 1), ("keyword", "a", 2), ("keyword", "b", 1), ("entity", "x", 3), ("country", "US", 1), ("device", "tv", 2)], "dim string, key string, ad_id bigint")
    keys = spark.createDataFrame([(7, "keyword", "a"), (7, "keyword", "b"), (8, "entity", "x"), (9, "keyword", "none")], "page_id bigint, dim string, key string")
    every = spark.range(7, 10).withColumnRenamed("id", "page_id").crossJoin(spark.range(5).withColumnRenamed("id", "ad_id"))
    close = targeting.matching_pairs(every, keys, index)
    assert sorted(map(tuple, close.collect())) == sorted(map(tuple, targeting.page_matches(keys, index).collect())) == [(7, 1), (7, 2), (8, 3)]
    requests = spark.createDataFrame([(i, p, c, d) for i, (p, c, d) in enumerate((p, c, d) for p in (7, 8, 9) for c in ("US", "FR", None) for d in ("tv", "phone", None))], "request_id bigint, page_id bigint, country string, device string")
    found = targeting.fitting(requests, close, index).select("request_id", "ad_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, targeting.find_candidates(requests, keys, index).collect()))


def test_candidates_meet_by_classes(spark, sf):
    """What is met is classes: the plan joins requests and ads only where blocks of both become rows."""
    for found in (matching.candidate_match, matching.candidate_match_bitmaps):
        plan = found(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("explode(rs") < plan.index("Join"), plan


def test_truth_by_classes_is_that_of_all_pairs(spark):
    rows = [(i, [["a", "B"], ["b"], ["c", "a", "A"], [], None, ["b", None]][i % 6], [[1], [2, 3], None][i % 3], ["x", "y", None][i % 5 % 3]) for i in range(60)]
    x = spark.createDataFrame(rows, "id bigint, keywords array<string>, topics array<int>, category string")
    pages, ads = x.where("id % 2 = 0").withColumnRenamed("id", "page_id"), x.where("id % 2 = 1").withColumnRenamed("id", "ad_id")
    near = [(0, 5), (0, 5), (2, 3), (900, 901), (4, 1)]
    sets = lambda v: {y.lower() if isinstance(y, str) else y for y in v or () if y is not None}
    alike = lambda a, b, k, n: a[3] is not None and a[3] == b[3] and len(sets(a[k]) & sets(b[k])) >= n
    pairs = [(a, b) for a in rows[::2] for b in rows[1::2]]
    want = sorted((a[0], b[0]) for a, b in pairs if alike(a, b, 1, 1))
    assert want and sorted(map(tuple, evaluation.ground_truth(pages, ads, 1).collect())) == want
    want = sorted({(a[0], b[0]) for a, b in pairs if alike(a, b, 1, 2) or alike(a, b, 2, 1)} | set(near))
    found = evaluation.hybrid_truth(pages, ads, spark.createDataFrame(near, "page_id bigint, ad_id bigint"), 2)
    assert sorted(map(tuple, found.collect())) == want
    plan = evaluation.ground_truth(pages, ads, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(rs") < plan.index("Aggregate"), plan


def test_leading_rows_and_scores_in_columns(spark):
    """Each batch sends on its best rows of a group, by score and id; scores in columns are those of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = spark.range(0, 6000, 1, 2).select((F.col("id") % 3).alias("k"), F.concat(F.lit("n"), F.col("id")).alias("id"), (F.col("id") * 7 % 40 / 40).alias("score"))
        led = taxonomy.leading(rows, ["k"], 2)
        assert led.count() <= 12 * 3 * 2
        best = lambda df: sorted((k, [(-s, i) for s, i in sorted((-r.score, r.id) for r in df.collect() if r.k == k)[:2]]) for k in range(3))
        assert best(led) == best(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wide = spark.createDataFrame([("t", "a", 0.5, 0.25, None), ("t", "b", None, None, None)], "k string, id string, s0 double, s1 double, s2 double").select("*", F.lit("p").alias("parent_id"), F.lit(1).alias("tier"))
    long = wide.select("k", "id", "parent_id", "tier", F.explode(F.array("s0", "s1", "s2")).alias("score"))
    for mean in (True, False):
        got, want = taxonomy.column_scores(wide, ["s0", "s1", "s2"], mean), taxonomy.tier_scores(long, "k", mean)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
