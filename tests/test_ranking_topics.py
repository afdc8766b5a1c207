"""Ordering helpers, percentiles, topic items and sentiment."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from murmuration.operators import ordering as OD
from murmuration.operators import ranking as R
from murmuration.operators import sentiment as S
from murmuration.operators import topics as TP
from murmuration.sources import fixtures as fx


def test_percentile_golden(spark):
    df = spark.createDataFrame([(f"a{i}", float(s)) for i, s in enumerate([1, 2, 2, 5])], "node string, score double")
    got = sorted(r.pct for r in R.percentile_rank(df).collect())
    assert got == [25.0, 62.5, 62.5, 100.0]


def test_percentile_saved_run(spark):
    # 312 accounts, 298 below the given one and none equal: (298 + 299 + 1) * 50 / 312
    scores = [(f"a{i}", float(i)) for i in range(312)]
    df = spark.createDataFrame(scores, "node string, score double")
    got = R.percentile_rank(df).filter("node = 'a298'").first().pct
    assert got == pytest.approx(95.83333333333333, rel=1e-15)


def test_range_helpers_equal_single_window(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(50), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long, v double")
    order = [F.col("k").desc(), F.col("id").asc()]
    w = Window.orderBy(*order)
    ref = {r.id: (r.pos, r.nxt) for r in df.select("id", (F.row_number().over(w) - 1).alias("pos"),
                                                    F.lead("v").over(w).alias("nxt")).collect()}
    pos = {r.id: r.pos for r in OD.row_number0(df, order, partitions=7).collect()}
    nxt = {r.id: r.nxt for r in OD.next_in_order(df, order, "v", "nxt", partitions=7).collect()}
    assert pos == {k: v[0] for k, v in ref.items()}
    assert nxt == {k: v[1] for k, v in ref.items()}
    per = df.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    run = {r.k: r.cum for r in OD.running_total(per, [F.col("k").asc()], "c", "cum", partitions=5).collect()}
    acc, expect = 0, {}
    for k, c in sorted((r.k, r.c) for r in per.collect()):
        acc += c
        expect[k] = acc
    assert run == expect


def test_influence_report_shape(spark):
    rnd = random.Random(9)
    rows = [(f"user{i}" if i % 3 else "h" * 56 + str(i), rnd.random(), rnd.random(), rnd.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "node string, degree double, closeness double, eigenvector double")
    df = R.combined_score(df)
    rep = R.influence_report(df, "user40", gain=500.0).collect()
    sections = [r.section for r in rep]
    assert len(rep) <= 20 and sections.count("given") == 1
    assert all(len(r.node) < 56 for r in rep)
    top = [r for r in rep if r.section == "top"]
    assert len(top) in (9, 10)
    g = [r for r in rep if r.section == "given"][0]
    assert all(r.pct <= g.pct for r in rep if r.section == "tail")


def test_cross_post_bigrams_match_flattened_list(spark):
    posts = fx.posts(spark, SF_SMALL).filter("lang = 'en'")
    items = TP.topic_items(posts, [("created_at", True), ("post_id", True)])
    got = Counter((r.item, r.kind) for r in items.collect())
    # brute force: the flattened token list in newest-first order, then pairs
    rows = TP.kept_tokens(posts).orderBy(F.col("created_at").desc(), F.col("post_id").desc()).select("kept").collect()
    flat = [t for r in rows for t in r.kept]
    expect = Counter((t, "word") for t in flat)
    expect.update((flat[i] + "_" + flat[i + 1], "bigram") for i in range(len(flat) - 1))
    assert got == expect


def test_frequent_features_rule(spark):
    items = spark.createDataFrame([("a",)] * 12 + [("b",)] * 9 + [("c_d",)] * 10 + [("",)] * 2, "item string")
    got = {r.feature: r.df for r in TP.frequent_features(items).collect()}
    assert got == {"a": 12, "c_d": 10}          # b below min_df; n_docs = 33, 0.9 * 33 = 29.7


def test_polarity_negation_and_intensifier(spark):
    lex = fx.lexicon(spark)
    corpus = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good"), (4, "not very good"),
                                    (5, "nothing known"), (6, "great and bad")], "post_id long, clean string")
    got = {r.post_id: r.polarity for r in S.polarity(corpus, lex, "post_id", "clean").collect()}
    assert got[1] == pytest.approx(0.7)
    assert got[2] == pytest.approx(-0.35)
    assert got[3] == pytest.approx(0.91)
    assert got[4] == pytest.approx(-0.455)
    assert got[5] == 0.0
    assert got[6] == pytest.approx(0.05)


def test_sentiment_summary_empty_corpus(spark):
    empty = spark.createDataFrame([], "post_id long, text string")
    row = S.sentiment_summary(empty, fx.lexicon(spark)).first()
    assert row.n_posts == 0 and row.mean is None and row.example is None


def test_hashtag_substring_mode(spark):
    posts = spark.createDataFrame([(1, "#art #party #art")], "post_id long, text string")
    exact = {r.tag: r.n for r in TP.hashtag_counts(posts).collect()}
    sub = {r.tag: r.n for r in TP.hashtag_counts(posts, match="substring").collect()}
    assert exact == {"art": 2, "party": 1}
    assert sub == {"art": 3, "party": 1}


def test_substring_mode_equals_counting_in_the_list(spark):
    rnd = random.Random(11)
    tags = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    posts = spark.createDataFrame([(i, f"#{t}") for i, t in enumerate(tags)], "post_id long, text string")
    got = {r.tag: r.n for r in TP.hashtag_counts(posts, match="substring").collect()}
    assert got == {t: sum(x.count(t) for x in tags) for t in set(tags)}
    assert TP.hashtag_counts(posts.limit(0), match="substring").count() == 0


def test_substring_mode_takes_very_long_tags(spark):
    tag = "abc" * 3333 + "x"            # 10,000 characters
    posts = spark.createDataFrame([(1, f"#{tag} #abc #{tag} #bca #cabx")], "post_id long, text string")
    got = {r.tag: r.n for r in TP.hashtag_counts(posts, match="substring").collect()}
    assert got == {tag: 2, "abc": 2 * 3333 + 1, "bca": 2 * 3332 + 1, "cabx": 1}


def _random_table(spark, n=200):
    rnd = random.Random(4)
    rows = [(f"user{i}", rnd.choice([0.1, 0.2, 0.3]), rnd.choice([1e-9, 4e-10, 0.5]), rnd.random() * 1e-9) for i in range(n)]
    return rows, spark.createDataFrame(rows, "node string, degree double, closeness double, eigenvector double")


def test_account_position_counts_in_one_pass(spark):
    rows, df = _random_table(spark)
    order = [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[2], -r[3], r[0]))]
    for name in ("user0", "user77", "user199"):
        assert [tuple(r) for r in R.account_position(df, name).collect()] == [(name, order.index(name))]
    assert R.account_position(df, "nobody").collect() == []
    plan = R.account_position(df, "user0")._jdf.queryExecution().toString()
    assert "LeftOuter" not in plan     # only the given row is sent around


def test_small_scores_stay_apart(spark):
    """Scores below 1e-9 keep their order: nothing is rounded to fixed places before ranking."""
    from murmuration.operators import centrality as C
    df = spark.createDataFrame([(4.4e-11,), (4.5e-11,), (0.0,), (0.1234567890123,)], "v double")
    got = [r[0] for r in df.select(C.significant(F.col("v"), 10)).collect()]
    assert got == [4.4e-11, 4.5e-11, 0.0, 0.123456789]
    df = spark.createDataFrame([("a", 1e-10, 0.0, 0.0), ("b", 4e-10, 0.0, 0.0), ("c", 0.0, 0.0, 0.0)],
                               "node string, degree double, closeness double, eigenvector double")
    pct = {r["node"]: r["pct"] for r in R.percentile_rank(R.combined_score(df)).collect()}
    assert pct["c"] < pct["a"] < pct["b"]


def test_positions_cost_one_range_exchange(spark):
    df = spark.range(0, 2000, 1, 6).select((F.col("id") * 7919 % 2003).alias("id"))
    plan = OD.row_number0(df, [F.col("id")]).select("id", "pos")
    assert [r.pos for r in plan.orderBy("id").collect()] == list(range(2000))
    text = plan._jdf.queryExecution().executedPlan().toString()
    # the rows lie in their ranges already: what is left to move is one row per range
    assert "rangepartitioning" not in text and "hashpartitioning(id" not in text and "Window" in text
    assert OD.row_number0(df.limit(0), [F.col("id")]).collect() == []
