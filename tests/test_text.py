"""Column functions against golden values from the reference's comments and saved runs."""


from pyspark.sql import functions as F

from murmuration.functions import privacy as PV
from murmuration.functions import text as T


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_mentions_worked_example(spark):
    from murmuration.operators.graph import mention_edges
    posts = spark.createDataFrame([(1, "tomw", "hi, this is a test @test @testing")], "post_id long, author string, text string")
    rows = [(r.sender, r.receiver) for r in mention_edges(posts).orderBy("pos").collect()]
    assert rows == [("tomw", "test"), ("tomw", "testing")]


def test_mentions_email_and_unicode(spark):
    assert one(spark, T.extract_mentions, "mail x@shop.example now") == ["shop"]
    # Python's \w is Unicode; (?U) gives Java the same behaviour
    assert one(spark, T.extract_mentions, "hi @José!") == ["José"]
    assert one(spark, T.extract_hashtags, "#Launch1 and #promo_2.") == ["Launch1", "promo_2"]


def test_sentiment_cleaning(spark):
    cases = {
        "rt @bob: don't|go\nto URL https://a.b/c great": ' dont|goto   great',
        'thanks @user1 for the #happy news': 'thanks  for the happy news',
        'visit http://t.example/12 now!!': 'visit  now',
        'rt rt @x: ok': 'rt  ok',
    }
    for text, clean in cases.items():
        assert one(spark, T.clean_for_sentiment, text) == clean


def test_topic_cleaning(spark):
    cases = {
        'RT @User1: Great launch, love it #Launch2 https://t.example/2': 'great launch love it',
        'Thanks  @User3\nfor the happy news #Launch': 'thanks user for the happy news',
        'Éclair été 42 fois!': 'éclair été fois',
        '': '',
        '   ': '',
    }
    for text, clean in cases.items():
        assert one(spark, T.clean_for_topics, text) == clean


def test_truncate_score_golden(spark):
    df = spark.createDataFrame([(0.29,), (0.149,), (-0.149,), (1e-05,), (1.0,), (-0.5,)], "v double")
    got = [r[0] for r in df.select(T.truncate_score("v")).collect()]
    assert got == [0.29, 0.14, -0.1, 0.0, 1.0, -0.5]


def test_sentiment_labels(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, -0.3, -0.1, 0.0, 0.1, 0.3, 0.5)], "v double")
    got = [r[0] for r in df.select(T.sentiment_label("v")).collect()]
    assert got == ["very negative", "negative", "slightly negative", "neutral",
                   "slightly positive", "positive", "very positive"]


def test_sha224_vector_and_hidden(spark):
    h = one(spark, lambda c: PV.pseudonym(c), "abc")
    assert h == "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7"
    assert len(h) == 56
    assert one(spark, PV.is_hidden, h) is True
    assert one(spark, PV.is_hidden, "user7") is False


def test_capitalise_is_not_initcap(spark):
    assert one(spark, T.capitalise, "great launch") == "Great launch"
    assert one(spark, T.capitalise, "hELLO") == "Hello"


def test_resolve_full_text(spark):
    rows = [("RT @bob: trunc", [("bob",)], "full original"), ("RT @bob: trunc", [], "full"),
            ("RT @bob: trunc", [("bob",)], None), ("plain text", [("x",)], "ignored")]
    df = spark.createDataFrame(rows, "full_text string, m array<struct<screen_name:string>>, rt string")
    got = [r[0] for r in df.select(T.resolve_full_text("full_text", "m", "rt")).collect()]
    assert got == ["RT @bob: full original", "RT @bob: trunc", "RT @bob: trunc", "plain text"]


def test_age_days_floor(spark):
    df = spark.createDataFrame([("2024-01-31 00:00:01",), ("2024-01-30 23:59:59",)], "ts string")
    got = [r[0] for r in df.select(T.age_days(F.col("ts").cast("timestamp"), "2024-02-01 00:00:00")).collect()]
    assert got == [0, 1]


def test_usage_message(spark):
    df = spark.createDataFrame([(1, "launch", 3), (2, "fail", 1)], "r long, t string, n long")
    got = [r[0] for r in df.select(T.usage_message("r", "t", "n")).collect()]
    assert got == ["1. #launch used 3 times.", "2. #fail used 1 time."]
