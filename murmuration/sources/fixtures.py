"""Adapters that derive the social-post data model from the supplied tables.

The supplied tables hold no posts, handles or hashtags, so each input of the
engine is derived from them by one deterministic rule over *all* rows
(no sampling). ``fixture_sql.py`` states the same rules in SQL for the
oracle; the two are written independently and must agree.

* posts        <- events (one post per event; authors are ``User<user_id>``)
* raw_posts    <- posts  (API-shaped nested record, for full-text resolution)
* accounts     <- customer (profile lookup; nation 0 = not found,
                            nation 1 = profile without a verified flag)
* friend_ids   <- orders.o_custkey (followed-account ids, with repeats)
* previous_ids <- orders before ORDERS_CUTOFF (ids the previous run settled)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.sources.tables import read_table

# Fixed values of the fixture derivation (shared with fixture_sql.py).
RUN_CUTOFF = "2024-01-16 00:00:00"      # posts before this belong to the previous run
AS_OF = "2024-02-01 00:00:00"           # "now" for post ages
ORDERS_CUTOFF = "1995-03-01 00:00:00"   # friend list seen by the previous dictionary run
VERIFIED_MIN_BALANCE = 5000.0
NOT_FOUND_NATION = 0
NO_FLAG_NATION = 1
COMMUNITY = 5                           # "thanks" posts stay inside blocks of 5 users


def _s(c: Column) -> Column:
    return c.cast("string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, author, created_at, is_retweet, lang, text."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    # Size of the handle space: one global aggregate, as a scalar subquery.
    space = ev.agg((F.max("user_id") + F.lit(1)).alias("space")).scalar()
    e = ev.withColumn("k", F.regexp_extract("props", r"([0-9]+)", 1).cast("long"))
    a, k, u = F.col("user_id"), F.col("k"), space
    b = (a * a + F.lit(7) * k + F.lit(3)) % u
    c = (a + k * k) % u
    g = a - a % F.lit(COMMUNITY) + k % F.lit(COMMUNITY)
    et = F.col("event_type")
    text = (F.when(et == "view", F.concat(F.lit("RT @User"), _s(b), F.lit(": Great launch, love it #Launch"),
                                          _s(k % 3), F.lit(" https://t.example/"), _s(F.col("event_id"))))
             .when(et == "click", F.concat(F.lit("Hi @User"), _s(b), F.lit(" and @user"), _s(c),
                                           F.lit(" not good!! #Promo #promo"), _s(k % 5),
                                           F.lit(" http://t.example/"), _s(F.col("event_id"))))
             .when(et == "error", F.concat(F.lit("Terrible service, very bad day "), _s(k), F.lit(" #Fail")))
             .when(et == "signup", F.concat(F.lit("Thanks @User"), _s(g), F.lit(" for the happy news #Launch")))
             .when(k < 4, F.concat(F.lit("Mail me: x"), _s(k), F.lit("@shop.example buying stuff")))
             .otherwise(F.concat(F.lit("Buying stuff as @User"), _s(a))))
    return e.select(
        F.col("event_id").alias("post_id"),
        F.concat(F.lit("User"), _s(a)).alias("author"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (et == "view").alias("is_retweet"),
        F.when(k % 10 == 0, F.lit("de")).otherwise(F.lit("en")).alias("lang"),
        text.alias("text"),
    )


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-shaped posts: truncated retweet text plus the nested parts P1 needs.

    Retweets keep only 40 characters in ``full_text``; the original text sits
    in ``retweeted_status.full_text`` (missing for ``de`` posts) and the
    retweeted handle in ``entities.user_mentions[0]`` (empty in the first two
    seconds of every minute).
    """
    p = posts(spark, sf_dir)
    rt = F.col("is_retweet")
    mentions = F.transform(F.regexp_extract_all("text", F.lit(r"@(\w+)"), 1),
                           lambda h: F.struct(h.alias("screen_name")))
    empty = F.second("created_at") < 2
    return p.select(
        F.col("post_id").alias("id"),
        F.struct(F.col("author").alias("screen_name")).alias("user"),
        F.col("created_at"),
        F.col("lang"),
        F.when(rt, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("full_text"),
        F.struct(F.when(empty, F.array().cast("array<struct<screen_name:string>>"))
                 .otherwise(mentions).alias("user_mentions")).alias("entities"),
        F.when(rt & (F.col("lang") != "de"),
               F.struct(F.substring_index("text", ": ", -1).alias("full_text"))).alias("retweeted_status"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile table: account_id, screen_name, verified (nullable)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return (c.filter(F.col("c_nationkey") != NOT_FOUND_NATION)
             .select(F.col("c_custkey").alias("account_id"),
                     F.concat(F.lit("User"), _s(F.col("c_custkey"))).alias("screen_name"),
                     F.when(F.col("c_nationkey") == NO_FLAG_NATION, F.lit(None).cast("boolean"))
                      .otherwise(F.col("c_acctbal") >= VERIFIED_MIN_BALANCE).alias("verified")))


def friend_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed-account ids as the listing API returns them: repeats included."""
    return read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"))


def previous_friend_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The friend list the previous (interrupted) run had already worked through."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return (o.filter(F.col("o_orderdate") < F.lit(ORDERS_CUTOFF).cast("timestamp_ntz"))
             .select(F.col("o_custkey").alias("account_id")))


def verified_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{id: handle} of verified accounts as (account_id string, screen_name)."""
    return (accounts(spark, sf_dir).filter(F.col("verified"))
            .select(_s(F.col("account_id")).alias("account_id"), "screen_name"))


# Sentiment lexicon (token, weight, kind). Values are ours.
LEXICON_ROWS = [
    ("love", 0.5, "word"), ("great", 0.8, "word"), ("good", 0.7, "word"),
    ("happy", 0.8, "word"), ("thanks", 0.2, "word"), ("bad", -0.7, "word"),
    ("terrible", -1.0, "word"), ("not", -0.5, "negator"), ("very", 1.3, "intensifier"),
]

# English stop-word list (the common NLTK English list) plus "yes".
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours "
    "yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those "
    "am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such "
    "no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn "
    "wouldn't yes"
).split()


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON_ROWS, "token string, weight double, kind string")


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "token string")
