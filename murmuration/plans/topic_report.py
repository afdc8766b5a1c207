"""Entry 2: what an account posts about, or what is posted about it.

posts by / at the account -> age filter -> top hashtags, suggested topics
(frequent words and bigrams), corpus sentiment. One filtered corpus feeds
three independent aggregations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators import posts as P
from murmuration.operators import sentiment as S
from murmuration.operators import topics as TP


@dataclass
class TopicParams:
    given_user: str = "@User7"
    search: str = "at"                 # 'by': the account's posts; 'at': posts mentioning it
    max_posts: int | None = None       # None: every matching post
    days: int = 30                     # 0 disables the age filter
    as_of: str = "2024-02-01 00:00:00"
    force_lower: bool = True
    results: int = 10
    min_df: int = 10
    max_df: float = 0.9
    remove_duplicates: bool = False


@dataclass
class TopicReport:
    corpus: DataFrame        # post_id, created_at, text
    window: DataFrame        # n_posts, oldest_created_at, oldest_age_days
    hashtags: DataFrame      # rank, tag, n, message
    topics: DataFrame        # rank, feature, df, topic
    sentiment: DataFrame     # mean, n_posts, example, sd, label


def topic_report(posts: DataFrame, lexicon: DataFrame, p: TopicParams | None = None) -> TopicReport:
    p = p or TopicParams()
    posts = P.as_posts(posts)
    if p.search == "by":
        sel = P.posts_by_account(posts, p.given_user, p.max_posts)
    elif p.search == "at":
        sel = P.posts_at_account(posts, p.given_user, p.max_posts)
    else:
        raise ValueError("search must be 'by' or 'at'")
    corpus = P.recent_posts(sel, p.days, p.as_of).select("post_id", "created_at", "text")
    order = [("created_at", True), ("post_id", True)]
    items = TP.topic_items(corpus, order)
    topics = TP.suggested_topics(TP.frequent_features(items, p.min_df, p.max_df), p.results)
    # sentiment runs on lower-cased text (the single-machine tool cleaned
    # un-lowered text, which deleted capital letters)
    lowered = corpus.select("post_id", F.lower("text").alias("text"))
    return TopicReport(
        corpus=corpus,
        window=P.corpus_window(corpus, p.as_of),
        hashtags=TP.top_hashtags(TP.hashtag_counts(corpus, p.force_lower), p.results),
        topics=topics,
        sentiment=S.sentiment_summary(lowered, lexicon, p.remove_duplicates),
    )
