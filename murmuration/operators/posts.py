"""Post selection: searches, filters, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions import text as T


def _cap(df: DataFrame, max_posts: int | None) -> DataFrame:
    """The latest ``max_posts`` (newest first, ties by id); None = all."""
    if max_posts is None:
        return df
    return df.orderBy(F.col("created_at").desc(), F.col("post_id").desc()).limit(max_posts)


def as_posts(posts: DataFrame) -> DataFrame:
    """P1 for a whole table: API-shaped records (id, user, created_at, lang, full_text,
    entities, retweeted_status) become posts with their full text; posts stay as they are."""
    if "full_text" not in posts.columns:
        return posts
    return posts.select(F.col("id").alias("post_id"), F.col("user.screen_name").alias("author"), "created_at",
                        F.col("full_text").contains(T.RETWEET_MARK).alias("is_retweet"), "lang",
                        T.resolve_full_text("full_text", "entities.user_mentions", "retweeted_status.full_text").alias("text"))


def topic_filter(posts: DataFrame, query: str) -> DataFrame:
    """case-insensitive literal substring match."""
    return posts.filter(F.lower("text").contains(query.lower()))


def language_filter(posts: DataFrame, lang: str = "en") -> DataFrame:
    """F2."""
    return posts.filter(F.col("lang") == lang)


def exclude_retweets(posts: DataFrame) -> DataFrame:
    """drop texts with the case-sensitive ``RT @`` mark."""
    return posts.filter(~F.col("text").contains(T.RETWEET_MARK))


def topic_posts(posts: DataFrame, query: str, allow_retweets: bool = True,
                max_posts: int | None = None, lang: str = "en") -> DataFrame:
    """Posts on a topic, one language, optionally without retweets."""
    out = language_filter(topic_filter(posts, query), lang)
    if not allow_retweets:
        out = exclude_retweets(out)
    return _cap(out, max_posts)


def posts_by_account(posts: DataFrame, user: str, max_posts: int | None = None) -> DataFrame:
    """Posts written by an account."""
    return _cap(posts.filter(F.lower("author") == user.lstrip("@").lower()), max_posts)


def posts_at_account(posts: DataFrame, user: str, max_posts: int | None = None,
                     lang: str = "en") -> DataFrame:
    """S3: posts that mention an account (a leading ``@`` in ``user`` is ignored)."""
    handle = user.lstrip("@").lower()
    mentioned = F.array_contains(T.extract_mentions(F.lower("text")), handle)
    return _cap(language_filter(posts, lang).filter(mentioned), max_posts)


def mentions_on_topic(posts: DataFrame, user: str, query: str, max_posts: int | None = None,
                      lang: str = "en") -> DataFrame:
    """Posts containing both the account and the topic, case-insensitively."""
    low = F.lower("text")
    return _cap(language_filter(posts, lang)
                .filter(low.contains(user.lower()) & low.contains(query.lower())), max_posts)


def oldest_post_id(posts: DataFrame) -> DataFrame:
    """One row, the smallest id of a search (NULL when empty)."""
    return posts.agg(F.min("post_id").alias("oldest_post_id"))


def newer_than_oldest(candidates: DataFrame, search: DataFrame) -> DataFrame:
    """keep candidates strictly newer (by id) than the oldest search post."""
    oldest = oldest_post_id(search)
    return (candidates.crossJoin(F.broadcast(oldest))   # one row
            .filter(F.col("post_id") > F.col("oldest_post_id")).drop("oldest_post_id"))


def new_posts(candidates: DataFrame, search: DataFrame) -> DataFrame:
    """Candidates whose id is not already in the search."""
    return candidates.join(search.select("post_id"), "post_id", "left_anti")


def enrich_with_timeline(posts: DataFrame, query: str, user: str, include_mentions: bool = False,
                         allow_retweets: bool = True, max_posts: int | None = None) -> DataFrame:
    """Topic search plus the account's own (and optionally mentioning) posts.

    Added posts must be newer than the oldest search post, not already in the
    search, optionally not retweets, and on topic.
    """
    search = topic_posts(posts, query, allow_retweets, max_posts)
    extra = posts_by_account(posts, user, max_posts)
    if include_mentions:
        extra = extra.unionByName(mentions_on_topic(posts, user, query, max_posts))
    extra = new_posts(newer_than_oldest(extra, search), search)
    if not allow_retweets:
        extra = exclude_retweets(extra)
    extra = topic_filter(extra, query)
    return search.unionByName(extra).dropDuplicates(["post_id"])


def recent_posts(posts: DataFrame, days: int, as_of: str) -> DataFrame:
    """posts at most ``days`` whole days old; 0 disables the filter."""
    if days == 0:
        return posts
    return posts.filter(T.age_days("created_at", as_of) <= days)


def corpus_window(posts: DataFrame, as_of: str) -> DataFrame:
    """Size, oldest timestamp and its age; zero rows in -> n_posts 0, NULLs."""
    return posts.agg(F.count(F.lit(1)).alias("n_posts"),
                     F.min("created_at").alias("oldest"),
                     ).select("n_posts",
                              F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("oldest_created_at"),
                              T.age_days(F.col("oldest"), as_of).cast("long").alias("oldest_age_days"))
