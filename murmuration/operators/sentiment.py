"""Corpus sentiment.

Polarity is a lexicon join (re-aimed from a per-row library call): the
cleaned text's words are exploded with their position, joined with a
(token, weight, kind) lexicon, and averaged per post. A word right after
an intensifier is scaled by it (clamped to [-1, 1]); a negator right before
(or before the intensifier) multiplies by -0.5. Posts without a known word
score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions import text as T
from murmuration.session import cut_lineage

NEGATION = -0.5


def _lex(lexicon: DataFrame, kind: str, prefix: str) -> DataFrame:
    """One kind of lexicon entries; the planner broadcasts it when its size allows."""
    return lexicon.filter(F.col("kind") == kind).select(
        F.col("token").alias(f"{prefix}_tok"), F.col("weight").alias(f"{prefix}_w"))


def polarity(corpus: DataFrame, lexicon: DataFrame, id_col: str = "post_id",
             text_col: str = "clean") -> DataFrame:
    """(id, polarity) for every row of ``corpus``."""
    words = corpus.select(id_col, F.regexp_extract_all(F.col(text_col), F.lit("[a-z]+"), 0).alias("_t"))
    tok = words.select(id_col, "_t", F.posexplode("_t").alias("_p", "tok"))
    tok = tok.select(id_col, "tok", F.get("_t", F.col("_p") - 1).alias("prev1"),
                     F.get("_t", F.col("_p") - 2).alias("prev2"))
    scored = (tok.join(_lex(lexicon, "word", "w"), F.col("tok") == F.col("w_tok"))
                 .join(_lex(lexicon, "intensifier", "i"), F.col("prev1") == F.col("i_tok"), "left")
                 .join(_lex(lexicon, "negator", "n1"), F.col("prev1") == F.col("n1_tok"), "left")
                 .join(_lex(lexicon, "negator", "n2"), F.col("prev2") == F.col("n2_tok"), "left"))
    boosted = F.col("w_w") * F.coalesce(F.col("i_w"), F.lit(1.0))
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), boosted))
    negated = F.col("n1_tok").isNotNull() | (F.col("i_tok").isNotNull() & F.col("n2_tok").isNotNull())
    score = clamped * F.when(negated, F.lit(NEGATION)).otherwise(F.lit(1.0))
    per_post = scored.groupBy(id_col).agg(F.avg(score).alias("_pol"))
    return (corpus.select(id_col).join(per_post, id_col, "left")
                  .select(id_col, F.coalesce(F.col("_pol"), F.lit(0.0)).alias("polarity")))


def distinct_posts(corpus: DataFrame, text_col: str = "text", id_col: str = "post_id") -> DataFrame:
    """One row per URL-masked text (across authors); keeps the smallest id."""
    masked = corpus.select(id_col, T.mask_urls(F.col(text_col)).alias(text_col))
    return masked.groupBy(text_col).agg(F.min(id_col).alias(id_col)).select(id_col, text_col)


def scored_corpus(corpus: DataFrame, lexicon: DataFrame, remove_duplicates: bool = True,
                  text_col: str = "text", id_col: str = "post_id") -> DataFrame:
    """(post_id, text, polarity) after optional de-duplication and P6 cleaning."""
    c = corpus.select(id_col, text_col)
    if remove_duplicates:
        c = distinct_posts(c, text_col, id_col)
    # cleaned once: the tokens and the join back both read this copy
    c = cut_lineage(c.withColumn("clean", T.clean_for_sentiment(F.col(text_col))))
    return c.join(polarity(c, lexicon, id_col, "clean"), id_col).select(id_col, text_col, "polarity")


def sentiment_summary(corpus: DataFrame, lexicon: DataFrame, remove_duplicates: bool = True,
                      text_col: str = "text", id_col: str = "post_id") -> DataFrame:
    """A10: one row (mean, n_posts, example, sd, label).

    mean = truncated average polarity (A8, P13); sd = population deviation
    around the *truncated* mean, truncated (A9); example = the post closest
    to that mean, ties by text then id (L4); label from the mean (P12).
    """
    # two passes (the spread needs the truncated mean): score the corpus once
    s = cut_lineage(scored_corpus(corpus, lexicon, remove_duplicates, text_col, id_col))
    mean = s.agg(T.truncate_score(F.avg("polarity")).alias("mean"), F.count(F.lit(1)).alias("n_posts"))
    dev = F.abs(F.col("polarity") - F.col("mean"))
    spread = (s.crossJoin(F.broadcast(mean))
               .groupBy("mean", "n_posts")
               .agg(T.truncate_score(F.sqrt(F.avg(dev * dev))).alias("sd"),
                    F.min(F.struct(dev.alias("d"), F.col(text_col).alias("t"), F.col(id_col).alias("i"))).alias("best")))
    return (mean.join(spread, ["mean", "n_posts"], "left")
                .select("mean", F.col("n_posts").cast("long").alias("n_posts"),
                        F.col("best.t").alias("example"), "sd",
                        T.sentiment_label(F.col("mean")).alias("label")))


def mention_corpus(corpus: DataFrame, user: str, mode: str = "substring", text_col: str = "text") -> DataFrame:
    """posts about an account. ``substring`` keeps the reference's test
    (``@user`` followed by a space); ``token`` matches the handle exactly."""
    u = user.lower()
    if mode == "substring":
        return corpus.filter(F.col(text_col).contains(f"@{u} "))
    return corpus.filter(F.array_contains(T.extract_mentions(F.col(text_col)), u))
