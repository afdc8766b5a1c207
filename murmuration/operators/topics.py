"""Hashtags, frequent words and bigrams, topic models."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions import text as T
from murmuration.operators.ordering import next_in_order, row_number0
from murmuration.operators.skew import BROADCAST_ROWS, sized
from murmuration.session import cut_lineage, release
from murmuration.sources.fixtures import STOP_WORDS


# ---------------------------------------------------------------- hashtags

def hashtag_counts(posts: DataFrame, force_lower: bool = True, match: str = "exact",
                   text_col: str = "text") -> DataFrame:
    """A1: (tag, n). ``exact`` counts each tag; ``substring`` reproduces the
    reference's count of a tag inside every tag occurrence (``art`` also in
    ``party``), see ``substring_hits``."""
    txt = F.lower(F.col(text_col)) if force_lower else F.col(text_col)
    tags = posts.select(F.explode(T.extract_hashtags(txt)).alias("tag"))
    exact = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    if match == "exact":
        return exact
    if match != "substring":
        raise ValueError(match)
    hits = substring_hits(exact.select("tag")).join(exact, "tag")
    return hits.groupBy(F.col("sub").alias("tag")).agg(F.sum(F.col("n") * F.col("occurrences")).cast("long").alias("n"))


def substring_hits(tags: DataFrame) -> DataFrame:
    """(tag, sub, occurrences): which of the distinct ``tags`` lie inside which, and how often without overlap.

    Substrings are taken only at the lengths that some tag has, and leave
    their task as 8-byte hashes; tags that meet are confirmed on their text.
    A tag of n characters makes at most n hashes a length, never its n^2
    substrings, and its text moves once per hit only.
    """
    own = cut_lineage(tags.select("tag", F.length("tag").alias("len"), F.xxhash64("tag").alias("h")))
    # one row: the distinct lengths, of which k need tags of k^2 / 2 characters in all
    lengths = own.agg(F.sort_array(F.collect_set("len")).alias("lengths"))
    at = own.crossJoin(F.broadcast(lengths)).select("tag", "len", F.explode(F.filter("lengths", lambda k: k <= F.col("len"))).alias("k"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("len") - F.col("k") + 1), lambda i: F.xxhash64(F.substring("tag", i, F.col("k")))))
    inside = at.select(F.md5("tag").alias("whole"), "k", F.explode(parts).alias("h"))
    named = own.select("tag", F.md5("tag").alias("whole"))
    met = inside.join(own.select(F.col("tag").alias("sub"), F.col("len").alias("k"), "h"), ["k", "h"]).select("whole", "sub")
    occurrences = (F.length("tag") - F.length(F.replace(F.col("tag"), F.col("sub"), F.lit("")))) / F.length("sub")
    return (met.join(named, "whole").select("tag", "sub", occurrences.cast("long").alias("occurrences"))
               .filter(F.col("occurrences") > 0))


def top_hashtags(counts: DataFrame, k: int = 10) -> DataFrame:
    """Rank, tag, n, message for the k most used tags (ties by tag)."""
    top = counts.orderBy(F.col("n").desc(), F.col("tag")).limit(k)
    from pyspark.sql import Window  # bounded: at most k rows
    ranked = top.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("tag")))).cast("long"))
    return ranked.select("rank", "tag", F.col("n").cast("long").alias("n"),
                         T.usage_message(F.col("rank"), F.col("tag"), F.col("n")).alias("message"))


# ---------------------------------------------------------------- words and bigrams

def spread(corpus: DataFrame, doc_id: str | None = None) -> DataFrame:
    """``corpus`` dealt over all tasks, by ``doc_id`` if given: a file of few row groups is read by as few, and cleaning costs far more than reading."""
    return corpus.repartition(F.col(doc_id) if doc_id else F.xxhash64(*corpus.columns))


def kept_tokens(corpus: DataFrame, text_col: str = "text",
                stop_words: list[str] | tuple[str, ...] = tuple(STOP_WORDS)) -> DataFrame:
    """P7 + P8 + J12: cleaned tokens of each post minus stop words, as an array.

    The stop list is a fixed value list, so the test is an ``IN`` over
    literals inside the projection, which the optimizer turns into a hash-set
    lookup (``InSet``): no join and no shuffle.
    """
    toks = T.tokenise(T.clean_for_topics(F.col(text_col)))
    words = list(stop_words)
    return corpus.withColumn("kept", F.filter(toks, lambda t: ~t.isin(*words)))


def topic_items(corpus: DataFrame, order: list[tuple[str, bool]], text_col: str = "text",
                cross_posts: bool = True, stop_words=tuple(STOP_WORDS)) -> DataFrame:
    """U4: the word list followed by its bigrams, one row per item (item, kind).

    Bigrams pair consecutive kept words (P9). With ``cross_posts`` the corpus
    is one flattened list as in the reference, so the last word of a post
    also pairs with the first word of the next non-empty post in ``order``,
    a list of (column, descending) that identifies each post uniquely.
    """
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    k = kept_tokens(corpus, text_col, stop_words)
    if cross_posts:
        # freeze the cleaned tokens once: both the items and the post ends read them
        k = cut_lineage(k.select(*[c for c, _ in order], "kept"))
    # one generator emits the words and the in-post bigrams of a post
    tagged = F.concat(F.transform("kept", lambda w: F.struct(w.alias("item"), F.lit("word").alias("kind"))),
                      F.transform(T.within_post_bigrams(F.col("kept")),
                                  lambda b: F.struct(b.alias("item"), F.lit("bigram").alias("kind"))))
    items = k.select(F.explode(tagged).alias("it")).select("it.item", "it.kind")
    if cross_posts:
        ends = (k.filter(F.size("kept") > 0)
                 .select(*[c for c, _ in order], F.get("kept", 0).alias("first"),
                         F.element_at("kept", -1).alias("last")))
        linked = next_in_order(ends, keys, "first", "next_first")
        cross = linked.filter(F.col("next_first").isNotNull()).select(
            F.concat(F.col("last"), F.lit("_"), F.col("next_first")).alias("item"), F.lit("bigram").alias("kind"))
        items = items.unionByName(cross)
    return items


def token_frequency(items: DataFrame) -> DataFrame:
    """A12/F14 input: (feature, df) where df = number of items containing it.

    Each list item is its own document, so the document frequency of a
    feature is its occurrence count; items are split with the vectoriser's
    token pattern exactly as the reference's vectoriser does. Items are
    counted first (partial aggregation before the shuffle), so the pattern
    runs once per distinct item, not once per occurrence.
    """
    return _features(_per_item(items))


def _per_item(items: DataFrame) -> DataFrame:
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("_k"))


def _features(per_item: DataFrame) -> DataFrame:
    feats = per_item.select(F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("item"), F.lit(T.FEATURE_TOKEN_RE), 0))).alias("feature"), "_k")
    return feats.groupBy("feature").agg(F.sum("_k").alias("df"))


def frequent_features(items: DataFrame, min_df: int = 10, max_df: float = 0.9) -> DataFrame:
    """features with min_df <= df <= max_df * (number of items)."""
    per_item = _per_item(items)
    n_docs = per_item.agg(F.sum("_k").alias("n_docs"))   # the counted items again: one exchange, read twice
    return (_features(per_item).crossJoin(F.broadcast(n_docs))
            .filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
            .select("feature", F.col("df").cast("long").alias("df")))


def suggested_topics(features: DataFrame, k: int = 10, order: str = "alphabetical") -> DataFrame:
    """The first k features alphabetically (the vectoriser's feature order),
    or by frequency; capitalised for display (P21)."""
    from pyspark.sql import Window  # bounded: at most k rows
    keys = [F.col("feature")] if order == "alphabetical" else [F.col("df").desc(), F.col("feature")]
    top = features.orderBy(*keys).limit(k)
    return top.select((F.row_number().over(Window.orderBy(*keys))).cast("long").alias("rank"), "feature", "df",
                      T.capitalise(F.col("feature")).alias("topic"))


# ---------------------------------------------------------------- topic model

# The asymptotic series of the digamma function, used from x + 6 on.
_DIGAMMA_SHIFT = 6
DIGAMMA_SQL = ("(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * power({x} + 6, 2)) + 1 / (120 * power({x} + 6, 4)) "
               "- 1 / (252 * power({x} + 6, 6)) - " + " - ".join(f"1 / ({{x}} + {i})" for i in range(_DIGAMMA_SHIFT)) + ")")


def digamma(x: str) -> str:
    """SQL text of digamma(x) for a positive double column ``x`` (error below 1e-8)."""
    return DIGAMMA_SQL.format(x=x)


def document_terms(corpus: DataFrame, doc_id: str, text_col: str = "text", min_df: int = 10, max_df: float = 0.9) -> DataFrame:
    """F14 over whole documents: (doc, word, n) for words with min_df <= df <= max_df * documents.

    Repeated rows of one id are one document. Kept words only (P7, P8, J12).
    """
    return _frequent(cut_lineage(_pairs(corpus, doc_id, text_col)), min_df, max_df)


def _pairs(corpus: DataFrame, doc_id: str, text_col: str) -> DataFrame:
    """(doc, word, n) of every word; a corpus dealt by document is counted where it lies."""
    kept = kept_tokens(corpus, text_col).select(F.col(doc_id).alias("doc"), F.explode("kept").alias("word")).filter("word <> ''")
    return kept.groupBy("doc", "word").agg(F.count(F.lit(1)).cast("int").alias("n"))


def _frequent(pairs: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """The stored ``pairs`` of words within the bounds; few such words go to the pairs, which stay where they are."""
    docs = pairs.select("doc").distinct().agg(F.count(F.lit(1)).alias("n_docs"))     # one row
    words = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs))
    frequent = words.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs"))).select("word")
    return pairs.join(sized(cut_lineage(frequent)), "word")


PAIRS_PER_PARTITION = 250_000


def fit_topics(terms: DataFrame, k: int = 3, steps: int = 10, inner: int = 2, stored: DataFrame | None = None) -> DataFrame:
    """M1: variational LDA over all of ``terms`` (doc, word, n): one row per word with its pseudo-counts l0, l1, ...

    Priors are 1/k as in the usual batch implementation; the start is a hash
    of (word, topic). The pairs, with numbers for words, are moved once, to
    their documents, and kept there on disk, sorted by document. ``terms`` made
    from ``stored`` (on disk by document, and dropped from it when the numbered
    pairs are) do not move at all if there are few words. A step reads every pair once: it
    meets its word's weights (broadcast up to a counted number of words, else
    joined), the documents' topic mixtures are refined ``inner`` times by sums
    over the document where its pairs lie, and partially aggregated sums by
    word give the next weights. Between steps only the word table is stored,
    so nothing grows on the driver.
    """
    topics, prior = range(k), 1.0 / k
    numbered = cut_lineage(row_number0(terms.select("word").distinct(), [F.col("word")], "wid"))
    few = numbered.count() <= BROADCAST_ROWS
    if few:
        numbered = numbered.withColumn("wid", F.col("wid").cast("int"))
    own = terms.join(F.broadcast(numbered) if few else numbered, "word").select("doc", F.col("wid").alias("word"), "n")
    if stored is None or not few:
        parts = max(terms.sparkSession.sparkContext.defaultParallelism, 1 + terms.count() // PAIRS_PER_PARTITION)
        own = own.repartition(parts, "doc")
    own = own.sortWithinPartitions("doc").persist(StorageLevel.DISK_ONLY)
    try:
        own.count()     # once stored, plans know that a document's pairs lie together
        if stored is not None:
            stored.unpersist()
        weights = _steps(own, numbered, topics, prior, steps, inner)
    finally:
        own.unpersist()
    return numbered.join(weights.withColumnRenamed("word", "wid"), "wid").drop("wid")


def _steps(pairs: DataFrame, numbered: DataFrame, topics: range, prior: float, steps: int, inner: int) -> DataFrame:
    """The word weights after ``steps`` steps, by word number."""
    start = [(F.lit(1.0) + F.conv(F.substring(F.md5(F.concat(F.col("word"), F.lit(f"#{t}"))), 1, 8), 16, 10).cast("double")
              / F.lit(4294967296.0)).alias(f"l{t}") for t in topics]
    weights = cut_lineage(numbered.select(F.col("wid").alias("word"), *start))
    few = weights.count() <= BROADCAST_ROWS
    for _ in range(steps):
        totals = weights.agg(*[F.sum(f"l{t}").alias(f"s{t}") for t in topics])       # one row
        b = weights.crossJoin(F.broadcast(totals)).select(
            "word", *[F.expr(f"exp({digamma(f'l{t}')} - {digamma(f's{t}')})").alias(f"b{t}") for t in topics])
        rows = pairs.join(F.broadcast(b) if few else b, "word")
        share = [F.col(f"b{t}") for t in topics]
        for _ in range(inner):
            rows = _mixtures(rows, share, prior)
            share = [F.expr(f"exp({digamma(f'g{t}')})") * F.col(f"b{t}") for t in topics]
        rows = _shares(rows, share)
        release(pairs.sparkSession)     # of the step before
        weights = cut_lineage(rows.groupBy("word").agg(*[(F.lit(prior) + F.sum(F.col("n") * F.col(f"p{t}"))).alias(f"l{t}") for t in topics]))
    return weights


def _shares(rows: DataFrame, share: list) -> DataFrame:
    """``p0..``: the normalised shares of each pair."""
    own = rows.withColumns({f"e{t}": x for t, x in enumerate(share)})
    total = sum((F.col(f"e{t}") for t in range(1, len(share))), F.col("e0"))
    return own.withColumns({f"p{t}": F.col(f"e{t}") / total for t in range(len(share))})


def _mixtures(rows: DataFrame, share: list, prior: float) -> DataFrame:
    """``g0..``: topic pseudo-counts of each pair's document under ``share``."""
    from pyspark.sql import Window
    doc = Window.partitionBy("doc")
    shared = _shares(rows, share)
    return shared.select("doc", "word", "n", *[f"b{t}" for t in range(len(share))],
                         *[(F.lit(prior) + F.sum(F.col("n") * F.col(f"p{t}")).over(doc)).alias(f"g{t}") for t in range(len(share))])


def lda_topics(corpus: DataFrame, doc_id: str, text_col: str = "text", k: int = 3, top_words: int = 5,
               steps: int = 10, min_df: int = 10, max_df: float = 0.9) -> DataFrame:
    """M1: the ``top_words`` words of each of ``k`` topics: (topic, rank, word, weight), ties by word.

    An empty vocabulary (too few documents) gives no rows.
    """
    pairs = _pairs(corpus, doc_id, text_col).persist(StorageLevel.DISK_ONLY)
    try:
        pairs.count()
        weights = fit_topics(_frequent(pairs, min_df, max_df), k, steps, stored=pairs)
    finally:
        pairs.unpersist()
    totals = weights.agg(*[F.sum(f"l{t}").alias(f"s{t}") for t in range(k)])
    scored = weights.crossJoin(F.broadcast(totals)).select("word", *[F.round(F.col(f"l{t}") / F.col(f"s{t}"), 6).alias(f"w{t}") for t in range(k)])
    out = None
    from pyspark.sql import Window  # bounded: top_words rows
    for t in range(k):
        order = [F.col(f"w{t}").desc(), F.col("word")]
        top = scored.select("word", f"w{t}").orderBy(*order).limit(top_words)
        top = top.select(F.lit(t).cast("long").alias("topic"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("rank"),
                         "word", F.col(f"w{t}").alias("weight"))
        out = top if out is None else out.unionByName(top)
    return out
