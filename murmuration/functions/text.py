"""Text expressions over post text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions whose behaviour results depend on.
# ``(?U)`` makes Java's \w, \d and \s Unicode-aware, as in Python.
MENTION_RE = r"(?U)@(\w+)"
HASHTAG_RE = r"(?U)#(\w+)"
URL_RE = r"(https|http)://([^\s]+)"
SENTIMENT_STRIP_RE = (r"(?U)@\w+|^rt |[^a-z| ]|(http|ftp|https)://([\w_-]+(?:(?:\.[\w_-]+)+))"
                      r"([\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-])?")
TOPIC_STRIP_RES = (r"(?U)http\S+", r"(?U)bit.ly/\S+", r"(?U)rt @\w+:", r"(?U)#\w+",
                   r"(?U)[^\w\d\s]", r"htt", r"(?U)\d+")
FEATURE_TOKEN_RE = r"(?U)\w+|\$[\d\.]+|\S+"
RETWEET_MARK = "RT @"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_full_text(full_text: Column | str, mentions: Column | str,
                      retweeted_text: Column | str) -> Column:
    """Retweets get their untruncated text back, prefixed ``RT @<first mention>: ``.

    Any missing part (no mention, no retweeted status) falls back to the
    truncated ``full_text``. ``get`` returns NULL out of range, unlike ``[0]``
    under ANSI mode.
    """
    ft = _c(full_text)
    first = F.get(_c(mentions), 0).getField("screen_name")
    rebuilt = F.concat(F.lit("RT @"), first, F.lit(": "), _c(retweeted_text))
    return F.when(ft.contains(RETWEET_MARK), F.coalesce(rebuilt, ft)).otherwise(ft)


def extract_mentions(text: Column | str) -> Column:
    """Every word after an ``@`` (e-mail domains included)."""
    return F.regexp_extract_all(_c(text), F.lit(MENTION_RE), 1)


def extract_hashtags(text: Column | str) -> Column:
    """Every word after a ``#``."""
    return F.regexp_extract_all(_c(text), F.lit(HASHTAG_RE), 1)


def mask_urls(text: Column | str) -> Column:
    """P5: replace http(s) links by the word ``URL``."""
    return F.regexp_replace(_c(text), URL_RE, "URL")


def clean_for_sentiment(text: Column | str) -> Column:
    """Drop handles, a leading ``rt ``, URLs and every char outside ``[a-z| ]``."""
    return F.regexp_replace(_c(text), SENTIMENT_STRIP_RE, "")


def clean_for_topics(text: Column | str) -> Column:
    """Lower-case, strip links/retweet marks/tags/punctuation/digits, squeeze blanks."""
    out = F.lower(_c(text))
    for pattern in TOPIC_STRIP_RES:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, r"(?U)\s\s+", " ")
    out = F.regexp_replace(out, r"\n", " ")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def tokenise(text: Column | str) -> Column:
    """Split on single spaces; an empty text gives one empty token."""
    return F.split(_c(text), " ")


def within_post_bigrams(tokens: Column | str) -> Column:
    """P9 (per post): ``tok[i]_tok[i+1]`` for consecutive tokens."""
    t = _c(tokens)
    return F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                       lambda x, i: F.concat(F.get(t, i), F.lit("_"), x))


def age_days(ts: Column | str, as_of: str) -> Column:
    """Whole days between ``ts`` and ``as_of`` (floor of 24 h units)."""
    micros = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000))


def truncate_score(x: Column | str) -> Column:
    """The reference keeps the first four characters of ``str(x)``.

    That is two decimals for x >= 0 and one for x < 0, toward zero. Going
    through DECIMAL avoids binary artefacts (0.29 * 100 = 28.999...).
    """
    d = _c(x).cast("decimal(20,10)")
    pos = F.floor(d * 100) / F.lit(100)
    neg = F.ceil(d * 10) / F.lit(10)
    return F.when(_c(x) >= 0, pos).otherwise(neg).cast("double") + F.lit(0.0)


def sentiment_label(score: Column | str) -> Column:
    """Seven English bands."""
    s = _c(score)
    # fixed values: the bands
    return (F.when(s <= -0.5, "very negative").when(s <= -0.3, "negative")
             .when(s <= -0.1, "slightly negative").when(s < 0.1, "neutral")
             .when(s < 0.3, "slightly positive").when(s < 0.5, "positive")
             .when(s >= 0.5, "very positive"))


def capitalise(c: Column | str) -> Column:
    """First character upper, rest lower (not ``initcap``)."""
    s = _c(c)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def usage_message(rank: Column | str, tag: Column | str, n: Column | str) -> Column:
    """``N. #tag used C time(s).``"""
    return F.concat(_c(rank).cast("string"), F.lit(". #"), _c(tag), F.lit(" used "),
                    _c(n).cast("string"),
                    F.when(_c(n) == 1, F.lit(" time.")).otherwise(F.lit(" times.")))
