"""Quality rules: a threshold table compiled into column expressions.

Every statistic is a built-in Spark expression over the whole text; the rule
table is turned into one boolean projection. No user functions.

Defined results: a null or blank text has no words and fails the base; rows
with equal ids are judged one by one; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import unused

# --- fixed values: frequent function words of the corpus languages ---
STOP_WORDS = ("the be to of and that have with "
              "der die das und zu mit sich auf ist von den "
              "le la de et les des que est une dans en pour "
              "el los del que las por con se").split()
# --- end of fixed values ---

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# (rule, numerator, denominator, least, most): a text passes when
# least <= 100 * numerator / denominator <= most; None leaves a side open.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 200, 1500),
    ("symbol_ratio", "n_symbols", "n_words", None, 10),
    ("alphabetic_words", "n_alpha_words", "n_words", 80, None),
    ("stop_words", "n_stop_words", "n_words", 2, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    ("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    ("exclamations", "n_shouts", "n_words", None, 20),
)


def words(text: Column) -> Column:
    """Runs outside ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _placed(grams: Column) -> Column:
    """Windows with their positions, sorted, so that equal ones are neighbours; empty if all differ.

    The cost of a text grows as n log n however often its windows repeat.
    """
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), pairs).otherwise(
        F.array().cast("array<struct<g:string,i:int>>"))


def _repeated(placed: Column) -> Column:
    """Number of word positions covered by windows found twice or more."""
    twin = F.filter(placed, lambda x, i: F.coalesce(F.get(placed, i - 1)["g"] == x["g"], F.lit(False))
                    | F.coalesce(F.get(placed, i + 1)["g"] == x["g"], F.lit(False)))
    at = F.transform(twin, lambda x: x["i"])
    return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2))))


def measured(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the statistics added; second: statistic -> column name."""
    taken = list(docs.columns)
    name = {}
    for s in ("t", "w", "l", "g", "placed", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
              "n_alpha_words", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines", "n_shouts"):
        name[s] = unused(f"_q_{s}", taken)
        taken.append(name[s])
    c = {k: F.col(v) for k, v in name.items()}
    size = lambda x: F.size(x).cast("long")
    df = docs.withColumn(name["t"], F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({
        name["w"]: words(c["t"]),
        name["l"]: F.filter(F.split(c["t"], "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        name["word_chars"]: F.length(F.translate(c["t"], SPACE, "")).cast("long"),
        name["n_symbols"]: (F.length(c["t"]) - F.length(F.translate(c["t"], SYMBOLS, ""))).cast("long"),
        name["n_shouts"]: F.length(c["t"]).cast("long") - F.length(F.translate(c["t"], "!", ""))})
    df = df.withColumn(name["g"], F.when(
        F.size(c["w"]) >= 3, F.transform(F.slice(c["w"], F.lit(1), F.size(c["w"]) - 2), lambda w, i: F.concat_ws(
            " ", w, F.get(c["w"], i + 1), F.get(c["w"], i + 2)))).otherwise(F.array().cast("array<string>")))
    # a column of its own: an expression inside a lambda is evaluated once per element
    df = df.withColumn(name["placed"], _placed(c["g"]))
    stats = {
        name["n_words"]: size(c["w"]),
        name["n_lines"]: size(c["l"]),
        name["n_dup_lines"]: size(c["l"]) - size(F.array_distinct(c["l"])),
        name["n_repeat_words"]: _repeated(c["placed"]).cast("long"),
        name["n_alpha_words"]: size(F.filter(c["w"], lambda w: w.rlike("\\p{L}"))),
        name["n_stop_words"]: size(F.filter(c["w"], lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))),
        name["n_ellipsis_lines"]: size(F.filter(c["l"], lambda x: x.endswith("...") | x.endswith("…"))),
        name["n_bullet_lines"]: size(F.filter(c["l"], lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•")))}
    done = ("word_chars", "n_symbols", "n_shouts")
    # a one-row generator: a filter on the statistics stays above it and reads them,
    # where the optimizer would else copy their expressions into the filter
    one = F.inline(F.array(F.struct(*[F.col(name[k]).alias(name[k]) for k in done], *[v.alias(k) for k, v in stats.items()])))
    return df.select(*[F.col(f"`{x}`") for x in docs.columns], one), name


def base_failed(c: dict[str, Column], min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (c["n_words"] < min_words) | (c["n_repeat_words"] * 100 > c["n_words"] * max_repeat_percent)


def passes(c: dict[str, Column], rules=RULES) -> Column:
    """The rule table as one expression; ratios are compared by cross-multiplied integers."""
    ok = F.lit(True)
    for _, num, den, least, most in rules:
        if least is not None:
            ok = ok & (c[num] * 100 >= c[den] * least)
        if most is not None:
            ok = ok & (c[num] * 100 <= c[den] * most)
    return ok


def assess(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` columns plus ``quality``: a struct of all statistics, ``base_failed`` and ``kept``."""
    df, name = measured(docs, text)
    c = {k: F.col(v) for k, v in name.items()}
    stats = [k for k in name if k.startswith("n_") or k == "word_chars"]
    failed = base_failed(c)
    out = unused("quality", docs.columns)
    return df.select(*[F.col(f"`{x}`") for x in docs.columns], F.struct(
        *[c[k].alias(k) for k in stats], failed.alias("base_failed"), (~failed & passes(c, rules)).alias("kept")).alias(out))


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Rows of ``docs`` that pass the base and every rule, columns unchanged."""
    df, name = measured(docs, text)
    c = {k: F.col(v) for k, v in name.items()}
    return df.filter(~base_failed(c) & passes(c, rules)).select(*[F.col(f"`{x}`") for x in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    """Contract columns of the quality rules for every row of ``documents``."""
    rows = assess(docs.select("doc_id", "text"))
    keep = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "n_lines", "n_alpha_words", "n_stop_words")
    return rows.select("doc_id", *[F.col(f"quality.{k}").alias(k) for k in keep])


def _rules_sql(rules=RULES) -> str:
    parts = []
    for _, num, den, least, most in rules:
        parts += [f"{num} * 100 >= {den} * {least}"] * (least is not None) + [f"{num} * 100 <= {den} * {most}"] * (most is not None)
    return " AND ".join(parts)


OP3_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(replace(t, '!', '')) AS n_shouts FROM t),
g AS (SELECT *, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, greatest(len(w) - 1, 1))] AS g, row_number() OVER () AS rid FROM s),
e AS (SELECT rid, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM g),
r AS (SELECT rid, i FROM e QUALIFY count(*) OVER (PARTITION BY rid, gram) >= 2),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, word_chars, n_symbols, n_shouts, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
    len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS n_ellipsis_lines,
    len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, chr(8226)))) AS n_bullet_lines
  FROM g LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql()} AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_alpha_words AS BIGINT) AS n_alpha_words,
  CAST(n_stop_words AS BIGINT) AS n_stop_words
FROM b
"""
