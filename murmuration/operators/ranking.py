"""Percentile ranks and the influence report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions.privacy import is_hidden, uniform_hash
from murmuration.operators.ordering import row_number0, running_total
from murmuration.session import cut_lineage

RANK_ORDER = ("degree", "closeness", "eigenvector")


def combined_score(table: DataFrame, score: str = "sum") -> DataFrame:
    """The reference's missing ``Combined_cent``: degree + closeness + eigenvector
    (``sum``) or the eigenvector alone (``eigenvector``); never rounded to
    fixed places, which would tie the small scores of a large graph."""
    if score == "sum":
        expr = F.col("degree") + F.col("closeness") + F.col("eigenvector")
    elif score == "eigenvector":
        expr = F.col("eigenvector")
    else:
        raise ValueError(score)
    return table.withColumn("score", expr)


def rank_order(handle: str = "node") -> list[Column]:
    """L1: degree, closeness, eigenvector descending; handle breaks ties."""
    return [F.col(c).desc() for c in RANK_ORDER] + [F.col(handle).asc()]


def percentile_rank(df: DataFrame, score: str = "score", name: str = "pct") -> DataFrame:
    """SciPy ``percentileofscore(kind='rank')`` of every row within ``df``.

    For a present value: (#less + #less_or_equal + 1) * 50 / n. Scores are
    grouped first, so the running count runs over distinct values only and
    range by range (no single-task window).
    """
    per_value = df.groupBy(score).agg(F.count(F.lit(1)).alias("_k"))
    cum = running_total(per_value, [F.col(score).asc()], "_k", "_le")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    pct = ((F.col("_le") - F.col("_k")) + F.col("_le") + F.lit(1)) * F.lit(50.0) / F.col("_n")
    values = cum.crossJoin(F.broadcast(total)).select(score, pct.alias(name))
    return df.join(values, score)


def _given(table: DataFrame, given: str, handle: str, *extra: Column) -> DataFrame:
    """The given account's row as g_* columns: one row at most, safe to broadcast."""
    return table.filter(F.col(handle) == given).select(*extra, *[F.col(c).alias(f"g_{c}") for c in RANK_ORDER + (handle,)]).limit(1)


def _ranked_before(handle: str) -> Column:
    """Is a row ahead of the given account (g_* columns) in rank order?"""
    keys = RANK_ORDER + (handle,)
    before = F.lit(False)
    for c in reversed(keys):
        ahead = F.col(c) < F.col(f"g_{c}") if c == handle else F.col(c) > F.col(f"g_{c}")
        before = ahead | ((F.col(c) == F.col(f"g_{c}")) & before)
    return before


def account_position(table: DataFrame, given: str, handle: str = "node") -> DataFrame:
    """0-based position of the given account in rank order (one row, NULL if absent)."""
    return (table.crossJoin(F.broadcast(_given(table, given, handle)))
                 .groupBy(F.col(f"g_{handle}").alias("_g"))
                 .agg(F.count_if(_ranked_before(handle)).cast("long").alias("position"))
                 .withColumnRenamed("_g", handle).select(handle, "position"))


def sequential_ids(nodes: DataFrame, given: str, handle: str = "node") -> DataFrame:
    """0-based ids in handle order with the given account last."""
    keyed = nodes.withColumn("_is_given", F.col(handle) == given)
    return row_number0(keyed, [F.col("_is_given").asc(), F.col(handle).asc()], "id").drop("_is_given")


def influence_report(table: DataFrame, given: str, gain: float = 500.0, seed: str = "123456789",
                     handle: str = "node", top: int = 10, total: int = 20) -> DataFrame:
    """The account-level report as rows (section, pct, score, handle).

    Top block: the first visible accounts in rank order (9 of them when the
    given account is among the first 10 printed, else 10). Then the given
    account. Tail: visible, not shown, percentile <= the given account's,
    kept with probability gain / pct_given^2 (a reproducible hash draw), in
    rank order, until ``total`` rows. Pseudonymised handles never appear.
    """
    order = rank_order(handle)
    ranked = percentile_rank(table, "score", "pct").withColumn("visible", ~is_hidden(F.col(handle)) & (F.col(handle) != given))
    ranked = cut_lineage(ranked)
    vis = ranked.filter("visible")
    # number of visible accounts ranked before the given one: one pass, then one row
    g_info = cut_lineage(
        ranked.crossJoin(F.broadcast(_given(ranked, given, handle, F.col("pct").alias("g_pct"))))
              .groupBy("g_pct").agg(F.count_if(F.col("visible") & _ranked_before(handle)).alias("g_before")))
    n_top = F.when(F.col("g_before") <= top - 1, F.lit(top - 1)).otherwise(F.lit(top))
    # the first `top` visible rows, distributed top-k
    top_rows = vis.orderBy(*order).limit(top)
    # at most `top` rows: a window over them is bounded
    top_rows = top_rows.withColumn("k", F.row_number().over(Window.orderBy(*order)) - 1)
    top_block = (top_rows.crossJoin(F.broadcast(g_info)).filter(F.col("k") < n_top)
                 .select(F.lit("top").alias("section"), "pct", "score", handle, *RANK_ORDER))
    given_row = ranked.filter(F.col(handle) == given).select(F.lit("given").alias("section"), "pct", "score", handle, *RANK_ORDER)
    threshold = F.lit(gain) / (F.col("g_pct") * F.col("g_pct"))
    tail_cand = (vis.crossJoin(F.broadcast(g_info))
                    .join(top_block.select(handle), handle, "left_anti")
                    .filter((F.col("pct") <= F.col("g_pct")) & (uniform_hash(seed, F.col(handle)) < threshold)))
    shown = top_block.agg(F.count(F.lit(1)).alias("n_shown"))
    tail_sorted = tail_cand.orderBy(*order).limit(total - top + 1)   # never more than 11 needed
    tail_sorted = tail_sorted.withColumn("k", F.row_number().over(Window.orderBy(*order)) - 1)
    tail = (tail_sorted.crossJoin(F.broadcast(shown)).filter(F.col("k") < F.lit(total - 1) - F.col("n_shown"))
            .select(F.lit("tail").alias("section"), "pct", "score", handle, *RANK_ORDER))
    return top_block.unionByName(given_row).unionByName(tail)
