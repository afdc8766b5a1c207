"""Global order statistics without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row into one task.
These helpers move the rows once, by ranges of the order key (balanced by
sampling), sort each range where it lies and number its rows in place. Sums and
followers inside a range are windows over the range's number (one more
exchange), and only one row per range partition ever meets in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.session import cut_lineage

_IN_RANGE = 33    # lower bits of a row's number: its place in its range


def _ranged(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """``df``, stored, in ranges of ``order``: ``_rp`` numbers the ranges and ``_local`` the rows of each, from 0.

    The only exchange is the one that makes the ranges: rows are sorted and
    numbered in their partition.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    at = ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # stored: every use sees the same ranges
    own = cut_lineage(at)
    return own.withColumns({"_rp": F.shiftright("_at", _IN_RANGE), "_local": F.col("_at").bitwiseAND(F.lit((1 << _IN_RANGE) - 1))}).drop("_at")


def _offsets(ranged: DataFrame, value: Column) -> DataFrame:
    per_range = ranged.groupBy("_rp").agg(F.sum(value).alias("_range_total"))
    before = Window.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition: bounded by the partition count.
    return per_range.select("_rp", F.coalesce(F.sum("_range_total").over(before), F.lit(0)).cast("long").alias("_offset"))


def row_number0(df: DataFrame, order: list[Column], name: str = "pos",
                partitions: int | None = None) -> DataFrame:
    """0-based position of every row in ``order`` (which must break all ties)."""
    ranged = _ranged(df, order, partitions)
    return (ranged.join(F.broadcast(_offsets(ranged, F.lit(1))), "_rp")
                  .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
                  .drop("_rp", "_local", "_offset"))


def running_total(df: DataFrame, order: list[Column], value: str, name: str,
                  partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` (unique keys)."""
    ranged = _ranged(df, order, partitions)
    upto = Window.partitionBy("_rp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(value).over(upto))
    offsets = _offsets(ranged, F.col(value))
    return (local.join(F.broadcast(offsets), "_rp")
                 .withColumn(name, (F.col("_offset") + F.col("_local")).cast("long"))
                 .drop("_rp", "_local", "_offset"))


def next_in_order(df: DataFrame, order: list[Column], value: str, name: str,
                  partitions: int | None = None) -> DataFrame:
    """``lead(value)`` over a global order, computed range by range.

    The last row of a range takes the first value of the next non-empty
    range, found in a table with one row per range.
    """
    ranged = _ranged(df, order, partitions)
    w = Window.partitionBy("_rp").orderBy(*order)
    local = ranged.withColumn("_lead", F.lead(value).over(w))
    firsts = ranged.filter("_local = 0").select("_rp", F.col(value).alias("_first"))
    nxt = firsts.select("_rp", F.lead("_first").over(Window.orderBy("_rp")).alias("_next_first"))
    return (local.join(F.broadcast(nxt), "_rp")
                 .withColumn(name, F.coalesce(F.col("_lead"), F.col("_next_first")))
                 .drop("_rp", "_local", "_lead", "_next_first"))
