"""Joins on keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a key is heavy from one HEAVY-th of the rows on, so there are HEAVY heavy keys at most
HEAVY = 100_000


def join_heavy(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (``key`` unique, ``count``: about how many rows have it, ``total`` at most in all).

    Rows of heavy keys never move: the at most HEAVY table rows that have one
    are broadcast. The others, of which no key has a HEAVY-th of the rows,
    meet their table rows by the planner's join. ``how``: inner or left; every
    table row has a ``count`` of 1 at least.
    """
    if total <= HEAVY:    # every key is heavy
        return rows.join(F.broadcast(table.drop(count)), key, how)
    is_heavy = F.col(count) * HEAVY >= total
    heavy = F.broadcast(table.filter(is_heavy).drop(count))
    there = rows.join(heavy, key)
    other = rows.join(heavy.select(key), key, "left_anti").join(table.filter(~is_heavy).drop(count), key, how)
    return there.unionByName(other)


# rows of a stored table of a few numbers that may be broadcast (some 30 MB)
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has at most BROADCAST_ROWS rows; else the planner joins it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
