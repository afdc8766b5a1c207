"""Verified-account dictionary upkeep.

A run takes the followed-account ids, drops the ones an earlier run already
settled (valid, invalid or error) with anti-joins, looks the rest up in the
profile table, and splits them by outcome. Re-running with the outputs of an
interrupted run resumes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALID, INVALID, ERROR = "valid", "invalid", "error"


def unique_ids(ids: DataFrame) -> DataFrame:
    """U3."""
    return ids.select("account_id").distinct()


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """Ids listed more than once, with their count."""
    return (ids.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > 1).select("account_id", F.col("n").cast("long").alias("n")))


def duplicate_summary(ids: DataFrame) -> DataFrame:
    """Listed, distinct and surplus counts in one row."""
    per_id = ids.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.sum("n").cast("long").alias("listed"),
                      F.count(F.lit(1)).cast("long").alias("distinct_ids"),
                      (F.sum("n") - F.count(F.lit(1))).cast("long").alias("surplus"))


def skip_settled(ids: DataFrame, known_valid: DataFrame, known_invalid: DataFrame,
                 known_error: DataFrame) -> DataFrame:
    """Ids not yet settled by an earlier run (three anti-joins)."""
    out = ids
    for settled in (known_valid, known_invalid, known_error):
        out = out.join(settled.select(F.col("account_id").cast("long").alias("account_id")), "account_id", "left_anti")
    return out


def hydrate(ids: DataFrame, profiles: DataFrame) -> DataFrame:
    """J8 + F10: outcome of a profile lookup per id.

    no profile -> error (not found / suspended), verified -> valid,
    not verified -> invalid, profile without the flag -> error.
    """
    p = profiles.select("account_id", "screen_name", "verified", F.lit(True).alias("_found"))
    # merged: a broadcast would pass all profiles through the driver
    j = ids.join(p.hint("merge"), "account_id", "left")
    status = (F.when(F.col("_found").isNull(), F.lit(ERROR))
               .when(F.col("verified") == True, F.lit(VALID))  # noqa: E712
               .when(F.col("verified") == False, F.lit(INVALID))  # noqa: E712
               .otherwise(F.lit(ERROR)))
    return j.select("account_id", F.when(status == VALID, F.col("screen_name")).alias("screen_name"),
                    status.alias("status"))


@dataclass
class DictionaryRun:
    outcomes: DataFrame       # account_id, screen_name, status (this run only)
    dictionary: DataFrame     # account_id (string), screen_name: earlier + new valid
    invalid: DataFrame        # account_id: earlier + new
    error: DataFrame          # account_id: earlier + new


def run_dictionary(friend_ids: DataFrame, profiles: DataFrame, dictionary: DataFrame | None = None,
                   invalid: DataFrame | None = None, error: DataFrame | None = None) -> DictionaryRun:
    """Entry 3: one (resumable) pass of the verified-dictionary builder."""
    spark = friend_ids.sparkSession
    empty_ids = spark.createDataFrame([], "account_id long")
    dictionary = dictionary if dictionary is not None else spark.createDataFrame([], "account_id string, screen_name string")
    invalid = invalid if invalid is not None else empty_ids
    error = error if error is not None else empty_ids
    todo = skip_settled(unique_ids(friend_ids), dictionary, invalid, error)
    outcomes = hydrate(todo, profiles)
    new_valid = outcomes.filter(F.col("status") == VALID).select(
        F.col("account_id").cast("string").alias("account_id"), "screen_name")
    return DictionaryRun(
        outcomes=outcomes,
        dictionary=dictionary.select("account_id", "screen_name").unionByName(new_valid),
        invalid=invalid.select("account_id").unionByName(outcomes.filter(F.col("status") == INVALID).select("account_id")),
        error=error.select("account_id").unionByName(outcomes.filter(F.col("status") == ERROR).select("account_id")),
    )


def outcome_counts(run: DictionaryRun, friend_ids: DataFrame) -> DataFrame:
    """A14 + A15: totals including earlier runs and the reconciliation check."""
    valid = run.dictionary.agg(F.count(F.lit(1)).alias("valid"))
    inv = run.invalid.agg(F.count(F.lit(1)).alias("invalid"))
    err = run.error.agg(F.count(F.lit(1)).alias("error"))
    ids = unique_ids(friend_ids).agg(F.count(F.lit(1)).alias("distinct_ids"))
    row = valid.crossJoin(inv).crossJoin(err).crossJoin(ids)
    return row.select(*[F.col(c).cast("long").alias(c) for c in ("valid", "invalid", "error", "distinct_ids")],
                      (F.col("valid") + F.col("invalid") + F.col("error") == F.col("distinct_ids")).alias("reconciled"))


def flag_verified(nodes: DataFrame, dictionary: DataFrame, handle: str = "node") -> DataFrame:
    """Case-insensitive membership of each handle in the dictionary's values."""
    names = dictionary.select(F.lower("screen_name").alias("_h")).distinct().withColumn("_v", F.lit(True))
    return (nodes.join(names, F.lower(F.col(handle)) == F.col("_h"), "left")
                 .select(*nodes.columns, F.coalesce(F.col("_v"), F.lit(False)).alias("verified")))
