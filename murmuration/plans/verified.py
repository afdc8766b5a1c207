"""Entry 3: keep the dictionary of verified accounts up to date.

Followed-account ids -> duplicate report -> drop ids settled by earlier
runs -> profile lookup -> valid / invalid / error -> stored state. A run
writes its plan first (the unsettled ids, cut into batches), then settles one
batch after the other; each is stored and entered in the ledger of
``sources/settled.py`` before the next begins. A run that was cut off is
finished by the next call, which skips the batches in the ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.operators import accounts as A
from murmuration.sources import readers as RD
from murmuration.sources import sinks as SK
from murmuration.sources.settled import BUCKETS, SettledStore

BATCH_IDS = 1_000_000      # ids of a batch, about
PLAN_SCHEMA = "parts long, run string"


@dataclass
class VerifiedRun:
    duplicates: DataFrame    # listed, distinct_ids, surplus
    outcomes: DataFrame      # account_id, screen_name, status settled by this call
    counts: DataFrame        # valid, invalid, error, distinct_ids, reconciled


def _plans(store: SettledStore) -> dict[str, int]:
    """Number of batches of every planned run (one row a run)."""
    path = f"{store.folder}.plans"
    if not RD._exists(store.spark, path):
        return {}
    return {r.run: r.parts for r in store.spark.read.schema(PLAN_SCHEMA).parquet(path).collect()}


def _keys(run: str, parts: int) -> list[str]:
    return [f"{run}-{i:08d}" for i in range(parts)]


def plan_run(store: SettledStore, ids: DataFrame, parts: int | None = None, batch_ids: int = BATCH_IDS) -> str | None:
    """Stores the unsettled ids of a new run in batches; None if nothing is left to settle.

    The plan row is written after the ids: a plan that was cut off does not count.
    """
    run = f"r{len(_plans(store)):08d}"
    path = f"{store.folder}.runs/run={run}"
    todo = store.unsettled(ids)
    todo.write.mode("overwrite").parquet(f"{path}/todo")
    todo = store.spark.read.parquet(f"{path}/todo")
    n = todo.count()
    if not n:
        return None
    parts = parts or -(-n // batch_ids)
    cut = todo.withColumn("part", F.pmod(F.xxhash64("account_id"), F.lit(parts)))
    cut.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/ids")
    store.spark.range(1).select(F.lit(parts).cast("long").alias("parts")).write.mode("overwrite").parquet(f"{store.folder}.plans/run={run}")
    return run


def finish_run(store: SettledStore, run: str, profiles: DataFrame, progress: Callable[[dict], None] | None = None) -> list[str]:
    """Settles the batches of a planned run that the ledger lacks; returns their keys.

    ``progress`` is called after each batch with its ledger row, its key and
    the numbers of finished and of all batches.
    """
    keys = _keys(run, _plans(store)[run])
    done = set(store.finished())
    todo = [(i, k) for i, k in enumerate(keys) if k not in done]
    ids = store.spark.read.schema("account_id long, part long").parquet(f"{store.folder}.runs/run={run}/ids")
    for at, (i, key) in enumerate(todo, 1):
        counts = store.commit(key, A.hydrate(ids.filter(F.col("part") == i).select("account_id"), profiles))
        if progress:
            progress({"batch": key, "finished": len(keys) - len(todo) + at, "batches": len(keys), **counts})
    return [k for _, k in todo]


def update_dictionary(spark: SparkSession, friend_ids: DataFrame, profiles: DataFrame, folder: str,
                      use_cached_ids: bool = False, parts: int | None = None, batch_ids: int = BATCH_IDS,
                      progress: Callable[[dict], None] | None = None, buckets: int = BUCKETS) -> VerifiedRun:
    """Settles every listed id that no earlier run settled, in ``parts`` batches (by default of about ``batch_ids`` ids).

    A run that was cut off is finished first. Null ids name no account and
    are left out; an empty listing settles nothing.
    """
    store = SettledStore(spark, f"{folder}/outcomes", buckets)
    ids_cache = f"{folder}/id_listing"
    if not (use_cached_ids and RD._exists(spark, ids_cache)):
        SK.save_account_ids(friend_ids.filter(F.col("account_id").isNotNull()), ids_cache)
    friend_ids = RD.read_account_ids(spark, ids_cache)
    done = set(store.finished())
    keys: list[str] = []
    for run, n in sorted(_plans(store).items()):
        if not done.issuperset(_keys(run, n)):
            keys += finish_run(store, run, profiles, progress)
    run = plan_run(store, friend_ids, parts, batch_ids)
    if run:
        keys += finish_run(store, run, profiles, progress)
    outcomes = store.settled().filter(F.col("batch").isin(keys)).select("account_id", "screen_name", "status")
    final = A.DictionaryRun(outcomes, store.dictionary(), store.with_status(A.INVALID), store.with_status(A.ERROR))
    return VerifiedRun(A.duplicate_summary(friend_ids), outcomes, A.outcome_counts(final, friend_ids))
