"""Incremental verified-dictionary upkeep as a Structured Streaming job.

The single-machine tool walked a list of followed-account ids, saved its
partial dictionary every 500 ids and, after a crash, skipped the ids it had
already settled. Here new id-listing files arriving in a folder are the
stream; every micro-batch drops ids settled by any other batch (one anti-join
with the bucketed store, which is not shuffled), looks the rest up in the
profile table and commits the outcomes. The streaming checkpoint records
which files were consumed, and each micro-batch replaces its own batch of the
store, so a replay after a failure duplicates nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmuration.operators.accounts import hydrate
from murmuration.sources.settled import BUCKETS, SettledStore


def process_batch(batch: DataFrame, batch_id: int, profiles: DataFrame, outcomes_path: str, buckets: int = BUCKETS) -> None:
    """One micro-batch: new ids -> anti-join settled -> lookup -> commit (idempotent)."""
    store, key = SettledStore(batch.sparkSession, outcomes_path, buckets), str(batch_id)
    # on a replay, this batch's own previous output must not hide its ids
    store.commit(key, hydrate(store.unsettled(batch, but=key), profiles))


def start_dictionary_stream(spark: SparkSession, ids_folder: str, profiles: DataFrame, outcomes_path: str,
                            checkpoint_path: str, max_files_per_trigger: int = 1, available_now: bool = True,
                            buckets: int = BUCKETS):
    """Start the stream over parquet id listings (column ``account_id``)."""
    ids = (spark.readStream.schema("account_id long")
                .option("maxFilesPerTrigger", max_files_per_trigger).parquet(ids_folder))
    writer = (ids.writeStream.foreachBatch(lambda df, bid: process_batch(df, bid, profiles, outcomes_path, buckets))
                 .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def dictionary_from_outcomes(spark: SparkSession, outcomes_path: str) -> DataFrame:
    """K1 input: the current {id: handle} table from all stored outcomes."""
    return SettledStore(spark, outcomes_path).dictionary()
