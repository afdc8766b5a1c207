"""The stored state of dictionary runs: settled ids in buckets, and a ledger.

Outcomes lie in a parquet table bucketed by the account id, one partition per
batch. A batch replaces its own partition and is entered in the ledger
afterwards, so a batch that was cut off or runs again leaves no second copy,
and only entered batches count as settled. An anti-join against the settled
ids moves the new ids to the buckets; the stored side is read where it lies.

``folder`` holds the table; ``folder.ledger`` and ``folder.layout`` (the number
of buckets) lie beside it: a later application opens all of it again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.session import cut_lineage
from murmuration.sources.readers import _exists

BUCKETS = 64        # of a new store; many for billions of ids, few for tests
LEDGER_SCHEMA = "valid long, invalid long, error long, batch string"


class SettledStore:
    """Opens the store in ``folder``, or starts one with ``buckets`` buckets."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        layout = f"{self.folder}.layout"
        if not _exists(spark, layout):
            spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).write.parquet(layout)
        self.buckets = spark.read.parquet(layout).first().buckets
        self.table = "murmuration_settled_" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        place = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (account_id BIGINT, screen_name STRING, status STRING, batch STRING) "
                  f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (account_id) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        if _exists(spark, self.folder):
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def ledger(self) -> DataFrame:
        """(batch, valid, invalid, error) of every finished batch."""
        path = f"{self.folder}.ledger"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(path)

    def finished(self) -> list[str]:
        """Keys of the finished batches (one short string a batch)."""
        return sorted(r.batch for r in self.ledger().select("batch").collect())

    def settled(self, but: str | None = None) -> DataFrame:
        """(account_id, screen_name, status, batch) of the finished batches, without ``but``."""
        keys = [k for k in self.finished() if k != but]
        return self.spark.table(self.table).filter(F.col("batch").isin(keys))

    def unsettled(self, ids: DataFrame, but: str | None = None) -> DataFrame:
        """J1-J3 in one anti-join: the distinct ids that no finished batch (without ``but``) holds.

        Repeats are removed before the ids move to the buckets, so an id that
        is listed very often does not fill a task.
        """
        new = ids.select(F.col("account_id").cast("long").alias("account_id")).distinct().repartition(self.buckets, "account_id")
        # merged: the stored side lies in its buckets, and a broadcast would pass it through the driver
        return new.join(self.settled(but).select("account_id").hint("merge"), "account_id", "left_anti")

    def commit(self, batch: str, outcomes: DataFrame) -> dict[str, int]:
        """Stores (account_id, screen_name, status) as ``batch``, replacing what it held; returns its ledger row."""
        if not batch.replace("-", "").isalnum():
            raise ValueError(batch)
        # stored first: the outcomes may depend on the table they are written to
        rows = cut_lineage(outcomes.select(F.col("account_id").cast("long").alias("account_id"), "screen_name", "status"))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{batch}') SELECT * FROM {{rows}}",
                       rows=rows.repartition(self.buckets, "account_id"))
        count = [F.count_if(F.col("status") == s).alias(s) for s in ("valid", "invalid", "error")]
        counts = rows.agg(*count).first().asDict()
        self.spark.range(1).select(*[F.lit(n).cast("long").alias(s) for s, n in counts.items()]).write.mode("overwrite").parquet(
            f"{self.folder}.ledger/batch={batch}")
        return counts

    def dictionary(self) -> DataFrame:
        """(account_id string, screen_name) of all valid ids."""
        return self.settled().filter(F.col("status") == "valid").select(F.col("account_id").cast("string").alias("account_id"), "screen_name")

    def with_status(self, status: str) -> DataFrame:
        """(account_id) of all ids with an outcome."""
        return self.settled().filter(F.col("status") == status).select("account_id")
