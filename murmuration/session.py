"""Spark session helpers.

``get_spark`` builds a session with the settings the engine is tuned for
(AQE, skew joins, UTC) for tests, the bench and local use. On a cluster the
deployment's own session is passed to the operators instead; the only
setting read from it is the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner can size; 32 MB keeps per-executor
    # copies small even when the build side is a node table.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # iterative operators checkpoint every round; let Spark delete the files
    # of rounds that are no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "murmuration") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("MURMURATION_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and points at shared storage.
    Only when it is unset and the master is local (unit tests on a laptop) a
    private folder is made; executors elsewhere could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = getattr(spark, "sparkContext", None)
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc is not None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="murmuration-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application).

    The zip is served to the executors by Spark, as with ``--py-files``, so
    functions of the package can be named in a task whatever folder or path
    the workers were started with.
    """
    sc = spark.sparkContext
    if getattr(sc, "_murmuration_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="murmuration-"), "murmuration.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, n)
                z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    sc.addPyFile(target)
    sc._murmuration_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder.

    Iterative operators (BFS levels, label propagation, power iteration)
    call this once per round so a lost executor recomputes one round, not
    the whole loop, and plans stay small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the checkpoint folder and read it back.

    A checkpoint keeps the planner's size estimate, and a join's is the product
    of its sides': in a loop whose state is joined with what was derived from
    it, the digits of that number multiply every round, until the driver does
    little else. The estimate of files is their size, so it starts anew.
    """
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"settled-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files that no result needs any more.

    It does so when the driver's collector meets a dead shuffle; a driver that
    only plans may not collect for long, while its executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
