"""Writers (K1-K6). Every writer is a distributed DataFrame write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_verified_dictionary(dictionary: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """K1: the full dictionary, replacing the previous one.

    ``jsonl``/``parquet`` are written as they lie. ``object`` is the legacy
    single ``{id: handle}`` object: one entry a line in id order, over as many
    part files as the order has ranges, which joined in file order are one
    JSON object. Of an id with several handles the first in order stays.
    """
    d = dictionary.select("account_id", "screen_name")
    if fmt == "jsonl":
        d.write.mode("overwrite").json(path)
    elif fmt == "parquet":
        d.write.mode("overwrite").parquet(path)
    elif fmt == "object":
        _object_lines(d).write.mode("overwrite").text(path)
    else:
        raise ValueError(fmt)


def _object_lines(d: DataFrame) -> DataFrame:
    """The lines of one JSON object in order: ``{``, an entry each (a comma before all but the first), ``}``."""
    entries = d.filter(F.col("account_id").isNotNull()).groupBy("account_id").agg(F.min("screen_name").alias("screen_name"))
    first = entries.agg(F.min("account_id").alias("_first"))     # one row
    pair = F.to_json(F.create_map("account_id", "screen_name"), {"ignoreNullFields": "false"})
    comma = F.when(F.col("account_id") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    lines = entries.crossJoin(F.broadcast(first)).select(
        F.lit(1).alias("part"), "account_id", F.concat(comma, pair.substr(F.lit(2), F.length(pair) - 2)).alias("value"))
    ends = d.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, account_id string, value string")
    return lines.unionByName(ends).orderBy("part", "account_id").select("value")


def checkpoint_progress(outcomes: DataFrame, path: str) -> None:
    """K2: append finished outcomes; a restart anti-joins against them."""
    outcomes.write.mode("append").parquet(path)


def append_outcome_ids(outcomes: DataFrame, path: str) -> None:
    """K3: ids per outcome as text lines, one folder per status."""
    (outcomes.filter(F.col("status") != "valid")
             .select(F.col("account_id").cast("string").alias("value"), "status")
             .write.mode("append").partitionBy("status").text(path))


def export_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """K4/K5: node or link table as CSV with a header.

    The single-machine tool wrote Windows-1252; Spark's CSV writer takes the
    standard charsets only, so ISO-8859-1 is the closest legacy choice.
    """
    # keep the single-space labels of hidden accounts as they are
    (df.write.mode("overwrite").option("header", True).option("encoding", encoding)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def append_run_history(rows: DataFrame, path: str) -> None:
    """K6: keep every run (the single-machine tool overwrote one file)."""
    rows.write.mode("append").parquet(path)


def save_account_ids(ids: DataFrame, path: str) -> None:
    """S5 cache: parquet snapshot of the id listing."""
    ids.select("account_id").write.mode("overwrite").parquet(path)
