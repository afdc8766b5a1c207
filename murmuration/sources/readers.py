"""Reading stored state: dictionaries, id lists, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = ("given_user string, query string, run_ts timestamp, nodes long, edges long, "
                  "density_pct double, percentile double, sentiment_all double, sentiment_user double")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def read_verified_dictionary(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """(account_id string, screen_name) from JSON lines, parquet, or the
    legacy single JSON object ``{id: handle}``, on one line or over many lines
    and files (an entry must not be broken over lines)."""
    if fmt == "jsonl":
        return spark.read.schema("account_id string, screen_name string").json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "object":
        entries = F.regexp_replace(F.trim("value"), r"^[{,]|[,}]$", "")    # a line holds some whole entries
        m = F.from_json(F.concat(F.lit("{"), F.trim(entries), F.lit("}")), "map<string,string>")
        return spark.read.text(path).select(F.explode(m).alias("account_id", "screen_name"))
    raise ValueError(fmt)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Newline-separated ids; blank lines (the trailing one) are dropped."""
    lines = spark.read.text(path)
    return (lines.filter(F.trim("value") != "")
                 .select(F.expr("try_cast(trim(value) AS BIGINT)").alias("account_id")))


def read_account_ids(spark: SparkSession, path: str) -> DataFrame:
    """S5 (cached copy): the parquet snapshot of the followed-id listing."""
    return spark.read.parquet(path).select("account_id")


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """Every stored run; an empty table on the first run."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def read_legacy_history(spark: SparkSession, folder: str, given_user: str, query: str) -> DataFrame:
    """S8 (legacy): the four one-line text files of the single-machine tool
    (date; nodes,edges,density; percentile; sentiment all,user) as one row."""
    def one(name: str) -> DataFrame:
        return spark.read.text(f"{folder}/{name}", wholetext=True).select(F.trim("value").alias(name.split(".")[0]))

    row = (one("last_time_date.txt").crossJoin(one("last_time_overall.txt"))
           .crossJoin(one("last_time_userlevel.txt")).crossJoin(one("last_time_sentiment.txt")))
    ov = F.split("last_time_overall", ",")
    se = F.split("last_time_sentiment", ",")
    return row.select(F.lit(given_user).alias("given_user"), F.lit(query).alias("query"),
                      F.to_timestamp("last_time_date").alias("run_ts"),
                      F.get(ov, 0).cast("long").alias("nodes"), F.get(ov, 1).cast("long").alias("edges"),
                      F.get(ov, 2).cast("double").alias("density_pct"),
                      F.col("last_time_userlevel").cast("double").alias("percentile"),
                      F.get(se, 0).cast("double").alias("sentiment_all"),
                      F.get(se, 1).cast("double").alias("sentiment_user"))
