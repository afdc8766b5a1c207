"""Verified dictionary (resume, reconcile, stream), stored state readers and run history."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from murmuration.operators import accounts as A
from murmuration.operators import history as H
from murmuration.sources import fixtures as fx
from murmuration.sources import readers as RD
from murmuration.sources import sinks as SK


def test_resume_equals_fresh_run(spark):
    ids, prof = fx.friend_ids(spark, SF_SMALL), fx.accounts(spark, SF_SMALL)
    fresh = A.run_dictionary(ids, prof)
    prev = A.run_dictionary(fx.previous_friend_ids(spark, SF_SMALL), prof)
    resumed = A.run_dictionary(ids, prof, prev.dictionary, prev.invalid, prev.error)
    for part in ("dictionary", "invalid", "error"):
        a = sorted(map(tuple, getattr(fresh, part).collect()))
        b = sorted(map(tuple, getattr(resumed, part).collect()))
        assert a == b, part
    counts = A.outcome_counts(resumed, ids).first()
    assert counts.reconciled


def test_duplicates(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (3,), (3,)], "account_id long")
    assert sorted((r.account_id, r.n) for r in A.duplicate_ids(ids).collect()) == [(2, 2), (3, 3)]
    s = A.duplicate_summary(ids).first()
    assert (s.listed, s.distinct_ids, s.surplus) == (6, 3, 3)


def test_id_list_and_dictionary_round_trips(spark):
    d = tempfile.mkdtemp(prefix="murm-test-")
    ids_file = os.path.join(d, "Invalid_users_IDs.txt")
    with open(ids_file, "w") as f:
        f.write("".join(f"{i}\n" for i in (1181, 22, 333)))
    assert sorted(r.account_id for r in RD.read_id_list(spark, ids_file).collect()) == [22, 333, 1181]
    dic = spark.createDataFrame([("7", "User7"), ("9", "User9")], "account_id string, screen_name string")
    for fmt in ("jsonl", "parquet", "object"):
        path = os.path.join(d, f"dict-{fmt}")
        SK.write_verified_dictionary(dic, path, fmt=fmt)
        back = sorted(map(tuple, RD.read_verified_dictionary(spark, path, fmt=fmt).collect()))
        assert back == [("7", "User7"), ("9", "User9")], fmt


def test_legacy_history_files(spark):
    d = tempfile.mkdtemp(prefix="murm-hist-")
    saved = {"last_time_date.txt": "2019-08-09 09:58:34.727564", "last_time_overall.txt": "312,588,0.6059856542171654",
             "last_time_sentiment.txt": "0.14,0.26", "last_time_userlevel.txt": "95.83333333333333"}
    for name, text in saved.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    row = RD.read_legacy_history(spark, d, "someaccount", "#sometopic").first()
    assert (row.nodes, row.edges) == (312, 588)
    assert row.density_pct == 0.6059856542171654 and row.percentile == 95.83333333333333
    assert (row.sentiment_all, row.sentiment_user) == (0.14, 0.26)
    assert str(row.run_ts).startswith("2019-08-09 09:58:34.727564")


def test_compare_last_run_picks_newest_earlier_run(spark):
    schema = RD.HISTORY_SCHEMA
    hist = spark.createDataFrame([
        ("u", "q", "2024-01-01 00:00:00", 10, 20, 1.0, 50.0, 0.1, 0.2),
        ("u", "q", "2024-01-05 00:00:00", 12, 25, 1.5, 55.0, 0.2, 0.3),
        ("u", "other", "2024-01-06 00:00:00", 99, 99, 9.0, 99.0, 0.9, 0.9),
    ], schema.replace("run_ts timestamp", "run_ts string")).withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    cur = spark.createDataFrame([("u", "q", "2024-01-10 00:00:00", 15, 30, 2.0, 60.0, 0.3, None)],
                                schema.replace("run_ts timestamp", "run_ts string")).withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    row = H.compare_last_run(cur, hist).first()
    assert row.previous_nodes == 12 and row.delta_nodes == 3 and row.delta_percentile == 5.0
    assert row.delta_sentiment_user is None
    first = H.compare_last_run(cur.withColumn("query", F.lit("new")), hist).first()
    assert first.previous_nodes is None


def test_empty_history_on_first_run(spark):
    assert RD.read_run_history(spark, "/nonexistent/murmuration/history").count() == 0


def test_dictionary_stream_is_exactly_once(spark):
    from murmuration.streaming.dictionary_stream import dictionary_from_outcomes, start_dictionary_stream
    d = tempfile.mkdtemp(prefix="murm-stream-")
    prof = fx.accounts(spark, SF_SMALL)
    ids = fx.friend_ids(spark, SF_SMALL)
    prev = fx.previous_friend_ids(spark, SF_SMALL)
    prev.write.parquet(f"{d}/ids/part=0")
    q = start_dictionary_stream(spark, f"{d}/ids/*", prof, f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    ids.write.parquet(f"{d}/ids/part=1")                 # the full listing arrives later, repeats included
    q = start_dictionary_stream(spark, f"{d}/ids/*", prof, f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    got = sorted(map(tuple, dictionary_from_outcomes(spark, f"{d}/out").collect()))
    expect = sorted(map(tuple, A.run_dictionary(ids, prof).dictionary.collect()))
    assert got == expect
    outcomes = spark.read.parquet(f"{d}/out")
    assert outcomes.count() == outcomes.select("account_id").distinct().count()


def test_update_dictionary_twice_is_idempotent(spark):
    from murmuration.plans.verified import update_dictionary
    d = tempfile.mkdtemp(prefix="murm-upd-")
    prof = fx.accounts(spark, SF_SMALL)
    first = update_dictionary(spark, fx.previous_friend_ids(spark, SF_SMALL), prof, d)
    assert first.counts.first().reconciled
    second = update_dictionary(spark, fx.friend_ids(spark, SF_SMALL), prof, d)
    c = second.counts.first()
    assert c.reconciled
    third = update_dictionary(spark, fx.friend_ids(spark, SF_SMALL), prof, d)
    assert third.outcomes.count() == 0                     # nothing left to settle
    assert third.counts.first() == c


def test_topic_report(spark):
    from murmuration.plans.topic_report import TopicParams, topic_report
    rep = topic_report(fx.posts(spark, SF_SMALL), fx.lexicon(spark), TopicParams(given_user="@User3", days=0))
    n = rep.window.first().n_posts
    assert n == rep.corpus.count() and n > 0
    assert rep.hashtags.count() <= 10 and rep.topics.count() <= 10
    assert rep.sentiment.first().n_posts == n


def _listing(folder, spark, ids):
    os.makedirs(folder, exist_ok=True)
    spark.createDataFrame([(i,) for i in ids], "o_custkey long").write.parquet(os.path.join(folder, "orders.parquet"))
    return folder


def test_account_ids_are_distinct(spark):
    import __spark_entry__ as E
    sf = _listing(tempfile.mkdtemp(prefix="murm-ids-"), spark, (5, 3, 5, 5, 9))
    assert sorted(r.account_id for r in E.queries()["account_ids"](spark, sf).collect()) == [3, 5, 9]


def test_dictionary_joins_pass_nothing_through_the_driver(spark):
    from murmuration.sources.settled import SettledStore
    ids = spark.createDataFrame([(1,), (2,), (2,)], "account_id long")
    profiles = spark.createDataFrame([(1, "User1", True)], "account_id long, screen_name string, verified boolean")
    store = SettledStore(spark, os.path.join(tempfile.mkdtemp(prefix="murm-store-"), "out"), 2)
    store.commit("0", A.hydrate(ids, profiles))
    for df in (A.hydrate(ids, profiles), store.unsettled(spark.createDataFrame([(2,), (3,)], "account_id long"))):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() in (1, 3)
