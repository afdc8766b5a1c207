"""The bucketed store of settled ids and runs that are cut off."""

import tempfile

import pytest
from pyspark.sql import functions as F

from murmuration.operators import accounts as A
from murmuration.plans.verified import update_dictionary
from murmuration.sources.settled import SettledStore

OUTCOMES = "account_id long, screen_name string, status string"
PROFILES = "account_id long, screen_name string, verified boolean"


def outcomes(spark, rows):
    return spark.createDataFrame(rows, OUTCOMES)


def profiles(spark, n=60):
    return spark.createDataFrame([(i, f"User{i}", None if i % 7 == 0 else i % 2 == 0) for i in range(n) if i % 5], PROFILES)


def listing(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "account_id long")


def expected(i):
    if i % 5 == 0 or i % 7 == 0:
        return None, "error"
    return (f"User{i}", "valid") if i % 2 == 0 else (None, "invalid")


def test_a_batch_replaces_itself_and_reopens(spark):
    d = tempfile.mkdtemp(prefix="murm-store-") + "/out"
    store = SettledStore(spark, d, 4)
    assert store.settled().count() == 0 and store.finished() == []
    store.commit("0", outcomes(spark, [(1, "a", "valid"), (2, None, "error")]))
    store.commit("1", outcomes(spark, []))
    assert store.commit("0", outcomes(spark, [(1, "a", "valid"), (3, None, "invalid")])) == {"valid": 1, "invalid": 1, "error": 0}
    again = SettledStore(spark, d, 16)       # the folder knows its number of buckets
    assert again.buckets == 4 and again.finished() == ["0", "1"]
    assert sorted((r.account_id, r.status) for r in again.settled().collect()) == [(1, "valid"), (3, "invalid")]
    assert [r.account_id for r in again.unsettled(listing(spark, [1, 2, 2, 3]), ).collect()] == [2]
    assert again.unsettled(listing(spark, [1, 2]), but="0").count() == 2
    with pytest.raises(ValueError):
        again.commit("0' --", outcomes(spark, []))


def test_a_batch_outside_the_ledger_is_not_settled(spark):
    store = SettledStore(spark, tempfile.mkdtemp(prefix="murm-store-") + "/out", 4)
    store.commit("0", outcomes(spark, [(1, "a", "valid")]))
    spark.sql(f"INSERT OVERWRITE TABLE {store.table} PARTITION (batch = '1') SELECT 2L, 'b', 'valid'")   # cut off before the ledger
    assert [r.account_id for r in store.settled().collect()] == [1]
    assert [r.account_id for r in store.unsettled(listing(spark, [1, 2])).collect()] == [2]


def test_the_stored_side_is_not_shuffled(spark):
    store = SettledStore(spark, tempfile.mkdtemp(prefix="murm-store-") + "/out", 4)
    for b in range(3):
        store.commit(str(b), outcomes(spark, [(i, None, "error") for i in range(b * 50, b * 50 + 50)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = store.unsettled(listing(spark, range(200)))
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.account_id for r in new.collect()) == list(range(150, 200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stored = plan[plan.rindex("+- Sort"):]       # the join's right side comes last
    assert store.table in stored and "Bucketed: true" in stored and "Exchange" not in stored, plan


def test_a_run_that_is_cut_off_resumes(spark):
    d = tempfile.mkdtemp(prefix="murm-run-")
    ids, prof, seen = listing(spark, [*range(60), 3, 3, None]), profiles(spark), []

    def stop(row):
        seen.append(row)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        update_dictionary(spark, ids, prof, d, parts=4, progress=stop, buckets=4)
    store = SettledStore(spark, f"{d}/outcomes")
    first = store.settled().collect()
    assert len(store.finished()) == 1 and 0 < len(first) < 60
    # profiles change meanwhile: settled ids keep their outcome, the rest is looked up anew
    none = prof.filter(F.lit(False))
    seen.clear()
    run = update_dictionary(spark, ids, none, d, use_cached_ids=True, progress=seen.append)
    assert [r["finished"] for r in seen] == [2, 3, 4] and all(r["batches"] == 4 for r in seen)
    kept = {r.account_id: (r.screen_name, r.status) for r in first}
    assert all(kept[i] == expected(i) for i in kept)
    got = {r.account_id: (r.screen_name, r.status) for r in store.settled().collect()}
    assert got == {i: kept.get(i, (None, "error")) for i in range(60)}
    assert run.outcomes.count() == 60 - len(first) and run.counts.first().reconciled
    assert (run.duplicates.first().listed, run.duplicates.first().surplus) == (62, 2)


def test_an_open_run_is_finished_before_new_ids(spark):
    d = tempfile.mkdtemp(prefix="murm-run-")
    prof = profiles(spark)

    def stop(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        update_dictionary(spark, listing(spark, range(30)), prof, d, parts=3, progress=stop, buckets=4)
    run = update_dictionary(spark, listing(spark, range(60)), prof, d, batch_ids=10)
    store = SettledStore(spark, f"{d}/outcomes")
    got = [(r.account_id, (r.screen_name, r.status)) for r in store.settled().collect()]
    assert sorted(got) == [(i, expected(i)) for i in range(60)]
    assert run.counts.first().reconciled and len(store.finished()) == 6
    empty = update_dictionary(spark, listing(spark, []), prof, d)
    assert empty.outcomes.count() == 0


def test_stream_and_store_agree_on_settled(spark):
    from murmuration.streaming.dictionary_stream import dictionary_from_outcomes, process_batch
    d = tempfile.mkdtemp(prefix="murm-run-") + "/out"
    prof = profiles(spark)
    for batch, ids in ((0, range(40)), (1, range(20, 60)), (1, range(20, 60))):      # the last is a replay
        process_batch(listing(spark, ids), batch, prof, d, 4)
    got = sorted((int(r.account_id), r.screen_name) for r in dictionary_from_outcomes(spark, d).collect())
    assert got == [(i, f"User{i}") for i in range(60) if expected(i)[1] == A.VALID]
