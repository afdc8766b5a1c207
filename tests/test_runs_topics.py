"""Stored runs, entry 1 on API-shaped posts, the {id: handle} object, the topic model."""

import json
import math
import os
import re
import tempfile

from conftest import SF_SMALL
from murmuration.operators import history as H
from murmuration.operators import posts as P
from murmuration.operators import topics as TP
from murmuration.plans.network import NetworkParams, analyse_network, run_and_store
from murmuration.sources import fixtures as fx
from murmuration.sources import readers as RD
from murmuration.sources import sinks as SK
from pyspark.sql import functions as F


def history(spark, rows):
    s = RD.HISTORY_SCHEMA.replace("run_ts timestamp", "run_ts string")
    return spark.createDataFrame(rows, s).withColumn("run_ts", F.col("run_ts").cast("timestamp"))


def test_runs_with_one_timestamp_give_one_row(spark):
    h = history(spark, [("u", "q", "2024-01-01 00:00:00", n, 1, 1.0, 50.0 + n, None, 0.2) for n in (3, 9, 5)])
    assert [r.nodes for r in H.latest_runs(h).collect()] == [9]
    cur = history(spark, [("u", "q", "2024-01-02 00:00:00", 10, 1, 1.0, 60.0, 0.1, 0.2)])
    rows = H.compare_last_run(cur, h).collect()
    assert len(rows) == 1 and rows[0].delta_nodes == 1 and rows[0].delta_percentile == 1.0 and rows[0].delta_sentiment_all is None
    assert [(r.nodes, r.previous_nodes) for r in H.previous_value(h, "nodes").orderBy("nodes").collect()] == [(3, None), (5, 3), (9, 5)]


def test_summary_without_a_previous_run(spark):
    now = spark.createDataFrame([(4, 6, 50.0)], "nodes long, edges long, density_pct double")
    row = H.with_previous(now, now.filter("false"), ("nodes", "density_pct")).first()
    assert (row.nodes, row.previous_nodes, row.delta_density_pct) == (4, None, None)


def test_two_stored_runs_on_api_posts(spark):
    raw, dic, lex = fx.raw_posts(spark, SF_SMALL), fx.verified_dictionary(spark, SF_SMALL), fx.lexicon(spark)
    p = NetworkParams(query="launch", given_user="User3", betweenness=False)
    folder = tempfile.mkdtemp(prefix="murm-runs-")
    earlier = analyse_network(raw.filter(F.col("created_at") < F.lit(fx.RUN_CUTOFF).cast("timestamp")), dic, p)
    first = run_and_store(earlier, lex, fx.RUN_CUTOFF, folder)
    assert first.comparison.first().previous_nodes is None
    now = analyse_network(raw, dic, p)
    assert now.corpus.count() == analyse_network(P.as_posts(raw), dic, p).corpus.count()
    for _ in range(2):                                     # a repeated run is compared with the run before it
        rep = run_and_store(now, lex, fx.AS_OF, folder)
        row = rep.comparison.first()
        assert row.previous_nodes == earlier.summary().first().nodes
        assert row.delta_percentile == row.percentile - row.previous_percentile
        net = rep.network.first()
        assert net.delta_edges == net.edges - net.previous_edges and net.delta_nodes == row.delta_nodes
    assert RD.read_run_history(spark, f"{folder}/history").count() == 3
    assert os.path.isdir(f"{folder}/nodes") and os.path.isdir(f"{folder}/links")
    absent = analyse_network(raw, dic, NetworkParams(query="launch", given_user="nobody_here", betweenness=False))
    assert absent.metrics(lex, fx.AS_OF).first().percentile is None


def test_object_is_one_json_object(spark):
    folder = tempfile.mkdtemp(prefix="murm-object-")
    rows = [(str(i), f'h{{"{i}"}},') for i in range(50)] + [("7", "z"), (None, "nobody"), ("x", None)]
    d = spark.createDataFrame(rows, "account_id string, screen_name string").repartition(4)
    SK.write_verified_dictionary(d, f"{folder}/o", fmt="object")
    parts = sorted(f for f in os.listdir(f"{folder}/o") if f.startswith("part-"))
    whole = json.loads("".join(open(f"{folder}/o/{f}").read() for f in parts))
    expect = {str(i): f'h{{"{i}"}},' for i in range(50)} | {"x": None}
    assert whole == expect
    assert {r.account_id: r.screen_name for r in RD.read_verified_dictionary(spark, f"{folder}/o", "object").collect()} == expect
    SK.write_verified_dictionary(d.filter("false"), f"{folder}/e", fmt="object")
    assert RD.read_verified_dictionary(spark, f"{folder}/e", "object").count() == 0
    for text in (json.dumps(expect), json.dumps(expect, indent=2)):      # as other tools write it
        with open(f"{folder}/plain.json", "w") as f:
            f.write(text)
        assert {r.account_id: r.screen_name for r in RD.read_verified_dictionary(spark, f"{folder}/plain.json", "object").collect()} == expect


def digamma(x):
    s = -sum(1 / (x + i) for i in range(6))
    x += 6
    return s + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def test_digamma(spark):
    got = spark.range(1).select(F.expr(TP.digamma("1.0D")).alias("a"), F.expr(TP.digamma("0.5D")).alias("b")).first()
    assert abs(got.a + 0.5772156649015329) < 1e-8 and abs(got.b + 1.9635100260214235) < 1e-8


def plain_topics(terms, k, steps, inner):
    import hashlib
    words = {w for _, w, _ in terms}
    lam = {w: [1 + int(hashlib.md5(f"{w}#{t}".encode()).hexdigest()[:8], 16) / 2**32 for t in range(k)] for w in words}
    for _ in range(steps):
        tot = [sum(lam[w][t] for w in words) for t in range(k)]
        b = {w: [math.exp(digamma(lam[w][t]) - digamma(tot[t])) for t in range(k)] for w in words}
        share = [b[w] for _, w, _ in terms]
        for _ in range(inner):
            g = {}
            for (d, w, n), s in zip(terms, share):
                own = g.setdefault(d, [1 / k] * k)
                g[d] = [own[t] + n * s[t] / sum(s) for t in range(k)]
            share = [[math.exp(digamma(g[d][t])) * b[w][t] for t in range(k)] for d, w, _ in terms]
        lam = {w: [1 / k] * k for w in words}
        for (d, w, n), s in zip(terms, share):
            lam[w] = [lam[w][t] + n * s[t] / sum(s) for t in range(k)]
    return lam


def test_topics_equal_the_plain_steps_and_part_two_subjects(spark):
    fish, cars = ["carp", "pike", "trout", "eel"], ["wheel", "motor", "brake", "clutch"]
    terms = [(d, w, float(1 + (d + i) % 3)) for d in range(40) for i, w in enumerate(fish if d % 2 else cars)]
    df = spark.createDataFrame(terms, "doc long, word string, n double")
    got = {r.word: [r.l0, r.l1] for r in TP.fit_topics(df, 2, 6).collect()}
    plain = plain_topics(terms, 2, 6, 2)
    assert set(got) == set(plain)
    assert all(math.isclose(got[w][t], plain[w][t], rel_tol=1e-9) for w in plain for t in (0, 1))
    far = {r.word: r.l0 > r.l1 for r in TP.fit_topics(df, 2, 20).collect()}
    assert len({far[w] for w in fish}) == 1 and len({far[w] for w in cars}) == 1 and far["carp"] != far["wheel"]


def test_topics_of_nothing_and_of_repeated_rows(spark):
    rows = [(i, "Carp and pike, pike again" if i % 2 else "wheel motor brake") for i in range(40)] + [(41, None), (42, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    terms = TP.document_terms(df, "doc_id")
    assert {(r.word, r.n) for r in terms.select("word", "n").distinct().collect()} == {
        ("carp", 1.0), ("pike", 2.0), ("wheel", 1.0), ("motor", 1.0), ("brake", 1.0)}
    assert TP.lda_topics(df.filter("false"), "doc_id").count() == 0
    out = TP.lda_topics(df, "doc_id", k=2, top_words=9, steps=3).collect()
    assert len(out) == 10 and all(abs(sum(r.weight for r in out if r.topic == t) - 1) < 1e-5 for t in (0, 1))


def test_steps_find_the_pairs_at_their_documents(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from test_plans import plan_text
    seen = []

    def look(pairs, numbered, *rest):
        seen.append(plan_text(pairs.withColumn("g", F.sum("n").over(Window.partitionBy("doc")))).split("InMemoryRelation")[0])
        return numbered.select(F.col("wid").alias("word"), F.lit(1.0).alias("l0"))
    monkeypatch.setattr(TP, "_steps", look)
    rows = [(d, w, 1.0) for d in range(20) for w in ("b", "a", f"w{d % 3}")]
    got = TP.fit_topics(spark.createDataFrame(rows, "doc long, word string, n double"), 1)
    assert {r.word for r in got.collect()} == {"a", "b", "w0", "w1", "w2"}
    assert "Window" in seen[0] and "Exchange" not in seen[0]


def test_pairs_of_dealt_documents_do_not_move(spark, monkeypatch):
    """The documents are dealt once; their pairs are counted, numbered and kept where they lie. The topics are those of moved pairs."""
    from test_plans import plan_text
    rows = [(i % 45, f"carp pike trout carp w{i % 3}x" if i % 2 else f"wheel motor brake w{i % 3}x") for i in range(60)] + [(None, "carp eel eel")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, steps = [], TP._steps

    def look(pairs, *rest):
        seen.append(plan_text(pairs))
        return steps(pairs, *rest)
    monkeypatch.setattr(TP, "_steps", look)
    got = TP.lda_topics(TP.spread(df, "doc_id"), "doc_id", k=2, min_df=2, steps=3).collect()
    assert "REPARTITION_BY_COL" in seen[0] and not re.search("ENSURE_REQUIREMENTS|REPARTITION_BY_NUM", seen[0])
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    plain = TP.fit_topics(TP.document_terms(df, "doc_id", min_df=2), 2, 3).collect()
    total = [sum(r[f"l{t}"] for r in plain) for t in (0, 1)]
    share = {(t, r.word): r[f"l{t}"] / total[t] for r in plain for t in (0, 1)}
    assert got and all(abs(r.weight - share[r.topic, r.word]) < 2e-6 for r in got)


def test_documents_are_dealt_before_they_are_cleaned(spark):
    from murmuration.plans.catalog import _documents
    from murmuration.sources.tables import read_table
    from conftest import SF_SMALL
    from test_plans import plan_text
    docs = _documents(spark, SF_SMALL)
    assert "REPARTITION_BY_COL" in plan_text(TP.kept_tokens(docs))
    assert docs.exceptAll(read_table(spark, SF_SMALL, "documents").select("doc_id", "text")).isEmpty()
