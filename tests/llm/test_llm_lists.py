"""Pairs that share only one large list."""

import glob
import os
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from murmuration.llm import common, linededup, lists, neardup
from murmuration.llm.lists import ListSearch
from murmuration.session import cut_lineage, ensure_checkpoint_dir


def inside_pairs(n, words=200):
    """A text and the same text with a quarter appended: Jaccard just over 0.8, one inside the other."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    out = []
    for i in range(n):
        text = [word() for _ in range(words)]
        out += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + [word() for _ in range(words // 4 - 1)]))]
    return out


def test_large_list_of_documents_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup._Search, "small", 2)
    rows = inside_pairs(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = cut_lineage(neardup.sketches(docs, 4, "doc_id", "text"))
    nodes = neardup.numbered_nodes(own)
    label = neardup._Search(docs, nodes, 4, 80, "text").run(nodes.select("node", F.lit(1).cast("long").alias("key")))
    label = label.join(nodes.select("node", "digest"), "node").select(F.col("digest").alias("node"), "label")
    got = own.join(label, "node").groupBy("label").agg(F.sort_array(F.collect_list(F.col("id").cast("long"))).alias("ids")).collect()
    assert sorted(list(r["ids"]) for r in got) == [[2 * i, 2 * i + 1] for i in range(40)]
    assert [c for i, _, c in brute.near_duplicates(rows)] == [i // 2 * 2 for i in range(80)]


def test_large_list_of_lines_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(linededup._Search, "small", 2)
    monkeypatch.setattr(linededup, "BOUND", 3)
    docs = spark.createDataFrame(inside_pairs(40, 30), "doc_id long, text string")
    found = cut_lineage(linededup.lines(docs, "doc_id", "text"))
    label = linededup._Search(found, 80).run(found.select(F.col("l").alias("node"), F.lit(1).cast("long").alias("key")))
    got = found.join(label.withColumnRenamed("node", "l"), "l").groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
    assert sorted(list(r["ids"]) for r in got) == [[2 * i, 2 * i + 1] for i in range(40)]


def estimate(df, capsys):
    """The largest power of ten among the planner's sizes."""
    capsys.readouterr()
    df.explain(mode="cost")
    return max([int(x) for x in re.findall(r"E\+(\d+)", capsys.readouterr().out)], default=0)


def test_labels_of_many_rounds_are_right_and_planned_anew(spark, capsys):
    rng, search, every = random.Random(7), ListSearch(), []
    for turn in range(5):
        # the third turn links only what is linked already
        links = every[:20] if turn == 2 else [(rng.randrange(300), rng.randrange(300)) for _ in range(40)]
        every += links
        search._add(cut_lineage(spark.createDataFrame(links, "u long, v long")))
        label = search.labels()
        low = {x: x for e in every for x in e if e[0] != e[1]}
        while any(low[u] != low[v] for u, v in every if u != v):
            for u, v in every:
                if u != v:
                    low[u] = low[v] = min(low[u], low[v])
        assert {r["node"]: r["label"] for r in label.collect()} == low
    assert estimate(label, capsys) < 30     # a chain of products had hundreds of digits here


@pytest.mark.parametrize("broadcast", [1_000_000, 4])
def test_rows_of_repeated_keys_stay(spark, monkeypatch, broadcast):
    """Keys met once go before anything is moved by key; a full table of bits lets some through and loses none."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    rows = [(rng.randrange(-400, 400), i) for i in range(400)]
    got = {tuple(r) for r in lists.repeated(spark.createDataFrame(rows, "key long, node long")).collect()}
    keys = [k for k, _ in rows]
    wanted = {r for r in rows if keys.count(r[0]) > 1}
    assert wanted <= got <= set(rows)
    assert got == wanted or broadcast == 4


def stored(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder.removeprefix('file:')}/**", recursive=True) if os.path.isfile(f))


def test_texts_of_lines_are_stored_not_their_hashes(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(4000))
        rows += [(2 * i, line), (2 * i + 1, line[:-20])]
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = ensure_checkpoint_dir(spark)
    before, texts = stored(folder), sum(len(t) for _, t in rows)
    got = linededup.op5(docs).collect()
    assert sorted(r["doc_id"] for r in got if r["n_dropped"]) == [2 * i + 1 for i in range(60)]
    assert stored(folder) - before < 3 * texts     # hashes of shingles: eight times the text


def template_texts(groups):
    """Texts of one template that are not similar (Jaccard 0.70), each with a copy that has its last words changed."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    template, out = [word() for _ in range(40)], []
    for i in range(groups):
        own = [word() for _ in range(8)]
        out += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:-2] + [word(), word()]))]
    return out


@pytest.mark.parametrize("module", [neardup, linededup])
def test_texts_of_a_template_are_not_all_compared(spark, monkeypatch, module):
    monkeypatch.setattr(module._Search, "small", 2)
    monkeypatch.setattr(linededup, "BOUND", 3)
    compared, compare = [], module._Search.compare

    def counting(self, pairs):
        compared.append(pairs.count())
        return compare(self, pairs)
    monkeypatch.setattr(module._Search, "compare", counting)
    rows = template_texts(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if module is neardup:
        got = {r["doc_id"]: r["component_id"] for r in neardup.component_ids(docs, 4, 80).collect()}
        assert got == {i: c for i, _, c in brute.near_duplicates(rows)} == {i: i // 2 * 2 for i in range(80)}
        assert sum(compared) < 800     # of 3,160 pairs that share a list
    else:
        got = {r["doc_id"]: list(r["dropped"]) for r in linededup.op5(docs).collect() if r["n_dropped"]}
        assert got == {i: v for (i, _), v in brute.dropped_lines(rows).items() if v}


def test_places_bound_what_sets_share(spark):
    """Similar sets meet in a list at places that allow it, and the smaller one leads there."""
    rng, percent = random.Random(2), 80
    sets = []
    for i in range(60):
        base = rng.sample(range(200), rng.randrange(1, 30)) if i % 3 == 0 or not sets else [*sets[-1]]
        sets.append(sorted({*base, *rng.sample(range(200), rng.randrange(0, 4))}))
    table = cut_lineage(spark.createDataFrame(list(enumerate(sets)), "node long, grams array<long>"))
    dealt = lists.by_rarest(table, table.select("node"), percent)
    x, y = (dealt.select("key", *[F.col(c).alias(c + s) for c in ("node", "i", "n")]) for s in "uv")
    met = x.join(y, "key").filter("nodeu <> nodev AND nu <= nv").filter(lists.can_meet(F.col("iu"), F.col("nu"), F.col("iv"), F.col("nv"), percent))
    lead = {(r["key"], r["node"]) for r in dealt.filter(lists.leads(percent)).collect()}
    met = {(r["nodeu"], r["nodev"]) for r in met.collect() if (r["key"], r["nodeu"]) in lead}
    similar = {(u, v) for u in range(60) for v in range(60) if u != v and len(sets[u]) <= len(sets[v])
               and 100 * len({*sets[u]} & {*sets[v]}) >= percent * len({*sets[u]} | {*sets[v]})}
    assert similar and similar <= met
