"""Graph operators against plain-Python reference implementations on small graphs."""

import math
import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from murmuration.operators import centrality as C
from murmuration.operators import components as CC
from murmuration.operators import graph as G


def random_edges(seed, n=12, m=30, loops=2):
    rnd = random.Random(seed)
    e = [(f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for _ in range(m)]
    e += [(f"n{i}", f"n{i}") for i in range(loops)]
    return e


def frame(spark, edges):
    return spark.createDataFrame([(i, 0, s, r) for i, (s, r) in enumerate(edges)],
                                 "post_id long, pos long, sender string, receiver string")


def py_bfs(succ, s):
    dist, sigma, order, preds = {s: 0}, {s: 1.0}, [], {}
    q = deque([s])
    while q:
        v = q.popleft()
        order.append(v)
        for w in succ.get(v, ()):
            if w not in dist:
                dist[w] = dist[v] + 1
                sigma[w] = 0.0
                q.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
                preds.setdefault(w, []).append(v)
    return dist, sigma, order, preds


def py_centralities(edges):
    nodes = sorted({x for e in edges for x in e})
    n = len(nodes)
    succ = {}
    for s, r in set(edges):
        if s != r:
            succ.setdefault(s, set()).add(r)
    succ = {k: sorted(v) for k, v in succ.items()}
    deg_in = {v: 0 for v in nodes}
    deg_out = {v: 0 for v in nodes}
    for s, r in edges:
        deg_out[s] += 1
        deg_in[r] += 1
    bc = {v: 0.0 for v in nodes}
    reach = {v: [0, 0] for v in nodes}
    for s in nodes:
        dist, sigma, order, preds = py_bfs(succ, s)
        for t, d in dist.items():
            if t != s:
                reach[t][0] += 1
                reach[t][1] += d
        delta = {v: 0.0 for v in order}
        for w in reversed(order):
            for v in preds.get(w, ()):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                bc[w] += delta[w]
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    out = {}
    for v in nodes:
        r, sd = reach[v]
        close = (r / sd) * (r / (n - 1)) if sd > 0 and n > 1 else 0.0
        out[v] = dict(degree=(deg_in[v] + deg_out[v]) / (n - 1), in_degree=deg_in[v] / (n - 1),
                      out_degree=deg_out[v] / (n - 1), closeness=close, betweenness=bc[v] * scale)
    return out


def py_eigen(edges, max_iter=100, tol=1e-6):
    nodes = sorted({x for e in edges for x in e})
    simple = set(edges)
    x = {v: 1.0 / len(nodes) for v in nodes}
    for it in range(1, max_iter + 1):
        last = x
        x = dict(last)
        for s, r in simple:
            x[r] += last[s]
        norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
        x = {k: v / norm for k, v in x.items()}
        if sum(abs(x[v] - last[v]) for v in nodes) < len(nodes) * tol:
            return x, True
    return {v: 0.0 for v in nodes}, False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_centralities_match_brandes(spark, seed):
    edges = random_edges(seed)
    expect = py_centralities(edges)
    table, eig = C.centrality_table(frame(spark, edges).select("sender", "receiver"), digits=None)
    got = {r["node"]: r.asDict() for r in table.collect()}
    assert set(got) == set(expect)
    for v, exp in expect.items():
        for k, val in exp.items():
            assert got[v][k] == pytest.approx(val, abs=1e-12), (v, k)
    ex, conv = py_eigen(edges)
    assert eig.converged == conv
    for v, val in ex.items():
        assert got[v]["eigenvector"] == pytest.approx(val, abs=1e-9)


def test_source_batches_give_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(C, "SOURCES", 4)
    monkeypatch.setattr(C, "MASKS", 2)
    monkeypatch.setattr(C, "LANES", 3)
    edges = random_edges(7, n=15, m=40)
    g = frame(spark, edges).select("sender", "receiver")
    nodes = G.node_list(g)
    n = nodes.count()
    one = C.path_centralities(g, nodes, n)
    many = C.path_centralities(g, nodes, n, state_budget=1)   # a block a turn
    a = {r[0]: r[1] for r in one.betweenness.collect()}
    b = {r[0]: r[1] for r in many.betweenness.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    a = {r[0]: r[1] for r in one.closeness.collect()}
    b = {r[0]: r[1] for r in many.closeness.collect()}
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_search_states_do_not_move(spark, monkeypatch):
    """What is shuffled is the arcs for every part and a row a node and part, whatever the number of sources and levels."""
    from murmuration.operators import searches
    seen = {}

    def deal(parts, search, schema, arcs, nodes=None):
        out = searches.deal(parts, search, schema, arcs, nodes)
        seen[schema.split()[2]] = (parts, arcs.count(), out.count())
        return out
    monkeypatch.setattr(C, "deal", deal)
    monkeypatch.setattr(C, "LANES", 2)
    monkeypatch.setattr(C, "SOURCES", 2)
    monkeypatch.setattr(C, "MASKS", 1)
    ring = [(i, f"n{i:02d}", f"n{(i + 1) % 40:02d}") for i in range(40)] + [(40, "n00", "n20")]
    g = spark.createDataFrame(ring, "post_id long, sender string, receiver string").select("sender", "receiver")
    got = C.path_centralities(g, G.node_list(g), 40)
    assert all(r.closeness > 0 for r in got.closeness.collect()) and got.betweenness.count() == 40
    assert len(seen) == 2
    for parts, arcs, rows in seen.values():
        assert parts > 1 and arcs == 41 and rows <= parts * 40


def test_parts_in_one_task_search_all_their_blocks(spark):
    """Rows of several parts may meet in a task: arcs count once, blocks of all its parts are searched."""
    from murmuration.operators import searches
    search = searches.count_arrivals(1, 1)
    arcs = {"sender": [0, 1, 2], "receiver": [1, 2, 0]}
    import numpy as np
    got = {c: np.array(x) for c, x in arcs.items()}
    node, r, s, far = search(got, lambda block: block in (0, 2))
    assert dict(zip(node.tolist(), zip(r.tolist(), s.tolist(), far.tolist()))) == {0: (1, 1, 1), 1: (2, 3, 2), 2: (1, 2, 2)}
    rows = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "sender long, receiver long")
    whole = searches.deal(3, search, "node long, r long, s long, far long", rows).groupBy("node").sum("r", "s").collect()
    assert sorted(tuple(r) for r in whole) == [(0, 2, 3), (1, 2, 3), (2, 2, 3)]


def test_eigenvector_failure_gives_zeros(spark):
    # a directed path never converges from the uniform start
    edges = [(f"p{i}", f"p{i + 1}") for i in range(30)]
    g = frame(spark, edges).select("sender", "receiver")
    nodes = G.node_list(g)
    eig = C.eigenvector_centrality(g, nodes, nodes.count(), max_iter=5, shift=False)
    assert not eig.converged
    assert {r[0] for r in eig.scores.select("eigenvector").distinct().collect()} == {0.0}


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"a{rnd.randrange(40)}", f"a{rnd.randrange(40)}") for _ in range(30)]
    edges += [(f"z{i}", f"z{i + 1}") for i in range(25)]          # a long chain
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for s, r in edges:
        a, b = find(s), find(r)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups = {}
    for v in {x for e in edges for x in e}:
        groups.setdefault(find(v), []).append(v)
    expect = {v: min(vs) for vs in groups.values() for v in vs}
    got = {r["node"]: r["component"] for r in CC.connected_components(frame(spark, edges)).collect()}
    assert got == expect


def test_transitivity_brute_force(spark):
    edges = random_edges(11, n=10, m=45)
    simple = {(s, r) for s, r in edges if s != r}
    succ = {}
    for s, r in simple:
        succ.setdefault(s, set()).add(r)
    num = sum(len(succ.get(v, set()) & succ.get(w, set())) for v in succ for w in succ[v])
    den = sum(len(s) * (len(s) - 1) for s in succ.values())
    got = G.transitivity(frame(spark, edges)).first()[0]
    assert got == pytest.approx(num / den if num else 0.0, abs=1e-12)


def test_density_golden_value(spark):
    # saved run of the reference: 312 nodes, 588 edges -> 0.6059856542171654 %
    n, m = 312, 588
    edges = [(f"u{i % n}", f"u{(i * 7 + 1) % n}") for i in range(m)]
    edges[:n] = [(f"u{i}", f"u{(i + 1) % n}") for i in range(n)]
    size = G.network_size(frame(spark, edges)).first()
    assert (size["nodes"], size["edges"]) == (n, m)
    assert size["density_pct"] == pytest.approx(0.6059856542171654, rel=1e-15)


def test_edge_weights_occurrence_form(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "a"), ("a", "a")]
    got = sorted((r.sender, r.receiver, r.weight) for r in G.edge_weights(frame(spark, edges)).collect())
    assert got == [("a", "a", 1), ("a", "b", 2), ("a", "b", 2), ("b", "a", 1)]


def test_degree_counts_repeats_and_self_loops(spark):
    g = frame(spark, [("a", "b"), ("a", "b"), ("c", "c")]).select("sender", "receiver")
    nodes = G.node_list(g)
    got = {r.node: r.degree for r in C.degree_centrality(g, nodes, 3).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_hub_holding_a_third_of_the_edges(spark):
    # one account is the receiver of a third of all mentions (and sends some)
    rnd = random.Random(21)
    edges = [(f"n{rnd.randrange(20)}", f"n{rnd.randrange(20)}") for _ in range(60)]
    edges += [(f"n{rnd.randrange(20)}", "hub") for _ in range(25)] + [("hub", f"n{i}") for i in range(0, 20, 4)]
    expect = py_centralities(edges)
    table, _ = C.centrality_table(frame(spark, edges).select("sender", "receiver"), digits=None)
    got = {r["node"]: r.asDict() for r in table.collect()}
    for v, exp in expect.items():
        for k, val in exp.items():
            assert got[v][k] == pytest.approx(val, abs=1e-12), (v, k)
    w = {(r.sender, r.receiver): r.weight for r in G.edge_weights(frame(spark, edges)).collect()}
    assert sum(1 for e in edges if e[1] == "hub") == sum(v for (s, r), v in w.items() if r == "hub")


def test_leaves_and_twins_are_folded_exactly(spark):
    """50 random graphs, in one table of as many components, with leaves of all kinds, twins on and off cycles, chains and pairs."""
    rnd = random.Random(8)
    edges = []
    for g in range(50):
        n = rnd.randrange(1, 7)
        own = [(f"g{g}c{rnd.randrange(n)}", f"g{g}c{rnd.randrange(n)}") for _ in range(rnd.randrange(1, 12))]
        for i in range(rnd.randrange(7)):       # leaves: senders, receivers, both
            a, b = f"g{g}leaf{i}", f"g{g}c{rnd.randrange(n)}"
            own += rnd.choice([[(a, b)], [(b, a)], [(a, b), (b, a)]])
        twin = own[rnd.randrange(len(own))][0]
        for i in range(rnd.randrange(4)):       # copies of one account
            own += [(f"g{g}twin{i}" if s == twin else s, f"g{g}twin{i}" if r == twin else r) for s, r in own if twin in (s, r) and s != r and "twin" not in s + r]
        edges += own
    edges += [("p0", "p1"), ("q0", "q1"), ("q1", "q0"), ("s0", "s0")]
    g = frame(spark, edges).select("sender", "receiver")
    nodes = G.node_list(g)
    got = C.path_centralities(g, nodes, nodes.count())
    expect = py_centralities(edges)
    betweenness = {r[0]: r[1] for r in got.betweenness.collect()}
    closeness = {r[0]: r[1] for r in got.closeness.collect()}
    assert betweenness.keys() == closeness.keys() == expect.keys()
    for v, exp in expect.items():
        assert betweenness[v] == pytest.approx(exp["betweenness"], rel=1e-9, abs=1e-15), v
        assert closeness[v] == pytest.approx(exp["closeness"], rel=1e-12), v
    ids, e = C._prepared(g, nodes, None)
    core = C.reduce_graph(C._adjacency(e))
    assert core.nodes.count() < 0.8 * len(expect)


def test_path_centralities_of_an_empty_graph(spark):
    g = spark.createDataFrame([], "sender string, receiver string")
    nodes = G.node_list(g)
    got = C.path_centralities(g, nodes, 0)
    assert got.betweenness.collect() == got.closeness.collect() == []


def test_dyad_substring_mode_matches_regex_over_the_list(spark):
    import re
    edges = [("a", "user1"), ("a", "user12"), ("ba", "user1"), ("a", "user1"), ("xa", "user123"), ("b", "u")]
    dyads = [s + ";" + r for s, r in edges]
    expect = {(s, r): len(re.findall(s + ";" + r, str(dyads))) for s, r in edges}
    got = {(r.sender, r.receiver): r.weight for r in G.dyad_substring_counts(frame(spark, edges)).collect()}
    assert got == expect


def test_undirected_transitivity_brute_force(spark):
    from itertools import combinations
    edges = random_edges(13, n=11, m=40)
    und = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    nb = {}
    for a, b in und:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    tri = sum(1 for a, b, c in combinations(sorted(nb), 3) if b in nb[a] and c in nb[a] and c in nb[b])
    triples = sum(len(v) * (len(v) - 1) / 2 for v in nb.values())
    got = G.transitivity(frame(spark, edges), directed=False).first()[0]
    assert got == pytest.approx(3 * tri / triples if tri else 0.0, abs=1e-12)


def test_star_of_a_hub_is_not_gathered(spark, monkeypatch):
    """A hub with most of the edges, smallest, largest and in the middle, beside chains: labels, and rows of any task after the join."""
    from murmuration.operators import skew
    for hub, heavy in ((0, 100), (500_000, skew.HEAVY)):
        monkeypatch.setattr(skew, "HEAVY", heavy)
        star = spark.range(1, 40_001).select(F.lit(hub).cast("long").alias("u"), (F.col("id") * 10 + 3).alias("v"))
        chain = spark.range(0, 40).select((F.col("id") + 3_000_000).alias("u"), (F.col("id") + 3_000_001).alias("v"))
        got = CC.star_components(star.union(chain)).groupBy("label").agg(F.count("node").alias("n"), F.countDistinct("node").alias("d")).collect()
        assert sorted(tuple(r) for r in got) == sorted([(min(hub, 13), 40_001, 40_001), (3_000_000, 41, 41)])
    monkeypatch.setattr(skew, "HEAVY", 100)
    e = star.repartition(8, "v")
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("deg"))
    rows = skew.join_heavy(e, low, "u", "deg", 40_000).groupBy(F.spark_partition_id()).count().select("count")
    most = [r[0] for r in rows.collect()]
    assert len(most) >= 8 and max(most) <= 3 * sorted(most)[len(most) // 2]


def test_join_heavy_equals_a_join(spark, monkeypatch):
    from murmuration.operators import skew
    monkeypatch.setattr(skew, "HEAVY", 4)
    rows = spark.createDataFrame([(k, i) for k, c in ((1, 50), (2, 3), (3, 1), (9, 2)) for i in range(c)], "k long, i long")
    table = spark.createDataFrame([(1, "a", 50), (2, "b", 3), (3, None, 1), (4, "d", 1)], "k long, x string, n long")
    for how in ("inner", "left"):
        got = skew.join_heavy(rows, table, "k", "n", 56, how).select("k", "i", "x").collect()
        want = rows.join(table.drop("n"), "k", how).select("k", "i", "x").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_arcs_are_packed_as_sorted_ints(spark):
    """Every part gets a copy of the arcs: small numbers travel as ints, in order; large ones stay longs."""
    from murmuration.operators import searches
    rows = spark.createDataFrame([(5, 1 << 40), (3, -7), (3, -9)], "sender long, receiver long")
    packed = searches._packed(rows)
    assert dict(packed.dtypes) == {"sender": "array<int>", "receiver": "array<bigint>"}
    assert [tuple(r) for r in packed.collect()] == [([3, 3, 5], [-9, -7, 1 << 40])]
    assert searches._packed(rows.filter("sender > 9")).count() == 0


def test_gather_adds_every_arc_once(monkeypatch):
    """Few, most and all heads wanted, a hub with far more arcs than others, blocks of a few heads."""
    import numpy as np
    from murmuration.operators import searches
    monkeypatch.setattr(searches, "CHUNK_BYTES", 64)
    monkeypatch.setattr(searches, "NARROW", 2)
    rng = np.random.default_rng(1)
    pairs = np.unique(np.concatenate((rng.integers(0, 20, (60, 2)), [(i, 19) for i in range(20)])), axis=0)
    arcs = searches.Arcs(pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), 22)
    for some in (1, 4, 12, 22):
        for wanted in (1, 9, 22):
            tails, heads = np.arange(22) < some, np.arange(22) >= 22 - wanted
            rows = rng.integers(1, 9, (22, 2)).astype(np.float64) * tails[:, None]
            expect = np.zeros_like(rows)
            np.add.at(expect, pairs[:, 1], rows[pairs[:, 0]])
            assert (arcs.gather(np.add, rows, tails, heads)[heads] == expect[heads]).all()


def test_eigenvector_steps_are_planned_anew(spark, capsys):
    e = frame(spark, random_edges(3))
    nodes = G.node_list(e)
    scores = C.eigenvector_centrality(e, nodes, nodes.count(), iterations=8).scores
    assert abs(sum(r["eigenvector"] ** 2 for r in scores.collect()) - 1) < 1e-9
    capsys.readouterr()
    scores.explain(mode="cost")
    # the planner's sizes: a chain of products doubles its digits with every step
    assert max([int(x) for x in re.findall(r"E\+(\d+)", capsys.readouterr().out)], default=0) < 100
