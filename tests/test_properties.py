"""Invariants on random graphs (few examples: every example runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from murmuration.operators import centrality as C
from murmuration.operators import components as CC
from murmuration.operators import graph as G
from murmuration.operators import ranking as R

names = st.sampled_from([f"h{i}" for i in range(9)])
edge_lists = st.lists(st.tuples(names, names), min_size=1, max_size=25)
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, edges):
    return spark.createDataFrame(edges, "sender string, receiver string")


@SETTINGS
@given(edges=edge_lists)
def test_degree_and_closeness_invariants(spark, edges):
    g = frame(spark, edges)
    nodes = G.node_list(g)
    n = nodes.count()
    deg = C.degree_centrality(g, nodes, n)
    if n > 1:
        total_in = deg.agg(F.sum(F.col("in_degree") * (n - 1))).first()[0]
        assert round(total_in) == len(edges)             # sum of in-degrees = edges
    close = C.path_centralities(g, nodes, n).closeness
    assert all(0.0 <= r.closeness <= 1.0 + 1e-12 for r in close.collect())


@SETTINGS
@given(edges=edge_lists)
def test_components_partition_the_nodes(spark, edges):
    comp = CC.connected_components(frame(spark, edges)).collect()
    nodes = {x for e in edges for x in e}
    assert {r.node for r in comp} == nodes and len(comp) == len(nodes)
    label = {r.node: r.component for r in comp}
    assert all(label[s] == label[r] for s, r in edges)   # both ends of an edge share a component
    assert all(label[v] <= v for v in nodes)             # the label is the smallest member


@SETTINGS
@given(scores=st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_percentile_is_monotone(spark, scores):
    df = spark.createDataFrame([(f"n{i}", float(s)) for i, s in enumerate(scores)], "node string, score double")
    rows = sorted((r.score, r.pct) for r in R.percentile_rank(df).collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert rows[-1][1] == 100.0 or rows.count(rows[-1]) > 1 or len(rows) == 1
