"""Weakly connected components by large-star / small-star contraction.

Each round rewires every node to the smallest label in its neighbourhood
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014); the
edge set shrinks to stars around the smallest node of each component in
O(log^2 n) rounds. Everything is joins and group-bys on edge tables; no
neighbour list is ever collected.

A hub's edges do not meet in one task: its smallest neighbour is found with
map-side partial minima, and the edges of the heaviest nodes (a bounded
number, ``skew.HEAVY``) get it by broadcast, where they lie; only the edges
of the other nodes are shuffled to theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.graph import node_list
from murmuration.operators.skew import join_heavy
from murmuration.session import cut_lineage

EDGES_PER_PARTITION = 100_000


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    """Every node's larger neighbours are linked with the smallest node around it."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
    up = join_heavy(both, low, "u", "deg", 2 * edges).filter(F.col("v") > F.col("u"))
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of these (v < u in every edge)."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
    moved = join_heavy(e, low, "u", "deg", edges).filter(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()


def star_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (u, v): label is the smallest node of its component.

    Alternating large and small stars, one checkpoint a round, until a round
    changes nothing. Nodes may have any ordered type; longs are fastest.
    """
    e = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut_lineage(e)

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
    was = mark(e)
    # the edges only get fewer: as many partitions as the first count asks for
    parts = 1 + was[0] // EDGES_PER_PARTITION
    while was[0]:
        star = _large_star(e.coalesce(parts), was[0]).coalesce(parts)
        e = cut_lineage(_small_star(star, was[0]).coalesce(parts))
        now = mark(e)
        if now == was:
            break
        was = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def connected_components(graph: DataFrame) -> DataFrame:
    """(node, component) with component = smallest handle of the component.

    Rounds run on dense long ids assigned in handle order, so the smallest id
    of a component is also its smallest handle.
    """
    from murmuration.operators.centrality import dense_ids, id_graph
    graph = cut_lineage(graph.select("sender", "receiver"))   # read three times below
    ids = dense_ids(node_list(graph))
    g = id_graph(graph.select("sender", "receiver"), ids)
    found = star_components(g.select(F.col("sender").alias("u"), F.col("receiver").alias("v")))
    label = cut_lineage(ids.join(found.withColumnRenamed("node", "vid"), "vid", "left")
                .select("node", F.coalesce(F.col("label"), F.col("vid")).alias("lbl")))
    # names: one row per component, which may have most of the nodes
    sizes = label.groupBy("lbl").agg(F.count(F.lit(1)).alias("n"))
    names = cut_lineage(sizes.join(ids.select(F.col("vid").alias("lbl"), F.col("node").alias("component")), "lbl"))
    return join_heavy(label, names, "lbl", "n", ids.count()).select("node", "component")


def largest_component(components: DataFrame) -> DataFrame:
    """Label and size of the component with most nodes; ties -> smallest label."""
    return (components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
                      .orderBy(F.col("size").desc(), F.col("component")).limit(1))
