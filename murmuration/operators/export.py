"""Graph export for drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.privacy import is_hidden
from murmuration.operators.components import connected_components, largest_component
from murmuration.operators.graph import dyad_counts, node_list
from murmuration.operators.ranking import sequential_ids
from murmuration.session import cut_lineage

NODE_SIZE = 10


def largest_component_edges(edges: DataFrame, given: str) -> DataFrame:
    """Edges whose two ends lie in the largest weak component or are the given account."""
    comp = connected_components(edges.select("sender", "receiver"))
    lcc = largest_component(comp).select("component")
    keep = (comp.join(F.broadcast(lcc), "component").select("node")    # one row
                .union(node_list(edges).filter(F.col("node") == given)).distinct())
    s = keep.select(F.col("node").alias("sender"))
    r = keep.select(F.col("node").alias("receiver"))
    return edges.join(s, "sender", "left_semi").join(r, "receiver", "left_semi")


def export_graph(edges: DataFrame, given: str, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name, group, size) and (links: source, target, value).

    Ids are 0-based in handle order with the given account last (W5);
    pseudonymised names are blanked (P17); group 2 = hidden, 3 = given,
    1 = other (P16); value = repeats of the dyad, one row per edge (A2).
    """
    # read three times below (ids, weights, links): materialise once
    kept = cut_lineage(largest_component_edges(edges, given))
    ids = sequential_ids(node_list(kept), given)
    hidden = is_hidden(F.col("node"))
    nodes = ids.select("id", F.when(hidden, F.lit(" ")).otherwise(F.col("node")).alias("name"),
                       F.when(hidden, F.lit(2)).when(F.col("node") == given, F.lit(3)).otherwise(F.lit(1))
                        .cast("long").alias("group"),
                       F.lit(NODE_SIZE).cast("long").alias("size"))
    w = dyad_counts(kept) if weighted else kept.select("sender", "receiver").distinct().withColumn("weight", F.lit(1))
    src = ids.select(F.col("node").alias("sender"), F.col("id").alias("source"))
    dst = ids.select(F.col("node").alias("receiver"), F.col("id").alias("target"))
    links = (kept.join(w, ["sender", "receiver"]).join(src, "sender").join(dst, "receiver")
                 .select("source", "target", F.col("weight").cast("long").alias("value")))
    return nodes, links


def node_style(nodes: DataFrame, given: str, handle: str = "node") -> DataFrame:
    """Colour, size and a 15-character label per node."""
    g = F.col(handle) == given
    return nodes.select(handle,
                        F.when(g, F.lit("#FF0000")).otherwise(F.lit("#23b7ce")).alias("colour"),
                        F.when(g, F.lit(250)).otherwise(F.lit(35)).cast("long").alias("draw_size"),
                        F.substring(F.col(handle), 1, 15).alias("label"))
