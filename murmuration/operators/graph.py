"""Mention networks as edge tables.

An edge table has one row per mention: (post_id, pos, sender, receiver).
The multigraph is that table; the simple graph is its distinct
(sender, receiver) pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions import text as T
from murmuration.session import cut_lineage


def mention_edges(posts: DataFrame, selfloop: bool = False) -> DataFrame:
    """G1/F8: author -> every handle after an ``@`` in the lower-cased text.

    Posts without a mention are dropped, or become ``author -> author`` when
    ``selfloop`` is set.
    """
    p = posts.select("post_id", F.lower("author").alias("sender"),
                     T.extract_mentions(F.lower("text")).alias("_m"))
    if selfloop:
        p = p.withColumn("_m", F.when(F.size("_m") == 0, F.array("sender")).otherwise(F.col("_m")))
    return p.select("post_id", "sender", F.posexplode("_m").alias("pos", "receiver")) \
            .select("post_id", F.col("pos").cast("long").alias("pos"), "sender", "receiver")


def simple_graph(edges: DataFrame) -> DataFrame:
    """G2 (simple): repeated mentions collapse to one directed edge."""
    return edges.select("sender", "receiver").distinct()


def build_graph(edges: DataFrame, multi: bool = True) -> DataFrame:
    """The multigraph keeps repeats, the simple graph drops them."""
    return edges.select("sender", "receiver") if multi else simple_graph(edges)


def node_list(edges: DataFrame) -> DataFrame:
    """Distinct handles over both ends."""
    return (edges.select(F.col("sender").alias("node"))
                 .union(edges.select(F.col("receiver").alias("node"))).distinct())


def dyad_counts(edges: DataFrame) -> DataFrame:
    """A2 (grouped): repeats of each (sender, receiver); partial aggregation map-side."""
    return edges.groupBy("sender", "receiver").agg(F.count(F.lit(1)).alias("weight"))


def dyad_substring_counts(edges: DataFrame) -> DataFrame:
    """A2 (``match='substring'``): the reference counted the pattern ``s;r``
    in the list of all ``S;R`` dyads, i.e. edges whose sender ends with ``s``
    and whose receiver starts with ``r``. Exact: the handles that end (start)
    with another handle are found once per distinct handle (``_affixes``),
    dyads follow by equi-joins; no pair of dyads is compared.
    """
    d = dyad_counts(edges)
    ends = _affixes(d.select(F.col("sender").alias("handle")).distinct(), suffix=True)
    starts = _affixes(d.select(F.col("receiver").alias("handle")).distinct(), suffix=False)
    by_sender = d.join(ends.select(F.col("handle").alias("sender"), F.col("affix").alias("s")), "sender")
    # summed before receivers fan out: one row of each (s, receiver)
    by_sender = by_sender.groupBy("s", "receiver").agg(F.sum("weight").alias("weight"))
    hits = (by_sender.join(starts.select(F.col("handle").alias("receiver"), F.col("affix").alias("r")), "receiver")
                     .groupBy("s", "r").agg(F.sum("weight").alias("weight")))
    return (d.select(F.col("sender").alias("s"), F.col("receiver").alias("r"))
             .join(hits, ["s", "r"])
             .select(F.col("s").alias("sender"), F.col("r").alias("receiver"), F.col("weight").cast("long").alias("weight")))


def _affixes(handles: DataFrame, suffix: bool) -> DataFrame:
    """(handle, affix): the distinct ``handles`` that end (start) with another or the same one.

    Only affixes of a length that some handle has are hashed; handles that
    meet by hash are confirmed on their text.
    """
    own = cut_lineage(handles.select("handle", F.length("handle").alias("len"), F.xxhash64("handle").alias("h")))
    lengths = own.agg(F.sort_array(F.collect_set("len")).alias("lengths"))     # one row
    part = (lambda k: F.substring("handle", F.col("len") - k + 1, k)) if suffix else (lambda k: F.substring("handle", F.lit(1), k))
    some = F.transform(F.filter("lengths", lambda k: k <= F.col("len")), lambda k: F.struct(k.alias("k"), F.xxhash64(part(k)).alias("h")))
    cut = own.crossJoin(F.broadcast(lengths)).select("handle", F.explode(some).alias("a")).select("handle", "a.k", "a.h")
    met = cut.join(own.select(F.col("handle").alias("affix"), F.col("len").alias("k"), "h"), ["k", "h"])
    return met.filter(F.endswith("handle", "affix") if suffix else F.startswith("handle", "affix")).select("handle", "affix")


def edge_weights(edges: DataFrame, match: str = "exact") -> DataFrame:
    """A2 (occurrence form): every edge row carries the total of its dyad.

    Aggregate first, then join back: a hot dyad is pre-aggregated before the
    shuffle and its join side is split by AQE's skew handling, whereas a
    window partitioned by the dyad would put all its rows into one task.
    ``match='substring'`` uses the reference's over-counting rule.
    """
    if match == "exact":
        totals = dyad_counts(edges)
    elif match == "substring":
        totals = dyad_substring_counts(edges)
    else:
        raise ValueError(match)
    return edges.join(totals, ["sender", "receiver"])


def network_size(graph: DataFrame) -> DataFrame:
    """Nodes, edges (parallel edges count), density in %, self-loops."""
    nodes = node_list(graph).agg(F.count(F.lit(1)).alias("nodes"))
    e = graph.agg(F.count(F.lit(1)).alias("edges"),
                  F.count_if(F.col("sender") == F.col("receiver")).alias("self_loops"))
    n, m = F.col("nodes"), F.col("edges")
    density = F.when(n > 1, m / (n * (n - 1)) * 100.0).otherwise(F.lit(0.0))
    return nodes.crossJoin(e).select(n.cast("long").alias("nodes"), m.cast("long").alias("edges"),
                                     density.alias("density_pct"),
                                     F.col("self_loops").cast("long").alias("self_loops"))


def to_undirected(graph: DataFrame) -> DataFrame:
    """Unordered pairs ``(a <= b)``, duplicates removed."""
    return graph.select(F.least("sender", "receiver").alias("a"),
                        F.greatest("sender", "receiver").alias("b")).distinct()


def transitivity(graph: DataFrame, directed: bool = True) -> DataFrame:
    """Transitivity of the simple graph, one row.

    ``directed=False`` gives the canonical undirected value,
    3 x triangles / connected triples, on the graph without direction.

    sum over v, and w in succ(v), of |succ(v) & succ(w)| divided by
    sum over v of d(v)(d(v)-1), with succ() excluding the node itself.
    The numerator counts transitive triads (v->w, v->x, w->x). They are
    found from undirected triangles enumerated at the lowest-ranked corner
    (rank = degree, then name), which bounds the candidate pairs per node by
    sqrt(2m) instead of pairing all neighbours of a hub.
    """
    # both are read several times below: materialise each once
    e = cut_lineage(simple_graph(graph).filter(F.col("sender") != F.col("receiver")))
    out_deg = e.groupBy(F.col("sender").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    denom = out_deg.agg(F.sum(F.col("d") * (F.col("d") - 1)).alias("denom"))

    und = to_undirected(e)
    deg = (und.select(F.col("a").alias("v")).union(und.select(F.col("b").alias("v")))
              .groupBy("v").agg(F.count(F.lit(1)).alias("deg")))
    ranked = (und.join(deg.withColumnRenamed("v", "a").withColumnRenamed("deg", "da"), "a")
                 .join(deg.withColumnRenamed("v", "b").withColumnRenamed("deg", "db"), "b"))
    a_first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    # oriented: lo -> hi, lo has the lower (degree, name) rank
    oriented = ranked.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("lo"),
                             F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("hi"),
                             F.when(a_first, F.struct(F.col("db").alias("d"), F.col("b").alias("n")))
                              .otherwise(F.struct(F.col("da").alias("d"), F.col("a").alias("n"))).alias("hi_rank"))
    oriented = cut_lineage(oriented)
    x = oriented.alias("x")
    y = oriented.alias("y")
    wedges = (x.join(y, (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi_rank") < F.col("y.hi_rank")))
               .select(F.col("x.lo").alias("p"), F.col("x.hi").alias("q"), F.col("y.hi").alias("r")))
    closing = oriented.select(F.col("lo").alias("q"), F.col("hi").alias("r"))
    closing2 = oriented.select(F.col("hi").alias("q"), F.col("lo").alias("r"))
    triangles = wedges.join(closing.unionByName(closing2), ["q", "r"])
    if not directed:
        tri_n = triangles.agg(F.count(F.lit(1)).alias("t"))
        triples = deg.agg(F.sum(F.col("deg") * (F.col("deg") - 1) / 2).alias("c"))
        value = F.when(F.coalesce(F.col("t"), F.lit(0)) == 0, F.lit(0.0)).otherwise(3 * F.col("t") / F.col("c"))
        return tri_n.crossJoin(triples).select(value.cast("double").alias("transitivity"))
    # Count the ordered triples (v, w, x) of each triangle with v->w, v->x, w->x:
    # its six directed pairs are looked up in the edge table with one join,
    # and the pairs found are folded into a 6-bit mask per triangle.
    pairs = [("p", "q"), ("q", "p"), ("p", "r"), ("r", "p"), ("q", "r"), ("r", "q")]
    tri = triangles.select("p", "q", "r")
    probes = tri.select("p", "q", "r", F.explode(F.array(*[
        F.struct(F.col(a).alias("s"), F.col(b).alias("t"), F.lit(1 << k).alias("bit"))
        for k, (a, b) in enumerate(pairs)])).alias("pr")).select("p", "q", "r", "pr.*")
    found = probes.join(e.select(F.col("sender").alias("s"), F.col("receiver").alias("t")), ["s", "t"], "left_semi")
    masks = found.groupBy("p", "q", "r").agg(F.sum("bit").alias("mask"))
    bit = {a + b: (F.shiftright(F.col("mask"), k) % 2) for k, (a, b) in enumerate(pairs)}
    perms = [("p", "q", "r"), ("p", "r", "q"), ("q", "p", "r"), ("q", "r", "p"), ("r", "p", "q"), ("r", "q", "p")]
    triads = sum((bit[v + w] * bit[v + x] * bit[w + x] for v, w, x in perms), F.lit(0))
    tri = masks
    num = tri.agg(F.sum(triads).alias("num"))
    ratio = F.when(F.coalesce(F.col("num"), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("num") / F.col("denom"))
    return num.crossJoin(denom).select(ratio.cast("double").alias("transitivity"))
