"""Node centralities over edge tables.

Degree measures are one aggregation. Closeness is a bit-parallel breadth-first
search from all accounts. Betweenness folds leaves, merges twins and runs
Brandes' algorithm on the core. Blocks of sources are dealt to tasks, whose
states (sources x nodes) never move (``searches.py``), and the tasks' sums are
added, so the results stay exact. Eigenvector centrality is a power iteration
of join + sum, every round stored as files and read back.
All sizes take the same path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.operators.graph import node_list, simple_graph
from murmuration.operators.searches import count_arrivals, count_paths, deal, parts_of
from murmuration.operators.skew import join_heavy
from murmuration.session import cut_lineage, settle

METRICS = ("degree", "in_degree", "out_degree", "closeness", "betweenness", "eigenvector")

# numbers (masks or doubles, one a node) per core that a table of a search may
# hold; the session setting gives the numbers of all cores together.
PAIRS_PER_CORE = 16_000_000
STATE_BUDGET_CONF = "spark.murmuration.bfs.stateBudget"


def state_budget_of(spark, given: int | None = None) -> int:
    if given is not None:
        return given
    cores = spark.sparkContext.defaultParallelism
    return int(spark.conf.get(STATE_BUDGET_CONF, str(PAIRS_PER_CORE * max(cores, 1))))


def _per_task(spark, nodes: int, budget: int) -> int:
    """Columns of a table over ``nodes`` that a task may hold."""
    return max(1, budget // max(spark.sparkContext.defaultParallelism, 1) // max(nodes, 1))


def significant(x: Column, digits: int) -> Column:
    """``x`` with its first ``digits`` significant digits, at any magnitude."""
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def _count(df: DataFrame) -> int:
    return int(df.count())


def degree_centrality(graph: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(in + out) / (n - 1), in / (n - 1), out / (n - 1); all 1 when n <= 1.

    On the multigraph every repeat counts and a self-loop adds one in and one
    out. One shuffle: each edge is split into its two endpoint rows first.
    """
    ends = graph.select(F.explode(F.array(
        F.struct(F.col("sender").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("receiver").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    ).select("e.*")
    counts = ends.groupBy("node").agg(F.sum("o").alias("out_n"), F.sum("i").alias("in_n"))
    def norm(c):
        return F.lit(1.0) if n <= 1 else F.coalesce(c, F.lit(0)) / F.lit(float(n - 1))

    return (nodes.join(counts, "node", "left")
                 .select("node", norm(F.col("in_n") + F.col("out_n")).alias("degree"),
                         norm(F.col("in_n")).alias("in_degree"), norm(F.col("out_n")).alias("out_degree")))


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(node, vid): 0-based long ids in handle order, assigned without a
    single-task window. Iterative rounds join and group on these longs
    instead of on handles (some are 64-character pseudonyms)."""
    from murmuration.operators.ordering import row_number0
    return cut_lineage(row_number0(nodes.select("node"), [F.col("node")], "vid"))


def id_graph(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """The edge table with both ends replaced by their long id."""
    s = ids.select(F.col("node").alias("sender"), F.col("vid").alias("_s"))
    r = ids.select(F.col("node").alias("receiver"), F.col("vid").alias("_r"))
    return graph.join(s, "sender").join(r, "receiver").select(F.col("_s").alias("sender"), F.col("_r").alias("receiver"))


def _adjacency(graph: DataFrame) -> DataFrame:
    """Simple graph without self-loops (they never shorten a path)."""
    return simple_graph(graph).filter(F.col("sender") != F.col("receiver"))


SOURCES = 64       # sources of a bit mask
MASKS = 8          # masks of a block of the reachability search
LANES = 16         # sources of a block of path counts


def arrivals(adj: DataFrame, nodes: int, budget: int) -> DataFrame:
    """(node, r, s, far): how many other nodes reach a node, the sum and the largest of their distances; nodes that none reaches may be missing.

    A bit-parallel breadth-first search from every node with edges out, in
    blocks of MASKS * SOURCES sources that are dealt to tasks.
    """
    masks = min(MASKS, _per_task(adj.sparkSession, nodes, budget))
    parts = parts_of(adj.sparkSession, -(-nodes // (SOURCES * masks)))
    got = deal(parts, count_arrivals(SOURCES, masks), "node long, r long, s long, far long", adj.select("sender", "receiver"))
    return cut_lineage(got.groupBy("node").agg(F.sum("r").alias("r"), F.sum("s").alias("s"), F.max("far").alias("far")))


@dataclass
class Core:
    """What is left of a graph when leaves are folded and twins merged.

    ``nodes``: (node, idx, m, k, e, rec) of each class of twins, named by its
    smallest member: ``m`` members, each with ``k`` folded accounts that reach
    it, ``e`` that it reaches and ``rec`` that are both. ``adj``: its edges.
    ``member``: (member, node) of every account that was not folded.
    """

    nodes: DataFrame
    adj: DataFrame
    member: DataFrame


def reduce_graph(adj: DataFrame) -> Core:
    """Folds the accounts with one neighbour and merges accounts with equal neighbours.

    An account whose only neighbour has other neighbours hangs on it and is
    never between two others. Of the rest, accounts with the same in- and
    out-neighbours, and as many folded accounts of each kind, are twins: the
    shortest paths through one of them are those through any other.
    Neighbour sets are compared by size and two 64-bit sums of hashes.
    """
    ends = adj.select(F.col("sender").alias("node"), F.col("receiver").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        adj.select(F.col("receiver").alias("node"), F.col("sender").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    around = cut_lineage(ends.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high"), F.max("o").alias("o"), F.max("i").alias("i")))
    leaf = around.filter("low = high").select(F.col("node").alias("leaf"), F.col("low").alias("node"), "o", "i")
    leaf = cut_lineage(leaf.join(around.filter("low != high").select("node"), "node", "left_semi"))
    hung = leaf.groupBy("node").agg(F.sum("o").alias("k"), F.sum("i").alias("e"), F.sum(F.col("o") * F.col("i")).alias("rec"))
    gone = leaf.select(F.col("leaf").alias("node"))
    kept = adj.join(gone.withColumnRenamed("node", "sender"), "sender", "left_anti").join(gone.withColumnRenamed("node", "receiver"), "receiver", "left_anti")
    kept = cut_lineage(kept.select("sender", "receiver"))

    def marks(own: str, other: str, x: str):
        return kept.groupBy(F.col(own).alias("node")).agg(F.struct(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(other)).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), F.col(other))).alias("b")).alias(x))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "a", "b")])
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("k", "e", "rec")]
    stay = around.select("node").join(gone, "node", "left_anti")
    sign = stay.join(hung, "node", "left").join(marks("sender", "receiver", "to"), "node", "left").join(marks("receiver", "sender", "from"), "node", "left")
    sign = cut_lineage(sign.select("node", F.struct(*number, F.coalesce("to", none).alias("to"), F.coalesce("from", none).alias("from")).alias("like")))
    classes = cut_lineage(sign.groupBy("like").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("m")))
    from murmuration.operators.ordering import row_number0
    nodes = cut_lineage(row_number0(classes.select(F.col("rep").alias("node"), "m", "like.k", "like.e", "like.rec"), [F.col("node")], "idx"))
    member = join_heavy(sign, classes, "like", "m", _count(sign)).select(F.col("node").alias("member"), F.col("rep").alias("node"))
    rep = nodes.select("node")
    core = kept.join(rep.withColumnRenamed("node", "sender"), "sender", "left_semi").join(rep.withColumnRenamed("node", "receiver"), "receiver", "left_semi")
    return Core(nodes, cut_lineage(core), member)


def betweenness_sums(adj: DataFrame, budget: int) -> DataFrame:
    """(node, dep): the unscaled betweenness of every account that is between any others, from the reduced graph.

    The search runs on the core, in blocks of LANES sources that are dealt to
    tasks; a folded account's paths are those of what it hangs on, which is
    between it and all that the latter reaches:
    dep(v) = sum over sources s of (members and folded accounts of s) *
    delta_s(v) + k(v) * reached(v) - rec(v).
    """
    core = reduce_graph(adj)
    n = _count(core.nodes)
    lanes = min(LANES, _per_task(adj.sparkSession, n, budget))
    parts = parts_of(adj.sparkSession, -(-n // lanes))
    found = deal(parts, count_paths(lanes), "node long, dep double, reached double", core.adj, core.nodes.select("node", "m", "k", "e"))
    total = cut_lineage(found.groupBy("node").agg(F.sum("dep").alias("dep"), F.sum("reached").alias("reached")))
    dep = core.nodes.join(total, "node", "left")
    whole = F.coalesce("dep", F.lit(0.0)) + F.col("k") * (F.col("e") + F.coalesce("reached", F.lit(0.0))) - F.col("rec")
    dep = dep.select("node", whole.alias("dep"))
    return core.member.join(dep, "node").select(F.col("member").alias("node"), "dep")


@dataclass
class PathStats:
    closeness: DataFrame     # node, closeness
    betweenness: DataFrame   # node, betweenness


def _prepared(graph: DataFrame, nodes: DataFrame, prepared: tuple[DataFrame, DataFrame] | None):
    """(ids, id_edges): handles mapped to dense ids once, reused by every metric."""
    if prepared is not None:
        return prepared
    ids = dense_ids(nodes)
    return ids, cut_lineage(id_graph(graph.select("sender", "receiver"), ids))


def path_centralities(graph: DataFrame, nodes: DataFrame, n: int, want_betweenness: bool = True,
                      state_budget: int | None = None, prepared: tuple[DataFrame, DataFrame] | None = None,
                      want_closeness: bool = True) -> PathStats:
    """G6 closeness (inward distances, Wasserman-Faust scaled) and G7 betweenness; what is not wanted is 0.

    closeness(u) = (r/S) * (r/(n-1)), r = nodes reaching u, S = their summed
    distances, 0 if r = 0. betweenness(v) = sum of pair dependencies scaled
    by 1/((n-1)(n-2)) (no scaling when n <= 2).
    """
    budget = state_budget_of(graph.sparkSession, state_budget)
    ids, id_edges = _prepared(graph, nodes, prepared)
    adj = cut_lineage(_adjacency(id_edges))
    handle = ids.select(F.col("vid").alias("node"), F.col("node").alias("handle"))

    def zeros(name):
        return nodes.select("node", F.lit(0.0).alias(name))

    closeness, betweenness = zeros("closeness"), zeros("betweenness")
    if want_closeness:
        reach = arrivals(adj, n, budget).join(handle, "node").select(F.col("handle").alias("node"), "r", "s")
        r, s = F.col("r").cast("double"), F.col("s").cast("double")
        close = F.when((F.coalesce(s, F.lit(0.0)) > 0) & F.lit(n > 1), (r / s) * (r / F.lit(float(max(n - 1, 1))))).otherwise(F.lit(0.0))
        closeness = nodes.join(reach, "node", "left").select("node", close.alias("closeness"))
    if want_betweenness:
        dep = betweenness_sums(adj, budget).join(handle, "node").select(F.col("handle").alias("node"), "dep")
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        betweenness = nodes.join(dep, "node", "left").select("node", (F.coalesce(F.col("dep"), F.lit(0.0)) * F.lit(scale)).alias("betweenness"))
    return PathStats(closeness, betweenness)


@dataclass
class Eigen:
    scores: DataFrame    # node, eigenvector
    converged: bool
    iterations: int


def eigenvector_centrality(graph: DataFrame, nodes: DataFrame, n: int, max_iter: int = 100,
                           tol: float = 1.0e-6, shift: bool = True, on_failure: str = "zero",
                           iterations: int | None = None,
                           prepared: tuple[DataFrame, DataFrame] | None = None) -> Eigen:
    """Power iteration on in-edges of the simple graph, L2-normalised.

    ``shift`` iterates with A + I (current NetworkX), otherwise A. Stops when
    sum |x - x_prev| < n * tol. Without convergence after ``max_iter``
    steps the scores are zeros (``on_failure='zero'``, the reference's
    fallback) or the last iterate (``'last'``). ``iterations=k`` runs exactly
    k steps with no convergence test.
    """
    if n == 0:
        return Eigen(nodes.select("node", F.lit(0.0).alias("eigenvector")), False, 0)
    ids, id_edges = _prepared(graph, nodes, prepared)
    push = cut_lineage(simple_graph(id_edges).select(F.col("sender").alias("node"), F.col("receiver").alias("to")))
    edges = _count(push)
    out = push.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    # the iterate with each account's out-degree: a hub's value goes to its edges by
    # broadcast, and a hub's inflow is summed where it arises before it is shuffled
    x = cut_lineage(ids.select(F.col("vid").alias("node"), F.lit(1.0 / n).alias("y")).join(out, "node", "left").withColumn("prev", F.lit(0.0)))
    norm = 1.0
    steps = iterations if iterations is not None else max_iter
    converged = False
    done = 0
    for done in range(1, steps + 1):
        value = F.col("y") / F.lit(norm)
        sent = join_heavy(push, x.filter("deg IS NOT NULL").select("node", "deg", value.alias("x")), "node", "deg", edges)
        inflow = sent.groupBy(F.col("to").alias("node")).agg(F.sum("x").alias("inflow"))
        base = value if shift else F.lit(0.0)
        x = settle(x.join(inflow, "node", "left").select(
            "node", "deg", value.alias("prev"), (base + F.coalesce(F.col("inflow"), F.lit(0.0))).alias("y")))
        norm = x.agg(F.sqrt(F.sum(F.col("y") * F.col("y")))).first()[0] or 1.0
        if iterations is None:
            diff = x.agg(F.sum(F.abs(F.col("y") / F.lit(norm) - F.col("prev")))).first()[0]
            if diff is not None and diff < n * tol:
                converged = True
                break
    x = x.select("node", (F.col("y") / F.lit(norm)).alias("x"))
    if iterations is None and not converged and on_failure == "zero":
        return Eigen(nodes.select("node", F.lit(0.0).alias("eigenvector")), False, done)
    scores = x.join(ids.select(F.col("vid").alias("node"), F.col("node").alias("handle")), "node") \
              .select(F.col("handle").alias("node"), F.col("x").alias("eigenvector"))
    return Eigen(scores, converged or iterations is not None, done)


def centrality_table(graph: DataFrame, eigen_graph: DataFrame | None = None,
                     state_budget: int | None = None, digits: int | None = 10,
                     want_betweenness: bool = True, **eigen_kwargs) -> tuple[DataFrame, Eigen]:
    """Node, degree, in_degree, out_degree, closeness, betweenness, eigenvector.

    ``graph`` is the multigraph (degree counts repeats); paths and the
    eigenvector use its simple form (or ``eigen_graph`` if given). ``digits``
    leading digits of the two summed metrics are kept (None: all). No score reads
    betweenness: ``want_betweenness=False`` leaves its column out.
    """
    nodes = cut_lineage(node_list(graph))
    n = _count(nodes)
    deg = degree_centrality(graph, nodes, n)
    prepared = _prepared(graph, nodes, None)
    paths = path_centralities(graph, nodes, n, want_betweenness, state_budget=state_budget, prepared=prepared)
    if eigen_graph is not None:
        eig = eigenvector_centrality(eigen_graph, nodes, n, **eigen_kwargs)
    else:
        eig = eigenvector_centrality(graph, nodes, n, prepared=prepared, **eigen_kwargs)
    table = deg.join(paths.closeness, "node")
    if want_betweenness:
        table = table.join(paths.betweenness, "node")
    table = table.join(eig.scores, "node")
    if digits is not None:
        # sums of doubles depend on their order: keep the leading digits only, so that
        # equal scores compare equal, however small they are (degree and closeness are
        # computed from whole numbers and need no rounding)
        table = table.withColumns({c: significant(F.col(c), digits) for c in ("betweenness", "eigenvector") if c in table.columns})
    return table, eig
