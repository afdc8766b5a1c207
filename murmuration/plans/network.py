"""Entry 1: who is prominent in the mention network of a topic.

posts -> topic search (+ optional timeline enrichment) -> lower-case ->
mention edges -> verified flags -> pseudonyms -> centralities -> percentile
report, network metrics, export, sentiment, comparison with the last run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.privacy import protected_handle
from murmuration.operators import centrality as C
from murmuration.operators import export as X
from murmuration.operators import graph as G
from murmuration.operators import history as H
from murmuration.operators import posts as P
from murmuration.operators import ranking as R
from murmuration.operators import sentiment as S
from murmuration.operators.accounts import flag_verified
from murmuration.session import cut_lineage
from murmuration.sources import readers as RD
from murmuration.sources import sinks as SK


NETWORK_METRICS = ("nodes", "edges", "density_pct")


@dataclass
class NetworkParams:
    query: str = "launch"
    given_user: str = "User7"
    selfloop: bool = False
    remove_duplicates: bool = True
    multi: bool = True                  # keep repeated mentions (edge weighting)
    allow_retweets: bool = True
    hashing: str = "valid"              # none | full | valid
    hash_bits: int = 224                # SHA-224 as the reference; 256 where the oracle needs it
    gain: float = 500.0
    max_posts: int | None = None        # None: the whole table, no cap
    get_user_activity: bool = False
    mentions_of_user: bool = False
    score: str = "sum"                  # sum | eigenvector
    betweenness: bool = True            # no score reads it; False leaves the column out
    seed: str = "123456789"
    mention_match: str = "substring"    # F5 mode for the mentions corpus
    eigen: dict = field(default_factory=dict)

    @property
    def given(self) -> str:
        return self.given_user.lower()


def network_posts(posts: DataFrame, p: NetworkParams) -> DataFrame:
    """S1 or U1, then P2: lower-cased author and text."""
    if p.get_user_activity:
        sel = P.enrich_with_timeline(posts, p.query, p.given_user, p.mentions_of_user, p.allow_retweets, p.max_posts)
    else:
        sel = P.topic_posts(posts, p.query, p.allow_retweets, p.max_posts)
    return sel.select("post_id", "created_at", F.lower("author").alias("author"), F.lower("text").alias("text"))


def handle_map(edges: DataFrame, dictionary: DataFrame, given: str, mode: str, bits: int = 224) -> DataFrame:
    """J5 + P10: (node, display) for every handle of the network."""
    flagged = flag_verified(G.node_list(edges), dictionary)
    return flagged.select("node", protected_handle(F.col("node"), F.col("verified"),
                                                   F.col("node") == given, mode, bits).alias("display"))


def protect_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both endpoints replaced by their displayed handle.

    The map has one row per node; AQE turns these joins into broadcasts when
    the measured map is small and keeps a shuffle join otherwise.
    """
    s = mapping.select(F.col("node").alias("sender"), F.col("display").alias("_s"))
    r = mapping.select(F.col("node").alias("receiver"), F.col("display").alias("_r"))
    return (edges.join(s, "sender").join(r, "receiver")
                 .select("post_id", "pos", F.col("_s").alias("sender"), F.col("_r").alias("receiver")))


def network_edges(corpus: DataFrame, dictionary: DataFrame, p: NetworkParams) -> DataFrame:
    """F8 + J5 + J10: mentions of ``corpus`` with both ends as displayed handles.

    The mentions are stored once: both ends of the node list and the protected
    edges read them, and finding them in the texts costs more than all joins.
    """
    raw = cut_lineage(G.mention_edges(corpus.select("post_id", "author", "text"), p.selfloop))
    return protect_edges(raw, handle_map(raw, dictionary, p.given, p.hashing, p.hash_bits))


@dataclass
class NetworkResult:
    params: NetworkParams
    corpus: DataFrame          # post_id, created_at, author, text (lower-cased)
    edges: DataFrame           # post_id, pos, sender, receiver (displayed handles)
    graph: DataFrame           # sender, receiver (multi or simple)
    centrality: DataFrame      # node + 6 metrics + score
    eigen: C.Eigen
    given_present: bool

    def report(self) -> DataFrame:
        return R.influence_report(self.centrality, self.params.given, self.params.gain, self.params.seed)

    def percentile(self) -> DataFrame:
        pct = R.percentile_rank(self.centrality, "score", "pct")
        return pct.filter(F.col("node") == self.params.given).select(F.col("pct").alias("percentile"))

    def summary(self, previous: DataFrame | None = None) -> DataFrame:
        """G13; with ``previous`` (one stored run at most) also its values and the differences."""
        out = network_summary(self.graph, self.params)
        return out if previous is None else H.with_previous(out, previous, NETWORK_METRICS)

    def sentiment(self, lexicon: DataFrame, about_given: bool = False) -> DataFrame:
        c = self.corpus
        if about_given:
            c = S.mention_corpus(c, self.params.given, self.params.mention_match)
        return S.sentiment_summary(c, lexicon, self.params.remove_duplicates)

    def metrics(self, lexicon: DataFrame, run_ts: str) -> DataFrame:
        """The run as one row of the history table (K6); the percentile is NULL for an absent account."""
        p = self.params
        size = G.network_size(self.graph).select("nodes", "edges", "density_pct")
        pct = self.percentile().agg(F.max("percentile").alias("percentile"))
        every = self.sentiment(lexicon).select(F.col("mean").alias("sentiment_all"))
        about = self.sentiment(lexicon, about_given=True).select(F.col("mean").alias("sentiment_user"))
        row = size.crossJoin(pct).crossJoin(every).crossJoin(about)    # one row each
        # stored: comparing and saving read the same row
        return cut_lineage(row.select(F.lit(p.given).alias("given_user"), F.lit(p.query).alias("query"),
                                      F.lit(run_ts).cast("timestamp").alias("run_ts"), "nodes", "edges", "density_pct",
                                      "percentile", "sentiment_all", "sentiment_user"))

    def previous(self, history: DataFrame, run_ts: str) -> DataFrame:
        """The newest stored run of this account and topic before ``run_ts`` (one row at most)."""
        p = self.params
        mine = history.filter((F.col("given_user") == p.given) & (F.col("query") == p.query))
        return H.latest_runs(mine.filter(F.col("run_ts") < F.lit(run_ts).cast("timestamp")))

    def export(self, folder: str) -> None:
        """G14 + K4 + K5: node and link table of the largest component as CSV below ``folder``."""
        nodes, links = X.export_graph(self.edges, self.params.given, self.params.multi)
        SK.export_csv(nodes, f"{folder}/nodes")
        SK.export_csv(links, f"{folder}/links")


@dataclass
class RunReport:
    accounts: DataFrame      # section, pct, score, node
    network: DataFrame       # G13 with previous_* and delta_*
    comparison: DataFrame    # J11: every metric, the previous one, the difference


def run_and_store(result: NetworkResult, lexicon: DataFrame, run_ts: str, folder: str) -> RunReport:
    """Entry 1 to its end: report, comparison with the stored run, export, and the run appended to the history.

    State lives below ``folder``: ``history`` (parquet, one row a run), ``nodes`` and ``links`` (CSV, replaced).
    A run repeated under the same ``run_ts`` (after a failure) is compared with the run before it, not with itself.
    """
    path = f"{folder}/history"
    stored = cut_lineage(RD.read_run_history(result.edges.sparkSession, path))    # read before this run is appended
    row = result.metrics(lexicon, run_ts)
    report = RunReport(result.report(), result.summary(result.previous(stored, run_ts)), H.compare_last_run(row, stored))
    result.export(folder)
    SK.append_run_history(row, path)
    return report


def network_summary(graph: DataFrame, p: NetworkParams) -> DataFrame:
    """Nodes, edges, density %, self-loops, transitivity (simple graph only), settings."""
    size = G.network_size(graph)
    if not p.multi:
        size = size.crossJoin(G.transitivity(graph))
    else:
        size = size.withColumn("transitivity", F.lit(None).cast("double"))
    return size.select("*", F.lit(p.allow_retweets).alias("allow_retweets"), F.lit(p.multi).alias("repeated_contact"),
                       F.lit(p.remove_duplicates).alias("remove_duplicates"), F.lit(p.selfloop).alias("self_loops_allowed"),
                       F.lit(p.get_user_activity).alias("user_activity"))


def analyse_network(posts: DataFrame, dictionary: DataFrame, p: NetworkParams | None = None,
                    state_budget: int | None = None) -> NetworkResult:
    """``posts``: a post table, or API-shaped records (``operators.posts.as_posts``)."""
    p = p or NetworkParams()
    corpus = network_posts(P.as_posts(posts), p)
    # materialised once in the shared checkpoint folder: every later step reads it
    edges = cut_lineage(network_edges(corpus, dictionary, p))
    graph = G.build_graph(edges, p.multi)
    given_present = edges.filter((F.col("sender") == p.given) | (F.col("receiver") == p.given)).limit(1).count() > 0
    table, eig = C.centrality_table(graph, state_budget=state_budget, want_betweenness=p.betweenness, **p.eigen)
    table = cut_lineage(R.combined_score(table, p.score))
    return NetworkResult(p, corpus, edges, graph, table, eig, given_present)
