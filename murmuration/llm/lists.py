"""Candidate lists of any size, searched without pairing up a whole list.

1. Every node is compared with the smallest node of its lists (a star);
   copies of one text meet here, however many they are.
2. Lists that still hold nodes of several components compare the nodes of
   different components, in lists of up to ``small`` nodes by a join.
3. The nodes of larger lists (a passage that many texts share) are dealt anew
   by their rarest elements, which separates different texts: similar sets
   are certain to share one of them (prefix filter), so no pair of a large
   list is lost. The places of that element in both orders bound what the
   sets can have in common (``can_meet``); pairs that this rules out are never
   made. What remains is compared in rounds of bounded size until no list
   holds two components that were not compared. Nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm import common
from murmuration.llm.common import sized
from murmuration.llm.graph import components
from murmuration.session import cut_lineage, release, settle

ROUND_PAIRS = 4_000_000    # pairs a round may compare, about
CELLS = 1 << 14    # counters of elements, by hash


def repeated(keyed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (key, node) whose key has others, and few more.

    Keys are counted first, without their nodes. Up to a counted number, those
    met again are broadcast; more of them set bits of a table of a fixed size,
    which lets some other rows through and loses none.
    """
    again = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    if again.count() <= common.BROADCAST_ROWS:
        return keyed.join(F.broadcast(again), "key", "left_semi")
    bit = F.pmod(F.xxhash64("key"), F.lit(64 * common.BROADCAST_ROWS))
    place = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    cells = again.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(place).alias("bits"))
    rows = keyed.withColumn("bit", bit).withColumn("cell", F.shiftright("bit", 6)).join(F.broadcast(cut_lineage(cells)), "cell")
    return rows.filter(F.col("bits").bitwiseAND(place) != 0).select(*keyed.columns)


def by_rarest(sets: DataFrame, hot: DataFrame, percent: int, grams: Column | None = None) -> DataFrame:
    """(key, node, i, n) of the n - ceil(t n) + 1 rarest elements of each node of ``hot`` (node), from its whole set in ``sets`` (node, grams; or ``grams`` of its columns).

    Sets of Jaccard t or more share one of these under any common order of
    the elements, so the order may use counts that elements share by hash.
    ``i``: place of the element in that order, from 0; ``n``: size of the set.
    """
    own = cut_lineage(sets.join(sized(cut_lineage(hot)), "node"))
    if grams is not None:
        own = own.select("node", grams.alias("grams"))
    cell = lambda x: F.pmod(F.xxhash64(x), F.lit(CELLS)).cast("int")
    seen = own.select(F.explode("grams").alias("x")).groupBy(cell(F.col("x")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    every = own.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("c"), F.lit(0).cast("long").alias("n"))
    counts = seen.unionByName(every).groupBy("c").agg(F.sum("n").alias("n"))
    # one row of CELLS numbers
    counts = cut_lineage(counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "n"))), lambda s: s["n"]).alias("often")))
    order = F.sort_array(F.transform("grams", lambda x: F.struct(F.get("often", cell(x)).alias("n"), x.alias("x"))))
    size = F.size("grams")
    rarest = F.slice(order, F.lit(1), (size - F.ceil(size * percent / 100) + 1).cast("int"))
    own = own.crossJoin(F.broadcast(counts)).select("node", size.cast("long").alias("n"), F.posexplode(F.transform(rarest, lambda s: s["x"])).alias("i", "key"))
    return own.select("key", "node", F.col("i").cast("long").alias("i"), "n")


def can_meet(iu: Column, nu: Column, iv: Column, nv: Column, percent: int) -> Column:
    """Can sets of ``nu`` and ``nv`` elements be similar that share none before the places ``iu`` and ``iv`` of ``by_rarest``?

    They have min(nu - iu, nv - iv) in common at most; t / (1 + t) of
    nu + nv are needed.
    """
    return F.least(nu - iu, nv - iv) * (100 + percent) >= (nu + nv) * percent


def leads(percent: int) -> Column:
    """Can a row (i, n) of ``by_rarest`` be the first common element of its set and a similar one that is as large or larger?"""
    return can_meet(F.col("i"), F.col("n"), F.lit(0), F.col("n"), percent)


class ListSearch:
    """Subclasses say how pairs are compared and how the nodes of large lists are dealt anew."""

    percent: int    # of Jaccard similarity that makes a link
    small = 32      # nodes of a list whose pairs are all compared by a join
    label: DataFrame | None = None      # (node, label) of the nodes linked so far
    fresh: DataFrame | None = None      # links found since

    def prepare(self, members: DataFrame) -> None:
        """Called with the lists (key, node, rep, size) before their nodes are compared."""

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The links (u, v) among candidate ``pairs`` (u, v), materialised."""
        raise NotImplementedError

    def deal(self, hot: DataFrame) -> DataFrame:
        """(key, node, i, n) of more selective lists for the nodes in ``hot`` (node), see ``by_rarest``."""
        raise NotImplementedError

    def _add(self, found: DataFrame) -> None:
        """Takes materialised links (u, v)."""
        self.fresh = found if self.fresh is None else self.fresh.unionByName(found)

    def _link(self, pairs: DataFrame) -> None:
        self._add(self.compare(pairs))

    def labels(self) -> DataFrame:
        """(node, label) of all nodes linked so far; later links are contracted between the components there are."""
        if self.fresh is not None and self.label is None:
            self.label = settle(components(self.fresh))
        elif self.fresh is not None:
            own = self.label.withColumnsRenamed({"node": "n", "label": "l"})
            ends = self.fresh
            for end in ("u", "v"):
                ends = ends.join(own, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("l", end)).drop("n", "l")
            ends = cut_lineage(ends.filter(F.col("u") != F.col("v")).distinct())
            if not ends.isEmpty():      # else all of them were in one component each
                merged = cut_lineage(components(ends))
                to = sized(merged).withColumnsRenamed({"node": "n", "label": "l"})
                old = self.label.join(to, F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label"))
                new = merged.join(self.label.select("node"), "node", "left_anti")
                self.label = settle(old.unionByName(new))
        self.fresh = None
        return self.label

    def _star(self, keyed: DataFrame) -> DataFrame:
        """Compares every node with the smallest of its lists; returns the lists of two nodes at least, one of each set of members.

        Of lists dealt by rarest elements that is the first in their order: its places are the smallest for all members.
        """
        mark = [F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64(F.lit("b"), "node")).alias("b")]
        keyed = cut_lineage(repeated(keyed))
        release(keyed.sparkSession)
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("rep"), *mark,
                                           F.min("i" if "i" in keyed.columns else "key").alias("at")).filter("size > 1")
        sizes = sizes.groupBy("size", "rep", "a", "b").agg(F.min_by("key", "at").alias("key")).select("key", "size", "rep")
        members = cut_lineage(keyed.join(sized(cut_lineage(sizes)), "key"))
        self.prepare(members)
        release(keyed.sparkSession)
        self._link(members.filter(F.col("node") != F.col("rep")).select(F.col("node").alias("u"), F.col("rep").alias("v")).distinct())
        return members

    def _open(self, members: DataFrame) -> DataFrame:
        """(key, node, size, part, and i, n if known) of the lists that hold several components (part) which can be linked."""
        label = self.labels()
        own = ["key", "node", "size", *[c for c in members.columns if c in ("i", "n")]]
        m = members.select(*own).join(label, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label")
        some = leads(self.percent) if "i" in own else F.lit(True)
        several = m.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.bool_or(some).alias("c"))
        several = several.filter((F.col("a") != F.col("b")) & F.col("c")).select("key")
        return cut_lineage(m.join(several, "key", "left_semi"))

    def _meet(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of a list that lie in different components, and can be similar where their places are known; once for every list they share."""
        placed = "i" in left.columns
        x = left.select("key", F.col("node").alias("u"), F.col("part").alias("pu"), *[F.col(c).alias(c + "u") for c in ("i", "n") if placed])
        y = right.select("key", F.col("node").alias("v"), F.col("part").alias("pv"), *[F.col(c).alias(c + "v") for c in ("i", "n") if placed])
        meet = (F.col("pu") != F.col("pv")) & (F.col("u") != F.col("v"))
        if placed:     # the smaller set leads
            meet &= (F.col("nu") <= F.col("nv")) & can_meet(F.col("iu"), F.col("nu"), F.col("iv"), F.col("nv"), self.percent)
        return x.join(y, "key").filter(meet).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

    def _across(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return self._meet(left, right).distinct()

    def fits(self, left: DataFrame) -> DataFrame:
        """Open lists (key, node, size, part) with ``fits``: need they no dealing?"""
        return left.withColumn("fits", F.col("size") <= self.small)

    def waves(self, left: DataFrame) -> int:
        """In how many turns ``inside`` takes these lists (0: it has nothing to do)."""
        return 0

    def inside(self, left: DataFrame) -> DataFrame:
        """Links (u, v) found in open lists of more than ``small`` nodes, each in one task."""
        raise NotImplementedError

    def _search(self, left: DataFrame) -> DataFrame:
        """Links the open lists that fit; returns the others as they are then."""
        left = cut_lineage(self.fits(left))
        small = left.filter(F.col("fits") & (F.col("size") <= self.small))
        self._link(self._across(self._leading(small), small))
        middle = left.filter(F.col("fits") & (F.col("size") > self.small))
        waves = self.waves(middle)
        for turn in range(waves):
            if turn:
                middle = self._open(middle)     # lists whose nodes met elsewhere drop out
            mine = middle.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == turn)
            self._add(cut_lineage(self.inside(mine)))
        return left.filter(~F.col("fits")).drop("fits", "grams")

    def _leading(self, left: DataFrame) -> DataFrame:
        return left.filter(leads(self.percent)) if "i" in left.columns else left

    def run(self, keyed: DataFrame) -> DataFrame:
        """(node, label) of all linked nodes, from (key, node) lists without repeats."""
        large = self._search(self._open(self._star(keyed)))
        if not large.isEmpty():
            left = self._search(self._open(self._star(cut_lineage(self.deal(large.select("node").distinct())))))
            left = self._open(left)
            rounds = -(-self._meet(self._leading(left), left).count() // ROUND_PAIRS)     # counted where they arise
            for turn in range(rounds):    # each leading node of a list takes its turn; merged lists drop out
                mine = F.pmod(F.xxhash64("node"), F.lit(rounds)) == turn
                self._link(self._across(self._leading(left).filter(mine), left))
                if turn + 1 < rounds:
                    left = self._open(left)
        return self.labels()
