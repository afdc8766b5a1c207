"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document is its set of hashed word shingles; equal sets are one node. A
node keeps its SKETCH smallest hashes. Inverted lists bring nodes together
that retain the same values; pairs of a list are filtered by the Jaccard
estimate of the union sketch and confirmed on the full sets; links form
components.

Lists are keyed by runs of RUN neighbouring retained values (of the first
PREFIX), which nodes of Jaccard 0.8 share with probability above 0.9999; sets
of up to 41 shingles also use the single values of their prefix, which
similar sets are certain to share. ``lists.py`` keeps the work bounded in a
list of any size; nodes of large lists are dealt anew by the rarest shingles
of their whole sets.

Defined results: null texts and texts without words have an empty set, link
with nothing and stand alone; repeated rows share a component; a null id is
the smallest of a component only where no other id is in it; extra columns
are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import SPACE_TABLE, Words, map_texts, mix, sized, unused
from murmuration.llm.lists import ListSearch, by_rarest
from murmuration.session import cut_lineage, settle

SKETCH = 64        # retained hashes
PREFIX = 32        # of which the smallest are used for lists
RUN = 3            # neighbouring values of a list key
SLACK = 0.2        # the estimate may be this much below the threshold (4 standard deviations)

_BIAS = np.uint64(1 << 63)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words make one shingle."""
    words = Words(texts, SPACE_TABLE)
    h, at = words.grams(k)
    row = words.doc[at]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(words.count.tolist()):
        if n >= k:
            out.append(np.unique(h[first[i]:first[i + 1]]))
        elif n:
            lo = words.first[i]
            x = np.uint64(n)
            with np.errstate(over="ignore"):
                for j in range(n):
                    x = x * np.uint64(0xD6E8FEB86659FD93) + words.hash[lo + j]
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(h: np.ndarray) -> np.ndarray:
    """Order-keeping map of unsigned hashes to longs."""
    return (h ^ _BIAS).view(np.int64)


def _node(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """(id, h, node, n, sketch) of every row; node: digest of the whole set, null if empty."""
    def fn(rows, texts, _):
        sets = shingle_sets(texts, k)
        return [rows.column(0), rows.column(1), [_node(s) if len(s) else None for s in sets], [len(s) for s in sets],
                [_signed(s[:SKETCH]) for s in sets]]

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    return map_texts(rows, fn, {"id": "string", "h": "long", "node": "binary", "n": "long", "sketch": "array<long>"})


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, text: str) -> DataFrame:
    """(node, grams): the whole sets of the nodes in ``wanted`` (node, digest, h), from one text of each."""
    def fn(rows, texts, _):
        sets = shingle_sets(texts, k)
        return [[_node(s) for s in sets], [s.view(np.int64) for s in sets]]

    texts = docs.select(F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    wanted = cut_lineage(wanted)
    one = texts.join(sized(wanted.select("h").distinct()), "h", "left_semi").dropDuplicates(["h"])
    sets = map_texts(one, fn, {"digest": "binary", "grams": "array<long>"})
    return sets.join(wanted.select("node", "digest"), "digest").drop("digest").dropDuplicates(["node"])


def list_keys(percent: int) -> Column:
    """Keys of a node's inverted lists, from (n, sketch)."""
    head = F.slice("sketch", 1, PREFIX)
    runs = F.when(F.size(head) >= RUN, F.transform(F.sequence(F.lit(0), F.size(head) - RUN), lambda i: F.xxhash64(
        *[F.get(head, i + j) for j in range(RUN)]))).otherwise(F.array().cast("array<long>"))
    # smallest n - ceil(t n) + 1 values: similar sets share one of them
    short = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    limit = PREFIX * 100 // percent + 1
    single = F.when(F.col("n") <= limit, F.transform(F.slice("sketch", F.lit(1), short), lambda v: F.xxhash64(v))).otherwise(
        F.array().cast("array<long>"))
    return F.array_distinct(F.concat(runs, single))


class _Search(ListSearch):
    """Candidate pairs of one table of nodes (node, digest, h, n, sketch), compared and linked.

    Lists of more than ``small`` nodes that still hold several components are
    dealt anew at once: their rarest shingles tell their nodes apart sooner
    than comparing them does.
    """

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int, text: str):
        self.docs, self.nodes, self.k, self.percent, self.text = docs, nodes, k, percent, text
        self.listed = self.sets = None

    @staticmethod
    def beside(table: DataFrame, value: str, pairs: DataFrame) -> DataFrame:
        """``pairs`` (u, v, ...) with xu and xv, the ``value`` of both nodes in ``table``; of it, only what pairs ask for moves (up to a counted number of pairs)."""
        pairs = cut_lineage(pairs)
        firsts = table.select(F.col("node").alias("u"), F.col(value).alias("xu")).join(sized(pairs), "u")
        wanted = sized(cut_lineage(pairs.select(F.col("v").alias("node")).distinct()))
        seconds = table.join(wanted, "node", "left_semi").select(F.col("node").alias("v"), F.col(value).alias("xv"))
        return firsts.join(seconds, "v")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (u, v): sizes, then sketches, then whole sets."""
        t = self.percent / 100
        n = self.listed.select("node", "n")
        near = (pairs.join(n.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(n.select(F.col("node").alias("v"), F.col("n").alias("nv")), "v")
                     .filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * self.percent).select("u", "v", "nu", "nv"))    # sizes first: few bytes
        near = self.beside(self.listed, "sketch", near)
        both = F.slice(F.sort_array(F.array_union("xu", "xv")), 1, SKETCH)   # bottom-k of the union
        near = near.withColumn("both", both).withColumn("shared", F.size(F.array_intersect("both", F.array_intersect("xu", "xv"))))
        near = near.filter(F.col("shared") >= F.size("both") * (t - SLACK)).select("u", "v", "nu", "nv")
        full = self.beside(self.sets, "grams", near)
        inter = F.size(F.array_intersect("xu", "xv")).cast("long")
        found = full.withColumn("i", inter).filter(F.col("i") * 100 >= (F.col("nu") + F.col("nv") - F.col("i")) * self.percent).select("u", "v")
        return cut_lineage(found)

    def prepare(self, members: DataFrame) -> None:
        """Sketches and whole sets of all nodes that share a list, made once."""
        if self.sets is None:
            wanted = sized(cut_lineage(members.select("node").distinct()))
            self.listed = cut_lineage(self.nodes.join(wanted, "node", "left_semi"))
            self.sets = cut_lineage(full_sets(self.docs, self.listed.select("node", "digest", "h"), self.k, self.text))

    def deal(self, hot: DataFrame) -> DataFrame:
        return by_rarest(self.sets, hot, self.percent)


def numbered_nodes(rows: DataFrame) -> DataFrame:
    """(node, digest, h, n, sketch) of every set among ``sketches``; ``node`` is a number: joins and groups work on longs."""
    one = rows.filter("node IS NOT NULL").groupBy(F.col("node").alias("digest")).agg(F.min("h").alias("h"), F.max("n").alias("n"), F.first("sketch").alias("sketch"))
    return cut_lineage(one.withColumn("node", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, h, n_shingles, node, part) of every row; rows of one component share ``part`` (null for an empty set)."""
    key = dict(docs.dtypes)[id_col]
    rows = cut_lineage(sketches(docs, k, id_col, text))
    nodes = numbered_nodes(rows)
    rows = cut_lineage(rows.drop("sketch"))     # the nodes have it
    keys = settle(nodes.select("node", list_keys(percent).alias("keys")))     # read twice
    keyed = keys.select("node", F.explode("keys").alias("key"))
    label = _Search(docs, nodes, k, percent, text).run(keyed)
    named = label.join(nodes.select("node", "digest"), "node").select(F.col("digest").alias("node"), "label")
    part = F.struct(F.coalesce("label", F.lit(-1)).alias("label"), F.when(F.col("label").isNull(), F.col("node")).otherwise(F.lit(b"")).alias("alone"))
    return (rows.select(F.col("id").cast(key).alias(id_col), "h", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
                .withColumn("part", F.when(F.col("node").isNotNull(), part)).drop("label"))


def component_ids(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``near_duplicates`` with ``component_id``: the smallest id of the component."""
    rows = cut_lineage(near_duplicates(docs, k, percent, id_col, text))
    least = rows.filter("part IS NOT NULL").groupBy("part").agg(F.min(id_col).alias("_least"))
    return rows.join(least, "part", "left").withColumn("component_id", F.when(F.col("part").isNull(), F.col(id_col)).otherwise(F.col("_least"))).drop("_least")


def op9(docs: DataFrame) -> DataFrame:
    got = component_ids(docs, 4, 80)
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the smallest id; ties by text hash), columns unchanged.

    Documents without words all stay. Repeated rows of one id and text are
    one document and leave one row.
    """
    rows = near_duplicates(docs, k, percent, id_col, text).select(F.col(id_col).alias("id"), "h", "part")
    rows = cut_lineage(rows)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    stays = rows.filter("part IS NOT NULL").groupBy("part").agg(F.min(place).alias("p")).select("p.id", "p.h")
    stays = stays.unionByName(rows.filter("part IS NULL").select("id", "h")).distinct().alias("_s")
    mark = unused("_h", docs.columns)
    own = docs.withColumn(mark, F.xxhash64(F.col(text))).alias("_d")
    kept = own.join(stays, F.col(f"_d.`{id_col}`").eqNullSafe(F.col("_s.id")) & (F.col(f"_d.{mark}") == F.col("_s.h")), "left_semi")
    return kept.dropDuplicates([id_col, mark]).drop(mark)


OP9_SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
s AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM l),
e AS (SELECT a.rid AS u, b.rid AS v FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY a.rid, b.rid, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT rid AS u, rid AS v FROM d UNION SELECT r.u, x.v FROM r JOIN (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) x ON r.v = x.u),
c AS (SELECT r.u AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.v GROUP BY r.u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM l JOIN c USING (rid)
"""
