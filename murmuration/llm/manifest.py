"""Merkle dataset manifest: a tree per source, one root, and a proof per row.

Every row is a leaf; a source's leaves stand in the order of their ids and
each FANOUT consecutive nodes become one node above, up to the source's
subroot; the subroots, in the order of their sources, make one more tree. The
levels are written as node rows that name their parent, their place in it and
their children's digests.

Proofs are one recursive query over these rows. Each leaf climbs to the root
and folds its (perhaps tampered) digest with the siblings met on the way. The
siblings above a run of leaves are the same for all of them, so they are
appended by one climber per run and put behind the siblings inside the run.
All leaves meet near the root: a node has one copy for every CLIMBERS leaves
below it, and climbers are dealt to the copies, so no key gathers them all.
Digests are kept as 32 bytes and spelled out in hex where they are hashed.

Defined results: null fields are written as ``-``; a null source comes first
and null ids first in their source; rows with one id stand in the order of
their digests, so repeated rows are leaves of their own; rows with a null id
are never tampered with; an empty table has no rows and no root; extra columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import sized
from murmuration.session import cut_lineage

FANOUT = 16
CLIMBERS = 256     # leaves that meet one copy of a node
LEVEL = 1 << 56    # node number = level * LEVEL + place in the level
UPPER = 64         # levels above it belong to the tree over the subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelled(field: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = field.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(spelled, fields)), 256))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def leaves(docs: DataFrame, id_col: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """(id, group, leaf, tampered): ``tampered`` is the digest after the audit's change, which small-cases the texts of some ids."""
    column = {c: F.col(f"`{c}`") for c in fields}
    small = {**column, text: F.translate(column[text], _CAPITALS, _SMALL)}
    hit = F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0
    leaf = digest(*column.values())
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group}`").alias("group"), leaf.alias("leaf"),
                       F.when(hit, digest(*small.values())).alias("tampered"))


def placed(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows``, written, with their 0-based position in ``order``: one range exchange, positions counted in place."""
    own = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)    # the partition's number; the lower bits count its rows
    sizes = own.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))    # one row per partition
    got = own.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return got.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_at", "_before")


def grow(level: DataFrame, base: int, top: Column) -> list[DataFrame]:
    """The levels above ``level`` (s, n, r, idx, under, digest): trees ``s`` of ``n`` nodes numbered ``idx``, written as node rows.

    ``top`` is the parent (up, place) of a tree's last node, or null.
    """
    out, height = [], base
    while (level.agg(F.max("n")).first()[0] or 0) > 1:
        height += 1
        up = (level.filter("n > 1").groupBy("s", F.expr(f"idx div {FANOUT}").alias("idx"))
              .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("c"), F.sum("under").alias("under"),
                   F.first("n").alias("n"), F.first("r").alias("r")))    # FANOUT children at most
        children = F.aggregate("c", F.lit(b""), lambda x, c: F.concat(x, c["digest"]))
        up = up.select("s", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "r", "idx", "under", children.alias("children"))
        up = up.withColumn("digest", F.unhex(F.sha2(hexed(F.col("children")), 256))).withColumn("link", link(height, top))
        level = cut_lineage(up.select("*", number(height, "idx").alias("node")))
        out.append(level)
    return out


def number(height: int, idx: str) -> Column:
    """A node's number from its tree's first leaf ``s`` and its place ``idx`` in the level: no two nodes share one."""
    return F.lit(height * LEVEL) + F.col("s") + F.expr(idx)


def link(height: int, top: Column) -> Column:
    """(up, place): the parent of a node of a level, and where in it the node stands."""
    inside = F.struct(number(height + 1, f"idx div {FANOUT}").alias("up"), F.expr(f"cast(idx % {FANOUT} AS int)").alias("place"))
    return F.when(F.col("n") > 1, inside).otherwise(top)


_TOP = "struct<up:bigint,place:int>"


def build(leaf: DataFrame) -> tuple[DataFrame, DataFrame, bytes | None]:
    """Leaves with their places, node rows, and the root, from ``leaves``.

    Leaves: (id, leaf, tampered, g, n, up, place). Nodes: (node, up, place,
    under, children, subroot); ``subroot`` is null but in a source's last node.
    """
    own = placed(cut_lineage(leaf), [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tampered")], "g")
    own = cut_lineage(own)
    groups = placed(own.groupBy("group").agg(F.min("g").alias("s"), F.count(F.lit(1)).alias("n")), [F.col("s")], "r")
    groups = cut_lineage(groups)
    count = groups.count()
    top = F.struct((F.lit((UPPER + 1) * LEVEL) + F.expr(f"r div {FANOUT}")).alias("up"), F.expr(f"cast(r % {FANOUT} AS int)").alias("place"))
    if count < 2:
        top = F.lit(None).cast(_TOP)
    rows = own.join(sized(groups.withColumnRenamed("group", "_g")), F.col("group").eqNullSafe(F.col("_g")))
    rows = rows.withColumn("idx", F.col("g") - F.col("s")).withColumn("link", link(0, top))
    rows = cut_lineage(rows.select("id", "leaf", "tampered", "g", "s", "n", "r", "idx", F.col("link.up").alias("up"), F.col("link.place").alias("place")))
    first = rows.select("s", "n", "r", "idx", F.lit(1).cast("long").alias("under"), F.col("leaf").alias("digest"))
    levels = grow(first, 0, top)
    tops = reduce(DataFrame.unionByName, [x.filter("n = 1").select("r", "under", "digest") for x in [first, *levels]])
    upper = grow(cut_lineage(tops.select(F.lit(0).cast("long").alias("s"), F.lit(count).cast("long").alias("n"), F.lit(0).cast("long").alias("r"),
                                         F.col("r").alias("idx"), "under", "digest")), UPPER, F.lit(None).cast(_TOP))
    named = [x.withColumn("subroot", F.when(F.col("n") == 1, F.col("digest"))) for x in levels]
    named += [x.withColumn("subroot", F.lit(None).cast("binary")) for x in upper]
    last = (upper or levels or [first])[-1].filter("n = 1").first()
    if not named:    # a lone leaf, or nothing
        nothing = first.limit(0).selectExpr("idx AS node", "idx AS up", "0 AS place", "under", "digest AS children", "digest AS subroot")
        return rows, nothing, bytes(last["digest"]) if last else None
    nodes = reduce(DataFrame.unionByName, [x.select("node", F.col("link.up").alias("up"), F.col("link.place").alias("place"), "under", "children", "subroot")
                                           for x in named])
    return rows, nodes, bytes(last["digest"])


_CLIMB = """
WITH RECURSIVE climb(start, node, copies, place, folded, siblings, subroot) AS (
  SELECT start, node, copies, place, folded, siblings, subroot FROM {starts}
  UNION ALL
  SELECT c.start, n.up, n.up_copies, n.place,
    unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.place), c.folded, substring(n.children, 32 * c.place + 33)))), 256)),
    concat(c.siblings, substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33)),
    coalesce(c.subroot, if(c.siblings IS NULL, NULL, n.subroot))
  FROM climb c JOIN {nodes} n ON n.node = c.node AND n.copy = pmod(c.start, c.copies)
)
SELECT start, folded, siblings, subroot FROM climb WHERE node IS NULL LIMIT ALL
"""


def climb(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, folded) of every leaf, and (up, above, subroot) of every node that has leaves: what stands above it on the way to the root."""
    copies = F.expr(f"(under + {CLIMBERS - 1}) div {CLIMBERS}")
    known = cut_lineage(nodes.select("node", copies.alias("up_copies")))
    nodes = cut_lineage(nodes.join(known.withColumnRenamed("node", "up"), "up", "left"))
    copied = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    nothing = F.lit(None).cast("binary")
    digest = F.coalesce("tampered", "leaf").alias("folded")
    many = rows.filter("n > 1").select(F.col("g").alias("start"), F.col("up").alias("node"), F.lit(1).cast("long").alias("copies"), "place", digest)
    lone = rows.filter("n = 1").join(known.withColumnRenamed("node", "up"), "up", "left").select(
        F.col("g").alias("start"), F.col("up").alias("node"), F.col("up_copies").alias("copies"), "place", digest)
    single = many.unionByName(lone).select("*", nothing.alias("siblings"), nothing.alias("subroot"))
    bottom = F.expr(f"node div {LEVEL}").isin(1, UPPER + 1)
    runs = nodes.filter(bottom).select(F.col("node").alias("start"), F.col("up").alias("node"), F.col("up_copies").alias("copies"), "place",
                                       nothing.alias("folded"), F.lit(b"").alias("siblings"), "subroot")
    done = cut_lineage(rows.sparkSession.sql(_CLIMB, starts=single.unionByName(runs), nodes=copied))
    return (done.filter(f"start < {LEVEL}").select(F.col("start").alias("g"), "folded"),
            done.filter(f"start >= {LEVEL}").select(F.col("start").alias("up"), F.col("siblings").alias("above"), "subroot"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """(id_col, leaf, subroot, root, proof, folded) of every row, digests as 32 bytes; ``proof``: its siblings, bottom to top.

    ``folded`` is the root as recomputed from the row's tampered, else
    original, leaf and its proof.
    """
    rows, nodes, root = build(leaves(docs, id_col, group, fields, text))
    folded, above = climb(rows, nodes)
    runs = above.join(nodes.select(F.col("node").alias("up"), "children"), "up")
    # the narrow rows meet first: proofs are put together in the last join and never move
    got = rows.select("id", "leaf", "g", "n", "up", "place").join(folded, "g").join(runs, "up", "left")
    siblings = F.concat(F.substring("children", F.lit(1), 32 * F.col("place")), F.substring("children", 32 * F.col("place") + 33, F.lit(32 * FANOUT)), "above")
    subroot = F.when(F.col("n") == 1, F.col("leaf")).otherwise(F.col("subroot"))
    return got.select(F.col("id").alias(id_col), "leaf", subroot.alias("subroot"), F.lit(root).cast("binary").alias("root"),
                      F.coalesce(siblings, F.lit(b"")).alias("proof"), "folded")


def op11(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with its digests in hex, and whether each row still folds to the root."""
    got = manifest(docs)
    return got.select("doc_id", *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(hexed(F.col("proof")), 256).alias("proof_sha256"),
                      hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_LEAF_SMALL = " || ".join(_FIELD.format(c if c != "text" else f"translate(text, '{_CAPITALS}', '{_SMALL}')") for c in FIELDS)
_GROW = """SELECT s, idx // 16, (any_value(n) + 15) // 16, any_value(r), lvl + 1, sha256(string_agg(h, '' ORDER BY idx)) FROM {0} WHERE n > 1 GROUP BY s, lvl, idx // 16"""
_KEY = "{0} || '/' || {1} || '/' || {2} || '/' || {3}"
OP11_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, source, sha256({_LEAF}) AS h, sha256({_LEAF_SMALL}) AS low,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM documents, tab),
g AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, h) - 1 AS g, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS r FROM d),
l AS (SELECT *, min(g) OVER (PARTITION BY r) AS s, count(*) OVER (PARTITION BY r) AS n FROM g),
low AS (SELECT s, g - s AS idx, n, r, 0 AS lvl, h FROM l UNION ALL {_GROW.format('low')}),
high AS (SELECT 0 AS s, r AS idx, (SELECT count(DISTINCT s) FROM l) AS n, 0 AS r, 0 AS lvl, h FROM low WHERE n = 1 UNION ALL {_GROW.format('high')}),
node AS (SELECT {_KEY.format(0, 's', 'lvl', 'idx')} AS k, CASE WHEN n > 1 THEN {_KEY.format(0, 's', '(lvl + 1)', '(idx // 16)')}
    WHEN (SELECT count(DISTINCT s) FROM l) > 1 THEN {_KEY.format(1, 0, 1, '(r // 16)')} END AS up, CASE WHEN n > 1 THEN idx ELSE r END AS place, h FROM low
  UNION ALL SELECT {_KEY.format(1, 's', 'lvl', 'idx')}, CASE WHEN n > 1 THEN {_KEY.format(1, 's', '(lvl + 1)', '(idx // 16)')} END, idx, h FROM high WHERE lvl > 0),
sib AS (SELECT k, up, coalesce(string_agg(h, '') OVER (PARTITION BY up ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
    coalesce(string_agg(h, '') OVER (PARTITION BY up ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM node WHERE up IS NOT NULL),
climb AS (SELECT g, {_KEY.format(0, 's', 0, '(g - s)')} AS k, CASE WHEN crc % 5 = 0 THEN low ELSE h END AS folded, '' AS proof FROM l
  UNION ALL SELECT c.g, b.up, sha256(b.pre || c.folded || b.post), c.proof || b.pre || b.post FROM climb c JOIN sib b ON b.k = c.k),
root AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root AS verified
FROM l JOIN low t ON t.s = l.s AND t.n = 1 JOIN (SELECT * FROM climb WHERE k NOT IN (SELECT k FROM sib)) c ON c.g = l.g, root
"""
