"""WARC records with a Merkle fixity audit of replicas that were archived apart.

Every archive is laid out on its own. A record's address is a hash of its page
id and url (records of one page and url are told apart by their order of
digests), so both replicas know it whatever their contents. The first digits of
the addresses cut an archive into segments of about FANOUT records; inside a
segment records follow by address and offsets add up. A segment hashes its
ordered records (address, offset, length, copies, digest); each level above
hashes the FANOUT nodes below, up to one root. A record that one replica lacks
moves the offsets of its own segment only.

Two replicas are compared from the root down: only children of mismatching
nodes are looked at. Records of the segments reached are compared by page, url
and digest: ``missing`` (not in the replica), ``altered`` (the replica has
another record of this page and url instead), ``extra`` (only in the replica).
Matching segments hold the same records on both sides, so nothing else differs.

Payloads are hashed where they are read; only rows of digests are shuffled.

Defined results: null ids, urls and pages are written as empty strings;
repeated pages are one entry with their number of ``copies``, and a replica
with fewer copies misses the entry; two empty archives agree, and a replica
without records misses all of them; extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import numbered
from murmuration.session import cut_lineage

FANOUT = 16                                 # one hexadecimal digit of an address a level


@dataclass
class Archive:
    """A laid out archive: ``placed`` has one row per distinct record, ``levels`` the nodes, segments first."""
    placed: DataFrame       # page_id, url, key, address, segment, record_no, offset, length, copies, digest
    levels: list[DataFrame]     # (node, hash); the last level is the root, node ''


def warc_record(url: Column, body: Column) -> Column:
    """One WARC/1.1 resource record as a string."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:sha256:"), F.sha2(F.concat(url, F.lit("\n"), body), 256),
                    F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page_id, url, record): the pages as WARC records."""
    return pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), warc_record(F.col(url), F.col(body)).alias("record"))


def entries(records: DataFrame) -> DataFrame:
    """(page_id, url, key, length, digest, copies, address) of each distinct record, materialised."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = records.select("page_id", "url", F.md5(F.concat(text("page_id"), F.lit("\n"), text("url"))).alias("key"),
                          F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    one = rows.groupBy("page_id", "url", "key", "length", "digest").agg(F.count(F.lit(1)).alias("copies"))
    ranked = numbered(one, [F.col("key")], [F.col("page_id"), F.col("url")], "seq", F.col("digest"))
    return cut_lineage(ranked.withColumn("address", F.md5(F.concat("key", F.lit("#"), F.col("seq").cast("string")))).drop("seq"))


def depth_for(*sizes: int) -> int:
    """Levels between the root and the segments of archives of these numbers of records."""
    return max(1, len(f"{max(max(sizes) - 1, 0):x}") - 1)


def archive(own: DataFrame, depth: int) -> Archive:
    """Lays out the records of ``entries`` and hashes them into a tree of ``depth`` levels above the segments."""
    inside = Window.partitionBy("segment").orderBy("address")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(own.withColumn("segment", F.substring("address", 1, depth)).select(
        "page_id", "url", "key", "address", "segment", (F.row_number().over(inside) - 1).cast("long").alias("record_no"),
        F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long").alias("offset"), "length", "copies", "digest"))
    leaf = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("address", "offset", "length", "copies", "digest")]), 256)
    levels = [_hashed(placed.select(F.col("segment").alias("node"), F.col("address").alias("child"), leaf.alias("hash")))]
    for k in range(depth - 1, -1, -1):
        levels.append(_hashed(levels[-1].select(F.substring("node", 1, k).alias("node"), F.col("node").alias("child"), "hash")))
    return Archive(placed, levels)


def _hashed(children: DataFrame) -> DataFrame:
    """(node, hash) from (node, child, hash): the hash of the children's hashes in order."""
    up = children.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("child", "hash"))).alias("c"))
    return cut_lineage(up.select("node", F.sha2(F.concat_ws("", F.transform("c", lambda x: x["hash"])), 256).alias("hash")))


def differing(own: Archive, other: Archive) -> DataFrame:
    """(node) of the segments that differ, found by descending mismatching branches."""
    suspect, depth = None, 0
    for a, b in zip(reversed(own.levels), reversed(other.levels)):
        if suspect is not None:
            parent = F.substring("node", 1, depth - 1)
            a, b = (x.join(suspect, parent == F.col("parent"), "left_semi") for x in (a, b))
        pair = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), "node", "full_outer")
        suspect = cut_lineage(pair.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("node").alias("parent")))
        depth += 1
    return suspect.withColumnRenamed("parent", "node")


def audit(own: Archive, other: Archive) -> DataFrame:
    """(key, digest, state, held) of the records that differ; ``held``: copies that both archives have."""
    bad = differing(own, other).withColumnRenamed("node", "segment")
    side = lambda x, a, b: x.placed.join(bad, "segment", "left_semi").select(
        "key", "digest", (F.col("copies") * a).alias("a"), (F.col("copies") * b).alias("b"))
    both = side(own, 1, 0).unionByName(side(other, 0, 1)).groupBy("key", "digest").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = cut_lineage(both.filter("a <> b"))
    pages = both.groupBy("key").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("lost"),
                                    F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("new"))
    state = F.when((F.col("a") > F.col("b")) & (F.col("new") > 0), "altered").when(F.col("a") > F.col("b"), "missing").when(F.col("lost") == 0, "extra")
    found = both.join(pages, "key").select("key", "digest", state.alias("state"), F.least("a", "b").alias("held"))
    return found.filter("state IS NOT NULL")        # the other version of an altered record


def compare(records: DataFrame, replica: DataFrame) -> tuple[Archive, DataFrame]:
    """The archive of ``records`` and its ``audit`` against the archive of ``replica``, both (page_id, url, record)."""
    mine, theirs = entries(records), entries(replica)
    depth = depth_for(mine.count(), theirs.count())
    own = archive(mine, depth)
    return own, audit(own, archive(theirs, depth))


def op7(pages: DataFrame) -> DataFrame:
    """Audit of a damaged replica of the archive of ``pages``, archived on its own.

    The replica is derived from the data: records whose page id has an md5
    that starts with 07 lost their last 9 bytes, those with 08 have their
    first byte changed, those with 09 are gone. One row per distinct record.
    """
    records = warc_records(pages)
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    damaged = F.when(mark == "07", F.expr("left(record, length(record) - 9)")).when(mark == "08", F.expr("'w' || substring(record, 2)")).otherwise(F.col("record"))
    own, found = compare(records, records.filter(mark != "09").withColumn("record", damaged))
    segments = own.levels[0].select(F.col("node").alias("segment"), F.col("hash").alias("segment_hash"))
    root = own.levels[-1].select(F.col("hash").alias("root"))       # one row
    return (own.placed.join(found, ["key", "digest"], "left").join(segments, "segment").crossJoin(F.broadcast(root))
            .select("page_id", "url", "address", "segment", "record_no", "offset", "length", "copies", "digest", "segment_hash", "root",
                    F.coalesce("state", F.lit("intact")).alias("state")))


_DEEPEST = 12       # levels written out in the statement: archives of up to 16^13 records
_LEVELS = ",\n".join(
    f"n{k} AS (SELECT side, segment AS node, hash FROM leaf WHERE len(segment) = {k} UNION ALL "
    f"SELECT side, left(node, {k}) AS node, sha256(string_agg(hash, '' ORDER BY node)) AS hash FROM n{k + 1} GROUP BY 1, 2)"
    for k in range(_DEEPEST - 1, -1, -1))
_DIFFER = ",\n".join(
    f"b{k} AS (SELECT coalesce(x.node, y.node) AS node FROM (SELECT * FROM n{k} WHERE side = 0) x FULL JOIN (SELECT * FROM n{k} WHERE side = 1) y "
    f"ON x.node = y.node WHERE x.hash IS DISTINCT FROM y.hash{f' AND left(coalesce(x.node, y.node), {k - 1}) IN (SELECT node FROM b{k - 1})' if k else ''})"
    for k in range(_DEEPEST + 1))
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, url, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS g FROM pages),
w AS (SELECT page_id, url, g, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha256:' || sha256(u || chr(10) || h)
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || CAST(strlen(h) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM p),
both_sides AS (SELECT 0 AS side, page_id, url, record FROM w UNION ALL
    SELECT 1, page_id, url, CASE substr(g, 1, 2) WHEN '07' THEN left(record, length(record) - 9) WHEN '08' THEN 'w' || substr(record, 2) ELSE record END
    FROM w WHERE substr(g, 1, 2) <> '09'),
e AS (SELECT side, page_id, url, md5(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || coalesce(url, '')) AS key, CAST(strlen(record) AS BIGINT) AS length,
    sha256(record) AS digest, count(*) AS copies FROM both_sides GROUP BY ALL),
a AS (SELECT *, md5(key || '#' || CAST(row_number() OVER (PARTITION BY side, key ORDER BY digest, page_id NULLS FIRST, url NULLS FIRST) - 1 AS VARCHAR)) AS address FROM e),
deep AS (SELECT greatest(1, len(printf('%x', greatest(max(n) - 1, 0))) - 1) AS d FROM (SELECT count(*) AS n FROM a GROUP BY side)),
s AS (SELECT *, left(address, d) AS segment FROM a CROSS JOIN deep),
o AS (SELECT *, row_number() OVER (PARTITION BY side, segment ORDER BY address) - 1 AS record_no, CAST(coalesce(sum(length * copies) OVER (
    PARTITION BY side, segment ORDER BY address ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s),
leaf AS (SELECT side, segment, sha256(string_agg(sha256(concat_ws('|', address, "offset", length, copies, digest)), '' ORDER BY address)) AS hash FROM o GROUP BY 1, 2),
n{_DEEPEST} AS (SELECT side, segment AS node, hash FROM leaf WHERE len(segment) = {_DEEPEST}),
{_LEVELS},
{_DIFFER},
x AS (SELECT key, digest, CAST(sum(CASE side WHEN 0 THEN copies ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE side WHEN 1 THEN copies ELSE 0 END) AS BIGINT) AS b
    FROM o WHERE segment IN ({" UNION ALL ".join(f"SELECT node FROM b{k} WHERE len(node) = (SELECT d FROM deep)" for k in range(1, _DEEPEST + 1))}) GROUP BY 1, 2),
y AS (SELECT key, sum(greatest(b - a, 0)) AS fresh FROM x GROUP BY 1)
SELECT o.page_id, o.url, o.address, o.segment, o.record_no, o."offset", o.length, o.copies, o.digest, leaf.hash AS segment_hash, (SELECT hash FROM n0 WHERE side = 0) AS root,
  CASE WHEN x.a > x.b AND y.fresh > 0 THEN 'altered' WHEN x.a > x.b THEN 'missing' ELSE 'intact' END AS state
FROM o JOIN leaf ON leaf.side = 0 AND leaf.segment = o.segment LEFT JOIN x ON x.key = o.key AND x.digest = o.digest LEFT JOIN y ON y.key = o.key WHERE o.side = 0
"""
