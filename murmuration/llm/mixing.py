"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's rows are numbered in a hashed order and cut into blocks of
BLOCK_ROWS. With a source's share w of all weights, its block j has release
time floor(j / w) and deadline ceil((j + 1) / w); earliest deadline first
among the released blocks (Baruah et al., 1996) gives every slot to one block,
and every block a slot in its window, so in every prefix of the mixture each
source that still lasts is less than one block off its given share. Weights
are taken as the exact fractions they are; nothing is rounded. A source that
has ended leaves the schedule: its slots go to released blocks or stay empty,
and the others keep their windows. Every row is placed exactly once.

The schedule is a table of one row per block. One task writes it from the
sources' counts, in batches, holding two numbers per source; the rows
themselves are numbered and joined in parallel.

Defined results: a null source is a source of its own; repeated rows are
placed one by one; an empty table gives an empty mix; sources the given
weights leave out, or give no positive weight, raise an error. Sources may
be any number.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import numbered, sized, unused
from murmuration.session import cut_lineage

BLOCK_ROWS = 32
ROOT_SCALE = 1 << 20      # default weights: square roots in whole parts of this
BATCH = 1 << 16


def whole(weights: list) -> list[int]:
    """Whole numbers in exactly the ratio of ``weights`` (int, float or Fraction)."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in exact))
    return [int(x * common) for x in exact]


def slots(shares: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, its block, slot) in slot order; ties of deadlines go to the earlier source."""
    total = sum(shares)
    waiting = [(0, i) for i, n in enumerate(blocks) if n]      # (release, source), a heap
    ready: list[tuple[int, int]] = []                          # (deadline, source)
    had, t = [0] * len(shares), 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(had[i] + 1) * total // shares[i]), i))
        i = heapq.heappop(ready)[1]
        yield i, had[i], t
        had[i] += 1
        t += 1
        if had[i] < blocks[i]:
            heapq.heappush(waiting, (had[i] * total // shares[i], i))


def schedule(counts: DataFrame, weights: dict | None, names: tuple[str, str, str], block_rows: int) -> DataFrame:
    """(source, block, slot), one row per block, from ``counts`` (source mark, rows)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        if not rows:
            return
        share = [int(math.sqrt(n) * ROOT_SCALE) for _, n in rows] if weights is None else whole([weights[s] for s, _ in rows])
        every = slots(share, [-(-n // block_rows) for _, n in rows])
        while some := list(itertools.islice(every, BATCH)):
            i, k, t = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array([rows[x][0] for x in i]), pa.array(k, pa.int64()), pa.array(t, pa.int64())], names=list(names))

    src, block, slot = names
    return counts.coalesce(1).mapInArrow(run, f"`{src}` string, `{block}` long, `{slot}` long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id_col: str = "doc_id",
        text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` plus (mix_block, mix_slot, mix_row): order by (mix_slot, mix_row) to read the mixture.

    ``weights``: source -> positive weight; by default the square root of its row count.
    """
    names = []
    for n in ("mix_block", "mix_slot", "mix_row", "_source", "_n"):
        names.append(unused(n, [*docs.columns, *names]))
    block, slot, row, src, n = names
    # a leading mark keeps a null source apart from every name
    marked = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))
    own = docs.withColumn(src, marked)
    counts = own.groupBy(src).agg(F.count(F.lit(1)).alias(n))
    by_mark = None
    if weights is not None:
        by_mark = {("-" if k is None else "+" + k): v for k, v in weights.items() if v > 0}
        counts = cut_lineage(counts)
        bad = [r[0] for r in counts.filter(~F.col(src).isin(*by_mark)).limit(5).collect()]
        if bad:
            raise ValueError(f"no positive weight for sources {bad}")
    # one row per block: stored, and broadcast only up to a counted size
    table = sized(cut_lineage(schedule(counts, by_mark, (src, block, slot), block_rows)))
    digest_of = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    placed = numbered(own, [F.col(src)], [F.col(id_col), F.xxhash64(F.col(text))], n, digest_of)
    placed = placed.withColumns({block: F.expr(f"`{n}` div {block_rows}"), row: F.col(n) % block_rows})
    return placed.join(table, [src, block]).select(*[F.col(f"`{c}`") for c in docs.columns], block, slot, row)


def op6(docs: DataFrame) -> DataFrame:
    """The whole table mixed by the default weights: one row per document with its block, slot and place in the block."""
    return mix(docs.select("doc_id", "source", "text")).drop("text")


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS s,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS g, text FROM documents),
q AS (SELECT s, CAST(floor(sqrt(count(*)) * {ROOT_SCALE}) AS BIGINT) AS a, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS m FROM d GROUP BY s),
z AS (SELECT list(s ORDER BY s) AS s, list(a ORDER BY s) AS a, list(m ORDER BY s) AS m, CAST(sum(a) AS BIGINT) AS w, count(*) AS n FROM q),
-- one row per block: how many blocks each source has had, and whose turn it is
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS had, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS k FROM z
  UNION ALL
  SELECT now, list_transform(had, lambda x, j: CASE WHEN j = turn THEN x + 1 ELSE x END), turn, had[turn]
  FROM (SELECT now, had, list_min([(CASE WHEN had[j] < z.m[j] AND had[j] * z.w // z.a[j] <= now
            THEN (((had[j] + 1) * z.w + z.a[j] - 1) // z.a[j]) * 100000 + j END) FOR j IN range(1, z.n + 1)]) % 100000 AS turn
        FROM (SELECT had, greatest(t + 1, list_min([(CASE WHEN had[j] < z.m[j] THEN had[j] * z.w // z.a[j] END) FOR j IN range(1, z.n + 1)])) AS now,
                     list_min([(CASE WHEN had[j] < z.m[j] THEN 1 END) FOR j IN range(1, z.n + 1)]) AS more FROM edf, z) x, z WHERE more = 1) y),
f AS (SELECT z.s[pick] AS s, k, t AS slot FROM edf, z WHERE t >= 0),
n AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY s ORDER BY g, doc_id, text) - 1 AS n FROM d)
SELECT doc_id, source, n // {BLOCK_ROWS} AS mix_block, slot AS mix_slot, n % {BLOCK_ROWS} AS mix_row
FROM n JOIN f ON f.s = n.s AND f.k = n // {BLOCK_ROWS}
"""
