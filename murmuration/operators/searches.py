"""Searches from all sources of a graph, for exact closeness and betweenness.

The state of such a search (sources x nodes) grows with the square of the
graph, so it never leaves its task: blocks of sources are dealt to parts, and
the arcs go to every part by one shuffle, packed in arrays. A part searches
its blocks one after the other and gives one row a node with its sums; these
meet in one group-by. What moves grows with the arcs, not with the pairs; a
task holds the arcs as numbers and the state of one block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.session import cut_lineage, ship_package

PARTS_PER_CORE = 3      # parts are as many tasks of about the same length
TILE = 1 << 16          # rows of a packed row
CHUNK_BYTES = 1 << 20   # of the state's rows that are gathered at once; they stay in a core's cache
NARROW = 16             # heads whose arcs are added side by side, at least


def parts_of(spark, blocks: int) -> int:
    return max(1, min(blocks, PARTS_PER_CORE * max(spark.sparkContext.defaultParallelism, 1)))


def _packed(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` as sorted arrays of about TILE values, as ints where all values are: every part gets a copy."""
    cols = rows.columns
    known = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.greatest(F.col(c), -1 - F.col(c))).alias(c) for c in cols]).first()
    tiles = -(-max(known["_n"], 1) // TILE)
    # rows with equal first values lie together (they compress well), of one value at most TILE with different last values
    tile = F.pmod(F.xxhash64(cols[0], F.floor(F.col(cols[-1]) / TILE)), F.lit(tiles))
    packed = rows.groupBy(tile.alias("_tile")).agg(F.sort_array(F.collect_list(F.struct(
        *[F.col(c).cast("int").alias(c) if known[c] is not None and known[c] < 1 << 31 else F.col(c) for c in cols]))).alias("_rows"))
    return cut_lineage(packed.select(*[F.col(f"_rows.{c}").alias(c) for c in cols]))


def deal(parts: int, search: Callable, schema: str, arcs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """What ``search`` gives on every part: it gets all ``arcs`` and ``nodes`` as arrays, and a test of block numbers for its own."""
    ship_package(arcs.sparkSession)
    rows = _packed(arcs)
    names = list(arcs.columns)
    if nodes is not None:
        rows = rows.unionByName(_packed(nodes), allowMissingColumns=True)
        names += nodes.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa
        got, own, first = {c: [np.zeros(0, np.int64)] for c in names}, set(), None
        for batch in batches:
            part = batch.column("part").to_numpy()
            if not len(part):
                continue
            first = part[0] if first is None else first
            own.update(part.tolist())
            if len(own) > 1:    # parts that share a task bring the same rows
                batch = batch.filter(pa.array(part == first))
            for c in names:
                got[c].append(batch.column(c).flatten().to_numpy())
        if not own:
            return
        columns = search({c: np.concatenate(x) for c, x in got.items()}, lambda block: block % parts in own)
        for lo in range(0, len(columns[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + 10_000]) for c in columns], names=out)

    out = [c.split()[0] for c in schema.split(", ")]
    every = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    return every.repartitionById(parts, "part").mapInArrow(run, schema)


class Arcs:
    """Arcs between nodes 0 .. n-1, in the order of their heads."""

    def __init__(self, tail, head, n: int):
        import numpy as np
        order = np.argsort(head.astype(np.int64) * n + tail)
        self.tail, self.head, self.n = tail[order].astype(np.int64), head[order], n
        self.by_tail = np.argsort(self.tail * n + self.head)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.tail, minlength=n))))
        self.into = np.bincount(self.head, minlength=n)
        self.start = np.cumsum(self.into) - self.into
        self.by_into = np.argsort(-self.into, kind="stable")    # heads with most arcs first
        # the first tails of all heads in that order, then the second tails ...
        rank = np.empty(n, np.int64)
        rank[self.by_into] = np.arange(n)
        nth = np.arange(len(self.head)) - self.start[self.head]
        self.column = np.concatenate(([0], np.cumsum(np.bincount(nth))))
        self.columns = np.empty_like(self.tail)
        self.columns[self.column[nth] + rank[self.head]] = self.tail

    def gather(self, ufunc, rows, tails, heads):
        """For the marked ``heads`` (other rows mean nothing), ``ufunc`` over the ``rows`` of their tails; rows of ``tails`` not marked are 0."""
        import numpy as np
        at = np.flatnonzero(tails)
        lo = self.first[at]
        size = self.first[at + 1] - lo
        if size.sum() * 8 > len(self.tail):
            return self._every(ufunc, rows, heads)
        arcs = self.by_tail[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        return self._some(ufunc, rows, np.sort(arcs[heads[self.head[arcs]]]))

    def _every(self, ufunc, rows, heads):
        """Over all arcs into ``heads``, a block of heads at a time: the j-th tails of all of them meet at once."""
        import numpy as np
        out = np.zeros_like(rows)
        whole = 2 * np.count_nonzero(heads) > self.n
        want = self.by_into if whole else self.by_into[heads[self.by_into]]
        want = want[:np.count_nonzero(self.into[want])]
        step = max(1, CHUNK_BYTES // (rows.itemsize * rows.shape[1]))
        held = np.empty((min(step, len(want)), rows.shape[1]), rows.dtype)
        for lo in range(0, len(want), step):
            mine = want[lo:lo + step]
            into, start = self.into[mine], self.start[mine]
            more = np.cumsum(np.bincount(into)[::-1])[::-1]     # at j: how many of these heads have j arcs or more

            def tails_of(j, k):
                return self.columns[self.column[j] + lo:self.column[j] + lo + k] if whole else self.tail[start[:k] + j]
            total = np.take(rows, tails_of(0, len(mine)), axis=0)
            j = 1
            while j < into[0] and more[j + 1] >= NARROW:
                k = more[j + 1]
                # "clip" writes straight into ``held``; no number is out of range
                ufunc(total[:k], np.take(rows, tails_of(j, k), axis=0, out=held[:k], mode="clip"), out=total[:k])
                j += 1
            for i in range(more[j + 1] if j < into[0] else 0):      # the rest of a few heads with many arcs
                end = start[i] + into[i]
                for at in range(start[i] + j, end, step):
                    total[i] = ufunc(total[i], ufunc.reduce(np.take(rows, self.tail[at:min(at + step, end)], axis=0), axis=0))
            out[mine] = total
        return out

    def _some(self, ufunc, rows, arcs):
        """Over the numbered ``arcs`` only."""
        import numpy as np
        out = np.zeros_like(rows)
        step = max(1, CHUNK_BYTES // (rows.itemsize * rows.shape[1]))
        held, last = np.empty((min(step, len(arcs)), rows.shape[1]), rows.dtype), -1
        for lo in range(0, len(arcs), step):
            some = arcs[lo:lo + step]
            head = self.head[some]
            starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
            head = head[starts]
            part = ufunc.reduceat(np.take(rows, self.tail[some], axis=0, out=held[:len(some)], mode="clip"), starts, axis=0)
            if head[0] == last:      # a node's arcs may lie in two chunks
                part[0] = ufunc(part[0], out[last])
            out[head] = part
            last = head[-1]
        return out


def count_arrivals(width: int, masks: int) -> Callable:
    """A search that gives (node, r, s, far): how many sources reach a node, the sum and the largest of their distances.

    Sources are the nodes with arcs out, ``masks`` masks of ``width`` bits a
    block. A step is a bitwise or over the arcs into each node; arrivals are
    the bits that were not set before.
    """
    def search(got, is_own):
        import numpy as np
        names, ends = np.unique(np.concatenate((got["sender"], got["receiver"])), return_inverse=True)
        n, m = len(names), len(got["sender"])
        arcs = Arcs(ends[:m].astype(np.int32), ends[m:].astype(np.int32), n)
        sources = np.unique(arcs.tail)
        r, s, far = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        block = width * masks
        for lo in range(0, len(sources), block):
            if not is_own(lo // block):
                continue
            i = np.arange(len(sources[lo:lo + block]))
            new = np.zeros((n, masks), np.uint64)
            new[sources[lo:lo + block], i // width] = np.uint64(1) << (i % width).astype(np.uint64)
            every = np.bitwise_or.reduce(new, axis=0)
            seen, d = new, 0
            while new.any():
                d += 1
                new = arcs.gather(np.bitwise_or, new, new.any(axis=1), (seen != every).any(axis=1)) & ~seen
                seen = seen | new
                count = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
                r += count
                s += count * d
                far[count > 0] = np.maximum(far[count > 0], d)
        at = np.flatnonzero(r)
        return names[at], r[at], s[at], far[at]
    return search


def count_paths(lanes: int) -> Callable:
    """Brandes' algorithm from ``lanes`` sources at once, giving (node, dep, reached): the nodes' dependencies, and what a source's class reaches.

    A node stands for ``m`` twins, each with ``k`` accounts hung on it that
    reach it and ``e`` that it reaches. Numbers of shortest paths are doubles
    (they can exceed 2^63). A source with twins may come back to its class,
    which then stands for the others. Backwards,
    delta(v) = e(v) + sum over successors w one level deeper of
    m(w) * sigma(v) / sigma(w) * (1 + delta(w)); a class that its own source
    comes back to has a member less.
    """
    def search(got, is_own):
        import numpy as np
        order = np.argsort(got["node"])
        names = got["node"][order]
        m, k, e = (got[c][order].astype(np.float64) for c in ("m", "k", "e"))
        n = len(names)
        tail, head = (np.searchsorted(names, got[c]).astype(np.int32) for c in ("sender", "receiver"))
        arcs, back = Arcs(tail, head, n), Arcs(head, tail, n)
        dep, reached, shift = np.zeros(n), np.zeros(n), lanes.bit_length() - 1
        for lo in range(0, n, lanes):
            if not is_own(lo // lanes):
                continue
            src = np.arange(lo, min(lo + lanes, n))
            j = np.arange(len(src))
            home = src * lanes + j      # places of the sources in a (node, lane) table
            sigma, x, delta = (np.zeros((n, lanes)) for _ in range(3))
            depth = np.full((n, lanes), -1, np.int32)
            depth[:, len(src):] = 0        # no source there
            depth.ravel()[home[m[src] == 1]] = 0
            x.ravel()[home] = 1.0          # one member of its class is the source
            levels, active = [], np.zeros(n, bool)
            active[src] = True
            while True:
                f = arcs.gather(np.add, x, active, (depth < 0).any(axis=1))
                at = np.flatnonzero((f > 0) & (depth < 0))
                if not len(at):
                    break
                node, value = at // lanes if lanes & (lanes - 1) else at >> shift, f.ravel()[at]
                levels.append((at, node))
                sigma.ravel()[at] = value
                depth.ravel()[at] = len(levels)
                x.fill(0)
                x.ravel()[at] = value * m[node]
                active = np.zeros(n, bool)
                active[node] = True
            met = depth.ravel()[home]      # at this level a source comes back to its class
            pulled = np.zeros_like(sigma)
            for level in range(len(levels), 0, -1):
                at, node = levels[level - 1]
                value = sigma.ravel()[at]
                own = e[node] + value * pulled.ravel()[at]
                delta.ravel()[at] = own
                if level > 1:
                    x.fill(0)
                    x.ravel()[at] = m[node] * (1 + own) / value
                    again = met == level
                    x.ravel()[home[again]] = (m[src[again]] - 1) * (1 + delta.ravel()[home[again]]) / sigma.ravel()[home[again]]
                    active, before = np.zeros(n, bool), np.zeros(n, bool)
                    active[node] = True
                    before[levels[level - 2][1]] = True
                    pulled = back.gather(np.add, x, active, before)
            back_home = np.where(met > 0, delta.ravel()[home], 0.0)
            delta.ravel()[home] = 0
            dep += (delta[:, :len(src)] * (m[src] * (k[src] + 1))).sum(axis=1)
            dep[src] += back_home * (m[src] - 1) * (k[src] + 1)
            reached[src] += ((depth[:, :len(src)] > 0) * (m * (1 + e))[:, None]).sum(axis=0) - (met > 0) * (1 + e[src])
        return names, dep, reached
    return search
