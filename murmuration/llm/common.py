"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a task are handed to numpy in slices of about this many bytes of
# text (one row at least), which bounds a worker's memory; texts stay whole.
SLICE_BYTES = 2 << 20

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
          "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
          "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


# rows of a materialised table that may be broadcast (about 30 MB of ids)
BROADCAST_ROWS = 1_000_000


def sized(table: DataFrame) -> DataFrame:
    """A materialised table of ids, marked for broadcast if it has at most BROADCAST_ROWS rows; else as it is."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)), F.lit(-1))


def unused(name: str, columns: Sequence[str]) -> str:
    """``name``, or a variant of it that no column has (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch in row slices of about SLICE_BYTES of text, with the texts (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        first = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > SLICE_BYTES:
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(t) + 1
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def map_texts(df: DataFrame, fn: Callable, schema: dict[str, str], text: str = "text",
              setup: Callable | None = None, finish: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over text slices.

    ``fn(rows, texts, state)`` gets a RecordBatch slice, its texts and what
    ``setup()`` made for the task; it returns one column (array or list) per
    field of ``schema``, or None. ``finish(state)`` may add last rows.
    """
    at = df.columns.index(text)
    out = pa.schema([(k, _ARROW[v]) for k, v in schema.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None

        def pack(cols):
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
        for rows, texts in slices(batches, at):
            cols = fn(rows, texts, state)
            if cols is not None:
                yield pack(cols)
        if finish:
            cols = finish(state)
            if cols is not None:
                yield pack(cols)

    return df.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in schema.items()))


def byte_table(separators: Sequence[int]) -> np.ndarray:
    """Lower-cases A-Z and sends separator bytes to 0; other bytes stay."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


# words are runs outside ASCII white space
SPACE_TABLE = byte_table([32, *range(9, 14)])
# words are runs of ASCII digits, letters and non-ASCII characters
ALNUM_TABLE = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_P = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            out = np.ones(size, np.uint64)
            m = 1
            while m < size:   # doubling
                out[m:2 * m] = out[:m] * np.uint64(pow(base, m, 1 << 64))
                m *= 2
            _POWERS[k] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a few whole texts as flat arrays.

    ``blob``: translated bytes; ``start``, ``end``: word limits in it;
    ``doc``: row of each word; ``hash``: 64-bit polynomial hash of each word,
    mixed. ``count``: words per row; ``first``: index of each row's first word.
    """

    def __init__(self, texts: list[str], table: np.ndarray):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.blob = np.frombuffer(b"\n".join(raw).translate(table.tobytes()) + b"\0", np.uint8)
        at = np.flatnonzero(np.diff((self.blob != 0).view(np.int8), prepend=np.int8(0)))
        self.start, self.end = at[::2], at[1::2]
        offset = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, offset[:-1])
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        up, down = _powers(len(self.blob) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.blob * up[:len(self.blob)], dtype=np.uint64)])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def word(self, i: int) -> bytes:
        return self.blob[self.start[i]:self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word runs inside a row, and the index of each run's first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j:j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return mix(h[at]), at


def numbered(df: DataFrame, groups: list[Column], order: list[Column], name: str, digest: Column) -> DataFrame:
    """0-based position inside each group, in the order (digest, order).

    ``digest`` is a hex string that spreads rows evenly (md5 of an id); its
    first three digits split every group into 4,096 parts that are numbered
    apart and offset by the sizes of the parts before, so one group with a
    third of all rows is not sorted by one task. Equal digests stay together:
    copies of one row share a part.
    """
    cols = df.columns
    g, p, d, k, off, n = (unused(f"_{x}", cols) for x in "gpdkon")
    keyed = df.withColumns({g: F.struct(*groups), d: digest}).withColumn(p, F.substring(d, 1, 3))
    sizes = keyed.groupBy(g, p).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(g, p, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    inside = Window.partitionBy(g, p).orderBy(F.col(d), *order)
    local = keyed.withColumn(k, F.row_number().over(inside) - 1)
    # at most 4,096 rows per group on the right: the planner picks the join by size
    left, right = local.alias("l"), starts.alias("r")
    joined = left.join(right, F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) & (F.col(f"l.{p}") == F.col(f"r.{p}")))
    return joined.select(*[F.col(f"l.`{c}`") for c in cols], (F.col(f"l.{k}") + F.col(f"r.{off}")).cast("long").alias(name))
