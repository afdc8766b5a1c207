"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has one bit per bit of its shingles' 64-bit hashes: 1 if
it is set in over half of them. Texts are linked where their fingerprints
differ in RADIUS bits or fewer, and links form components.

Distinct fingerprints are dealt to cells by the population counts of their
PARTS parts of 16 bits. Two fingerprints that differ in r bits have
population counts that differ by r in all at most, so only tiles of cells
within the radius are compared and all other tile pairs are skipped. Cells are
cut into tiles of about TILE fingerprints, and each remaining pair of tiles is
compared in full by exclusive-or and bit counts. No pair within the radius is
lost, whatever the fingerprints look like. The counts of the cells, 17^PARTS
at most, are the only broadcast.

A pair of tiles returns a spanning forest of its links, not all of them, so a
dense group gives as many links as it has fingerprints.

Defined results: null texts and texts without words have fingerprint zero,
which is linked like any other; repeated rows share a component; a null id is
the smallest of a component only where no other id is in it; an empty table
has no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import map_texts
from murmuration.llm.graph import components
from murmuration.operators.skew import join_heavy
from murmuration.session import cut_lineage

SHINGLE = 3
RADIUS = 2
SEED = 42
PARTS = 4
TILE = 4096
PIECE = 1 << 15     # shingles whose bits are counted at once
BLOCK = 1 << 20     # fingerprint pairs compared at once


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """The fingerprint of a text's k-word shingles, repeats included, as an unsigned integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()    # bytes: A-Z and ASCII white space only
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(words) < k:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[:len(words) - k + 1], end[k - 1:]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(start), PIECE):
        hashes = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(start[lo:lo + PIECE].tolist(), end[lo:lo + PIECE].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """(id, fp) of every row; fp: the fingerprint's 64 bits as a long, id as text."""
    def fn(rows, texts, _):
        return [rows.column(0), np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    return map_texts(rows, fn, {"id": "string", "fp": "long"})


def forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same of the nodes 0 to n - 1 as (u, v): each node that is not the smallest of its group, with the smallest."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def tile_links(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints (uint64), in blocks of rows."""
    both, n = np.concatenate([x, y]), len(x)
    u = v = np.zeros(0, np.int64)
    step = max(1, BLOCK // max(1, len(y)))
    for lo in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(x[lo:lo + step, None] ^ y[None]) <= radius)
        if len(i):
            u, v = np.concatenate([u, i + lo]), np.concatenate([v, j + n])
            if len(u) > len(both):
                u, v = forest(u, v, len(both))
    other = both[u] != both[v]
    return both[u[other]], both[v[other]]


def _ragged(column: pa.Array) -> Iterator[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:b].view(np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist()))


def steps(radius: int) -> list[tuple[int, ...]]:
    """The distances of PARTS population counts within the radius, one of each two opposite ones."""
    zero = (0,) * PARTS
    return [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius and s >= zero]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v) that connect all distinct fingerprints ``nodes`` (fp) as their differences of ``radius`` bits or fewer do."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * p).bitwiseAND(F.lit(0xFFFF))) for p in range(PARTS)]
    cell = sum((c * 17 ** p for p, c in enumerate(counts[1:], 1)), counts[0]).cast("int")
    own = nodes.select("fp", cell.alias("cell"))
    # 17^PARTS rows at most
    tiles = cut_lineage(own.groupBy("cell").agg(F.expr(f"(count(1) + {tile - 1}) div {tile}").cast("int").alias("tiles")))
    held = own.join(F.broadcast(tiles), "cell").groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("part"))
    held = cut_lineage(held.agg(F.collect_list("fp").alias("mine")))    # about ``tile`` values each
    # each tile goes to the tiles of its own cell from its own on, and to all of the cells one step away
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{p}") for p, d in enumerate(s)]) for s in steps(radius)]))
    moved = held.withColumn("s", step)
    place = [F.expr(f"cell div {17 ** p} % 17") + F.col(f"s.d{p}") for p in range(PARTS)]
    inside = F.lit(True)
    for x in place:
        inside &= x.between(0, 16)
    to = sum((x * 17 ** p for p, x in enumerate(place[1:], 1)), place[0]).cast("int")
    moved = moved.filter(inside).withColumn("to", to)
    moved = moved.join(F.broadcast(tiles.withColumnRenamed("cell", "to")), "to")
    moved = moved.withColumn("at", F.explode(F.sequence(F.when(F.col("to") == F.col("cell"), F.col("part")).otherwise(0), F.col("tiles") - 1)))
    pairs = moved.select("to", "at", "mine").join(held.select(F.col("cell").alias("to"), F.col("part").alias("at"), F.col("mine").alias("theirs")), ["to", "at"])

    def search(batches):
        for batch in batches:
            found = [tile_links(x, y, radius) for x, y in zip(_ragged(batch.column("mine")), _ragged(batch.column("theirs")))]
            u, v = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return pairs.select("mine", "theirs").mapInArrow(search, "u long, v long")


def simhash_components(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(id_col, fp, component_id) of every row: its fingerprint, and the smallest id that its links reach."""
    key = dict(docs.dtypes)[id_col]
    rows = fingerprints(docs, k, id_col, text)
    rows = cut_lineage(rows.select(F.col("id").cast(key).alias("id"), "fp"))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    label = components(cut_lineage(links(nodes.select("fp"), radius, tile))).withColumnRenamed("node", "fp")
    named = cut_lineage(nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut_lineage(named.join(least, "label").select("fp", "n", "component_id"))
    return join_heavy(rows, named, "fp", "n", rows.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def op13(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint in hex and its component's smallest id."""
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP13_SQL = None
