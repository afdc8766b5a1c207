"""SimHash against plain fingerprints and all pairs."""

import random

import brute
import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from murmuration.llm import simhash


def plain_fingerprint(t, k=3):
    w = brute.words(t)
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_parts(values, radius=2):
    """The component number of each value, all pairs compared."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def plain(docs):
    values = [plain_fingerprint(t or "") for _, t in docs]
    least = {}
    parts = plain_parts(values)
    for (i, _), p in zip(docs, parts):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(((i, f"{v:016x}", least.get(p)) for (i, _), v, p in zip(docs, values, parts)), key=repr)


def run(spark, docs):
    return sorted((tuple(r) for r in simhash.op13(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)


def test_equals_plain_version(spark):
    docs = [*cases.pairs(), (9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "One"), (9005, "two words"), (9006, "a\x00b c d e"), (9007, "ÀB c   d")]
    docs += [(9100, cases.prose(3, 30_000)), (9101, cases.prose(3, 30_000) + " tail"), (9100, "again"), (None, "again"), (None, "alone in the world of texts")]
    assert run(spark, docs) == plain(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_fingerprint_in_pieces(monkeypatch):
    text = cases.prose(4, 3000)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_spark_hash_is_the_contracts(spark):
    got = spark.createDataFrame([("ab cd é",)], "x string").select(F.xxhash64("x")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


@pytest.mark.parametrize("tile", [5, 4096])
def test_links_lose_no_pair(spark, tile):
    """Dense clusters, chains of two-bit steps, and strangers, in tiles of any size."""
    rnd = random.Random(tile)
    values = {0, (1 << 64) - 1, 1 << 63, 1, 3}
    for _ in range(12):
        x = rnd.getrandbits(64)
        values |= {x ^ (1 << a) ^ (1 << b) for a, b in (rnd.sample(range(64), 2) for _ in range(8))}
        for _ in range(10):
            values.add(x)
            x ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, 2, tile)).collect()}
    parts = plain_parts(values)
    groups = {}
    for v, p in zip(signed, parts):
        groups.setdefault(p, set()).add(label.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_forest_keeps_the_groups():
    rnd = np.random.default_rng(3)
    u, v = rnd.integers(0, 300, 200), rnd.integers(0, 300, 200)
    a, b = simhash.forest(u, v, 300)
    assert len(a) < 300 and len(set(a.tolist())) == len(a)

    def parts(u, v):
        p = list(range(300))

        def find(x):
            while p[x] != x:
                x = p[x]
            return x
        for x, y in zip(u.tolist(), v.tolist()):
            x, y = find(x), find(y)
            p[max(x, y)] = min(x, y)
        return [find(x) for x in range(300)]
    assert parts(u, v) == parts(a, b)
