"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

import pytest

from murmuration.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] of rows (doc_id, text, lang, source, n_chars)."""
    def spell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, small=False):
        text = r[1]
        if small and text is not None:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return H("".join(map(spell, (r[0], r[3], r[2], r[4], text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def climb(levels, i, folded):
        proof = ""
        for level in levels[:-1]:
            run = level[i // 16 * 16:i // 16 * 16 + 16]
            proof += "".join(run[:i % 16] + run[i % 16 + 1:])
            folded = H("".join(run[:i % 16] + [folded] + run[i % 16 + 1:]))
            i //= 16
        return proof, folded

    groups = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = [sorted((r for r in rows if r[3] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups]
    trees = [tree([leaf(r) for r in g]) for g in held]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, (g, t) in enumerate(zip(held, trees)):
        for i, r in enumerate(g):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            low, folded = climb(t, i, leaf(r, hit))
            high, folded = climb(top, j, folded)
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], H(low + high), folded, folded == top[-1][0]))
    return out


def run(spark, rows):
    return [tuple(r) for r in manifest.op11(spark.createDataFrame(rows, SCHEMA)).collect()]


def many(n, source):
    return [(i * 7 % 1009 + 5000 * (i // 1009), f"Text {i} é\nZ", "en", source, i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [(1, "One", "en", "a", 3)],
    many(17, "a"),
    many(300, "a") + [(i, f"T{i}", None, f"s{i}", 1) for i in range(40)] + [(9, "B", "de", None, 1)] + many(5, "ß"),
    [(None, "X", "en", "a", 1), (None, "X", "en", "a", 1), (5, None, None, None, None), (5, None, None, None, None), (5, "", "", "", 0), (20, "A" * 50_000, "en", "a", 50_000)],
])
def test_manifest_equals_plain_tree(spark, rows):
    assert sorted(run(spark, rows), key=repr) == sorted(plain(rows), key=repr)


def test_copies_of_nodes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(manifest, "CLIMBERS", 3)
    rows = many(290, "a") + many(20, "b")
    assert sorted(run(spark, rows)) == sorted(plain(rows))


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "A", "en", "s", 1, 2, "x"), (5, "B", "en", "s", 1, 3, "y")], SCHEMA + ", leaf long, `group` string")
    got = manifest.op11(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain([(1, "A", "en", "s", 1), (5, "B", "en", "s", 1)]))


def test_proof_is_the_siblings(spark):
    rows = many(18, "a")
    got = {r["doc_id"]: r for r in manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()}
    first, last = got[min(got)], got[max(got)]
    assert (len(first["proof"]), len(last["proof"])) == (32 * 16, 32 * 2)
