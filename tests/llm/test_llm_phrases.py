"""Phrases against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from murmuration.llm import phrases


def plain(rows, least=30, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = [p for p in f if len(p) > 2 and f[p] >= least]
    inside = {}
    for p in found:
        w = p[1:]
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    key = (p[0], *w[i:j])
                    inside[key] = max(inside.get(key, 0), f[p])
    out = []
    for p in found:
        if 100 * inside.get(p, 0) >= 80 * f[p]:
            continue
        score, _, l, r = min((2000000 * f[p] // (f[p[:k + 1]] + f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1))
        out.append((p[0], " ".join(p[1:]), f[p], l, r, n[p[0]], score))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return ranked


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string")
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


def corpus():
    rnd = np.random.default_rng(5)
    words = ["the", "of", "new", "york", "city", "é", "ñandú", "x\x00y", "﻿w", "a" * 300, "z-9"]
    weight = np.arange(len(words), 0, -1.0)
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words, 60, p=weight / weight.sum()))
        text = text.replace("york the", "york. the").replace("of new", "of\tNEW\n").replace("city of", "city\x0bof", 1)
        rows.append((text, ["en", "fr", None, ""][i % 4]))
    return rows + [(None, "en"), ("", None), (" \t.,", "fr"), ("one", "xx"), ("b " * 5000, "en"), (rows[0][0], "en"), (rows[0][0], "en")]


@pytest.mark.parametrize("least,top", [(3, 2000), (30, 4)])
def test_equals_plain_counting(spark, least, top):
    rows = corpus()
    assert run(spark, rows, least=least, top=top) == sorted(plain(rows, least, top))


def test_tiny_bounds_change_nothing(spark, monkeypatch):
    """Full filters, no numbers, every pair hot, and buffers and batches of a few rows."""
    rows = corpus()[:40]
    want = sorted(plain(rows, 5))
    for name, value in (("BUFFER", 2000), ("ROUTED", 50), ("HOT", 1 << 40), ("NUMBERED", 4), ("FILTER_BITS", 1 << 15)):
        monkeypatch.setattr(phrases, name, value)
    assert run(spark, rows, least=5) == want


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([("a b " * 40, "en", 1, 2)], "text string, lang string, `key` int, lang_key int")
    got = phrases.op12(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain([("a b " * 40, "en")])


def test_large_counts_stay_exact(spark):
    """Scores of counts whose products pass 64 bits."""
    row, words, n = phrases.three_way(np.array([[1, 2, 3, 0, 0], [1, 2, 3, 4, 0], [1, 2, 3, 4, 5], [1, 9, 3, 0, 0]], np.uint64),
                                      np.array([20, 10, 5, 29]), np.array([20, 10, 5, 29]), 15)
    assert sorted(zip(words.tolist(), n.tolist())) == [(2, 29), (2, 35), (3, 15)]
