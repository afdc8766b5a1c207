"""Quality rules, line and document deduplication, decontamination and mixing against brute force."""

import collections
import itertools
from fractions import Fraction

import brute
import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import decontam, linededup, lists, mixing, neardup, quality


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_quality_statistics(docs, empty):
    got = quality.op3(docs).collect()
    want = [(i, brute.quality(t)) for i, t in cases.pairs()]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same([[r["doc_id"], *[r[n] for n in names]] for r in got], [[i, *[q[n] for n in names]] for i, q in want])
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.op3(empty).collect() == []


def test_quality_keeps_prose_and_rejects_junk(spark):
    good = cases.prose(1, 200) + "\n" + cases.prose(2, 100)
    junk = [" | ".join(cases.prose(3, 200).split()), " ".join(w + "!!" for w in cases.prose(4, 200).upper().split()),
            " ".join(w + "###" for w in cases.prose(5, 200).split()), "\n".join(["the same line of the text"] * 60)]
    df = spark.createDataFrame([(0, good)] + [(i + 1, t) for i, t in enumerate(junk)], "doc_id long, text string")
    assert [r["doc_id"] for r in quality.filter_quality(df).collect()] == [0]


def test_quality_filter_keeps_columns(docs, empty):
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and quality.filter_quality(empty).columns == docs.columns
    kept = collections.Counter(r["doc_id"] for r in quality.op3(docs).collect() if r["kept"])
    assert collections.Counter(r["doc_id"] for r in out.collect()) == kept


def test_near_duplicates(docs, empty):
    got = neardup.op9(docs).collect()
    want = brute.near_duplicates(cases.pairs())
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.op9(empty).collect() == []


def test_near_duplicates_with_every_list_large(docs, monkeypatch):
    """Tiny bounds send the lists through dealing and rounds; the links stay the same."""
    monkeypatch.setattr(neardup._Search, "small", 2)
    monkeypatch.setattr(lists, "ROUND_PAIRS", 40_000)
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.op9(docs).collect()], brute.near_duplicates(cases.pairs()))


def test_small_sets_at_the_threshold(spark):
    """4 of 5 shingles: short prefixes are certain to meet."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "z b c d e f g"), (4, "a b c d e f"), (5, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.op9(df).collect()], brute.near_duplicates(rows))


def test_keep_one(docs, empty):
    out = neardup.keep_one(docs, k=4)
    assert out.columns == docs.columns
    kept = collections.Counter(r["doc_id"] for r in out.collect())
    want = collections.Counter({i for i, n, c in brute.near_duplicates(cases.pairs()) if i == c and i is not None})
    assert {k: v for k, v in kept.items() if k is not None} == want
    assert neardup.keep_one(empty).collect() == []


def test_line_dedup(docs, empty):
    got = {(r["doc_id"], r["n_lines"]): list(r["dropped"]) for r in linededup.op5(docs).collect() if r["n_dropped"]}
    want = {(i, len(t.split("\n"))): v for (i, t), v in brute.dropped_lines(cases.pairs()).items()}
    assert got == want
    assert linededup.op5(empty).collect() == []


def test_line_dedup_with_every_list_large(docs, monkeypatch):
    monkeypatch.setattr(linededup._Search, "small", 2)
    monkeypatch.setattr(linededup, "BOUND", 3)
    monkeypatch.setattr(lists, "ROUND_PAIRS", 40_000)
    got = {(r["doc_id"], r["n_lines"]): list(r["dropped"]) for r in linededup.op5(docs).collect() if r["n_dropped"]}
    assert got == {(i, len(t.split("\n"))): v for (i, t), v in brute.dropped_lines(cases.pairs()).items()}


def test_drop_duplicate_lines(docs, empty):
    out = linededup.drop_duplicate_lines(docs)
    assert out.columns == docs.columns and linededup.drop_duplicate_lines(empty).collect() == []
    gone = brute.dropped_lines(cases.pairs())
    want = []
    for i, t in cases.pairs():
        drop = gone.get((i, t))
        new = t if drop is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop)
        if drop is None or new.strip(" \t\n\x0b\f\r"):
            want.append((i, new, None if new is None else len(new)))
    same([(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()], want)


def test_line_dedup_plan_has_no_python(docs):
    found = linededup.lines(docs.select("doc_id", "text"), "doc_id", "text")
    plan = linededup.band_keys(found)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ITEMS = [(1, cases.prose(99, 60)), (2, "A b, C d"), (None, "one"), (4, None), (5, ""), (6, cases.prose(2, 120)[50:400]), (7, "a B c D")]


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_decontamination(spark, docs, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(1))
    monkeypatch.setattr(decontam.contamination, "__defaults__", ("doc_id", "text", block))
    same(decontam.op4(docs, items).collect(), brute.contamination(cases.pairs(), ITEMS))


def test_remove_contaminated(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontam.remove_contaminated(docs, items)
    assert out.columns == docs.columns
    bad = [r[-1] for r in brute.contamination(cases.pairs(), ITEMS)]
    same([(r["doc_id"], r["text"]) for r in out.collect()], [p for p, b in zip(cases.pairs(), bad) if not b])
    assert decontam.op4(empty, items).collect() == []
    assert decontam.remove_contaminated(docs, items.limit(0)).count() == docs.count()


def test_mixing(spark, docs, empty):
    rows = {(r[0], r[3]) for r in cases.rows() if r[0] not in (None, 500)}
    df = spark.createDataFrame(sorted(rows, key=str), "doc_id long, source string").withColumn("text", F.lit("t"))
    out = mixing.mix(df, block_rows=3)
    got = {(r["doc_id"], r["source"]): (r["mix_block"], r["mix_slot"], r["mix_row"]) for r in out.collect()}
    assert len(got) == len(rows)
    marked = lambda rows: {(i, "-" if s is None else "+" + s): v for (i, s), v in rows.items()}
    assert marked(got) == brute.mixture(rows, 3)
    given = {s: w for s, w in zip(sorted({s for _, s in rows}, key=str), [0.1, 3, 0.7, 1e-3, 2.5, 11, 0.3, 5])}
    out = {(r["doc_id"], r["source"]): (r["mix_block"], r["mix_slot"], r["mix_row"]) for r in mixing.mix(df, given, block_rows=2).collect()}
    assert marked(out) == brute.mixture(rows, 2, {"-" if s is None else "+" + s: w for s, w in given.items()})
    # whole mixture: every row once, clashing columns kept
    all_rows = mixing.mix(docs)
    assert all_rows.count() == docs.count() and all_rows.columns[:len(docs.columns)] == docs.columns
    assert mixing.mix(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1.0})


@pytest.mark.parametrize("n", [1, 3, 20, 400, 2000])
def test_every_prefix_is_less_than_one_block_off_the_given_weights(n):
    rng = np.random.default_rng(n)
    given = rng.integers(1, 10**6, n) ** (2 if n == 20 else 1)      # squares: one source near 0.9 beside small ones
    if n == 20:
        given[0] = 9 * given[1:].sum()
    total, had = int(given.sum()), np.zeros(n, np.int64)
    for t, (i, k, at) in enumerate(itertools.islice(mixing.slots([int(x) for x in given], [10**9] * n), 10_000)):
        assert at == t and k == had[i]                                # no slot is empty, blocks come in order
        had[i] += 1
        assert (np.abs(had * float(total) - given * float(t + 1)) < total).all()


def test_weights_are_exact_fractions():
    a = mixing.whole([0.1, 0.3, 1, 2.5])
    assert [Fraction(x, sum(a)) for x in a] == [Fraction(w) / sum(map(Fraction, (0.1, 0.3, 1, 2.5))) for w in (0.1, 0.3, 1, 2.5)]


def test_an_ended_source_leaves_the_others_in_their_windows():
    share, blocks = [97, 2, 1], [5, 40, 30]
    got = list(mixing.slots(share, blocks))
    assert [sum(i == s for i, _, _ in got) for s in range(3)] == blocks
    assert all(k * 100 // share[i] <= t < -(-(k + 1) * 100 // share[i]) for i, k, t in got)
