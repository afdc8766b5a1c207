"""Token counts, language-model scores, language identification, toxicity and fixity."""

import collections
import math
import zlib

import brute
import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from murmuration.llm import fixity, langid, lm, tokens, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def library_counts(texts):
    t = Tokenizer.from_file(BPE)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_equal_the_library(docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.op2(docs, BPE).collect()))
    texts = [t for _, t in cases.pairs()]
    want = sorted((i is None, i or 0, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(cases.pairs(), library_counts(texts)))
    assert got == want
    assert tokens.op2(docs.limit(0), BPE).collect() == []


def test_token_counts_on_odd_strings():
    odd = ["aaaaaaaaaaaaa", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d \x85  x  y", "हिन्दी 中文字 😀😀 é", "'s 'll don't", "   \n\n\t x", "½²Ⅷ",
           "abababababab", "the the  the", "‍﻿", "ﬁ" * 50]
    odd += [chr(i) + "x " + chr(i) * 3 for i in range(0, 0x3000, 7)]
    assert tokens._Counter(BPE)(odd) == library_counts(odd)


def test_tokens_forget_and_go_on(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    c = tokens._Counter(BPE)
    texts = [cases.prose(s, 50) for s in range(6)]
    assert [c([t])[0] for t in texts] == library_counts(texts)


def lm_words(t):
    return brute.words(t) + [None]


def test_lm_counts_and_base(docs):
    got = by_id(lm.op1(docs).collect())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in cases.pairs() if not held(i) for w in lm_words(t))
    total, kinds = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, t in cases.pairs():
        w = lm_words(t)
        want[i].append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)))
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for i, rows in got.items():
        for r, (n, known, base) in zip(sorted(rows, key=lambda r: r["n_tokens"]), sorted(want[i])):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, held(i))
            assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_lm_probabilities_sum_to_one(spark, docs):
    model = lm.Model(docs.select("text"), steps=20)
    assert np.allclose((10.0 ** model.network.log10().astype(float)).sum(1), 1, atol=1e-4)
    # inside a symbol: known words and the unknown share
    symbol = np.array([lm.ending(w) for w in model.head])
    for z in set(symbol[lm.WORDS:].tolist()):
        n = model.head_n[lm.WORDS:][symbol[lm.WORDS:] == z]
        p = 10.0 ** model.within(n, np.full(len(n), z))
        assert p.sum() + 10.0 ** model.within(np.array([0]), np.array([z]))[0] == pytest.approx(1)


def test_lm_scores_equal_a_plain_walk(spark, docs):
    """Scores of whole texts from the tables, token by token."""
    model = lm.Model(docs.select("text"), steps=20)
    table, n = model.network.log10(), {bytes(r["word"]): r["n"] for r in model.counts.collect()}
    own = {w: i + 1 for i, w in enumerate(model.words)}
    got = by_id(lm.score(docs, model).collect())
    for i, t in cases.pairs():
        one = two = lm.END
        total = 0.0
        for w in [*lm.split(t or ""), b""]:
            s = lm.END if w == b"" else own.get(w, lm.ending(w))
            total += float(table[one * lm.CLASSES + model.classes[two], s])
            if s > lm.WORDS:
                total += float(model.within(np.array([n.get(w, 0)]), np.array([s]))[0])
            two, one = one, s
        assert any(r["score"] == pytest.approx(total, rel=1e-5, abs=1e-5) for r in got[i])


def test_lm_beats_counts_on_held_out_text(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.op1(sf).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_empty(spark, docs):
    assert lm.op1(docs.limit(0)).collect() == []


def test_language_id(spark, docs):
    sf = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.op8(sf).join(sf.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    rows = langid.op8(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {400, 401, 402, None} >= und - {400, 401, 402} and {400, 401, 402} <= und
    assert langid.op8(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in langid.op8(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_windows_cover_whole_texts():
    texts = [b"x" * n for n in (0, 1, 511, 512, 513, 5000)]
    x, row, length = langid.windows(texts)
    assert np.bincount(row, length, len(texts)).tolist() == [len(t) for t in texts]
    assert [(x[row == i] != 0)[:, :langid.WINDOW].sum() for i in range(len(texts))] == [len(t) for t in texts]


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op10(d, labels).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    mine = spark.createDataFrame([(i, 1, i % 2) for i in range(6)] + [(2, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for lab in (mine, mine.limit(0)):
        rows = toxicity.op10(docs, lab).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.op10(docs.limit(0), labels).collect() == []


def test_toxic_spans(spark):
    bad = [(i, cases.prose(i, 30) + " vilestuff " + cases.prose(900 + i, 30), 1) for i in range(40)]
    good = [(100 + i, cases.prose(100 + i, 60), 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in bad + good], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in bad + good], "doc_id long, toxic int")
    rows = by_id(toxicity.op10(df, lab).collect())
    for i, t, y in bad + good:
        r = rows[i][0]
        assert r["predicted"] == y
        if y:
            assert "vilestuff" in [t[a:b] for a, b in zip(r["span_begin"], r["span_end"])]


def test_offsets_are_of_the_original_text():
    text = "İİİ bad ΣΑΣ, İx_9 worse"     # lower-casing the first word makes it longer
    assert len(toxicity.words_of(text)) == 5
    begin, end = toxicity.Tagger.spans(None, text, [1, 4])
    assert [text[a:b] for a, b in zip(begin, end)] == ["bad", "worse"]
    assert toxicity.words_of("") == toxicity.words_of(" 12 _ ") == []


def test_crf_marginals_equal_enumeration():
    crf = toxicity.Crf(["a"])
    rng = np.random.default_rng(0)
    crf.move = rng.normal(size=(2, 2))
    e = rng.normal(size=(1, 6))
    odds = crf.marginals(e, np.ones((1, 6), bool))[0]
    total = np.zeros((6, 2))
    for state in range(64):
        y = [(state >> k) & 1 for k in range(6)]
        p = math.exp(sum(e[0, k] for k in range(6) if y[k]) + sum(crf.move[y[k], y[k + 1]] for k in range(5)))
        for k in range(6):
            total[k, y[k]] += p
    assert np.allclose(odds[0], np.log(total[:, 1] / total[:, 0]))


def pages(spark, n=300):
    rows = [(i, f"http://h/{i}", f"<p>{cases.prose(i, 5)}</p>") for i in range(n)] + [(None, None, None), (7, "http://h/7", "<p>again</p>"), (7, "http://h/7", "<p>again</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1))


def test_fixity_finds_what_was_changed(spark):
    rows = fixity.op7(pages(spark)).collect()
    assert len(rows) == 302 and sum(r["copies"] for r in rows) == 303
    import hashlib
    for r in rows:
        mark = hashlib.md5(("" if r["page_id"] is None else str(r["page_id"])).encode()).hexdigest()[:2]
        assert r["state"] == {"07": "altered", "08": "altered", "09": "missing"}.get(mark, "intact")
    assert {r["state"] for r in rows} == {"intact", "altered", "missing"}
    # every segment is laid out by itself, and the tree can be made again from its rows
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {}
    for segment in sorted({r["segment"] for r in rows}):
        own = sorted((r for r in rows if r["segment"] == segment), key=lambda r: r["address"])
        assert [r["record_no"] for r in own] == list(range(len(own))) and all(r["address"].startswith(segment) for r in own)
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"] * r["copies"]
        leaves = [sha("|".join(str(r[c]) for c in ("address", "offset", "length", "copies", "digest"))) for r in own]
        level[segment] = sha("".join(leaves))
        assert {r["segment_hash"] for r in own} == {level[segment]}
    while list(level) != [""]:
        level = {p: sha("".join(level[n] for n in sorted(level) if n[:-1] == p)) for p in {n[:-1] for n in level}}
    assert {r["root"] for r in rows} == {level[""]}
    assert fixity.op7(pages(spark).limit(0)).collect() == []


def found(spark, own, replica):
    """{(page_id, state): number} and the differing segments of two lists of (page_id, url, record)."""
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, record string")
    a, b = fixity.entries(frame(own)), fixity.entries(frame(replica))
    depth = fixity.depth_for(a.count(), b.count())
    mine, theirs = fixity.archive(a, depth), fixity.archive(b, depth)
    names = mine.placed.unionByName(theirs.placed).select("key", "digest", "page_id").distinct()
    rows = fixity.audit(mine, theirs).join(names, ["key", "digest"]).collect()
    return sorted((-1 if r["page_id"] is None else r["page_id"], r["state"]) for r in rows), fixity.differing(mine, theirs).count()


def test_a_replica_archived_apart_without_one_record_misses_one(spark):
    rows = [(i, f"u{i}", cases.prose(i, 4)) for i in range(200)]
    assert found(spark, rows, rows[:87] + rows[88:]) == ([(87, "missing")], 1)
    assert found(spark, rows[:87] + rows[88:], rows) == ([(87, "extra")], 1)
    assert found(spark, rows, rows[::-1]) == ([], 0)
    changed = [(i, u, r + "!" if i == 5 else r) for i, u, r in rows]
    assert found(spark, rows, changed) == ([(5, "altered")], 1)


def test_fixity_of_repeated_records_and_empty_archives(spark):
    rows = [(1, "u", f"version {i}") for i in range(40)] + [(2, "v", "same")] * 30 + [(None, None, "")]
    assert found(spark, rows, rows) == ([], 0)
    # one version of many is gone, one of the copies is gone: the others are not suspected
    assert found(spark, rows, rows[:11] + rows[12:40] + rows[41:])[0] == [(1, "missing"), (2, "missing")]
    assert found(spark, rows, rows[:40] + [(None, None, "other")])[0] == [(-1, "altered"), (2, "missing")]
    assert found(spark, [], []) == ([], 0)
    assert found(spark, rows[:3], [])[0] == [(1, "missing")] * 3 and found(spark, [], rows[:3])[0] == [(1, "extra")] * 3
