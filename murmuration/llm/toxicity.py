"""Toxic spans by a linear-chain conditional random field in numpy.

Labels mark whole documents, so token labels are made first: word and
word-prefix features that are strongly tied to toxic documents (counted by
Spark over the sampled rows) mark the tokens of toxic documents. The field
has two states; its features are a token's word and prefixes, whether its
neighbours carry a marked feature, and the transitions. Weights maximise the
penalised likelihood of whole chains. Forward-backward marginals of every
token of a text give the offending offsets; their largest log-odds and their
sum give the document score through a logistic layer.

Labels are learnt from a bounded sample of labelled rows (``SAMPLE_TOXIC``
and ``SAMPLE_CLEAN`` rows, chosen by a hash of the id), the field from
SAMPLE_CHAINS chains with and without marked tokens, chosen by a hash of id,
text and chain number; scoring covers every token of every row. A chain is a
run of CHAIN tokens of one text.

Defined results: a text without letters (null, empty) gets the score of a
text whose tokens are all neutral; without labelled rows of both kinds the
score is the share of toxic labels (0.0 without labels); repeated rows get
equal scores; an id with several labels is toxic if any of them is.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import fold, map_texts
from murmuration.session import cut_lineage

SAMPLE_TOXIC = 6000     # expected toxic rows of the sample: its bound
SAMPLE_CLEAN = 12000    # expected clean rows
SAMPLE_CHAINS = 4000    # expected training chains with, and without, a marked token
MAX_FEATURES = 20000    # features of the field
MIN_SUPPORT = 5         # toxic documents a feature needs
PURITY = 0.7            # share of toxic documents among those with the feature
CHAIN = 64
REMEMBERED = 300_000    # words a worker remembers

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased one by one: lower-casing a whole text may shift its offsets."""
    return " ".join(_WORD.findall(text)).lower().split()


def features(word: str) -> tuple[str, ...]:
    """Word and prefix features of a lower-cased word."""
    out = ["w" + word]
    out += [f"{k}{word[:k]}" for k in (4, 5) if len(word) > k]
    return tuple(out)


def sample_labels(labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(doc_id, toxic): a bounded sample of the label rows, by a hash of the id."""
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
                  .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, toxic / max(1, total.get(1, 0))))).otherwise(
        F.lit(min(1.0, clean / max(1, total.get(0, 0)))))
    return rows.filter(draw < share)


def feature_counts(texts: DataFrame) -> DataFrame:
    """(feature, a, b): toxic and clean documents with the feature, over rows (text, toxic)."""
    def setup():
        return {}

    def fn(rows, texts, seen):
        for t, y in zip(texts, rows.column(1).to_pylist()):
            for f in {f for w in set(words_of(t)) for f in features(w)}:
                pair = seen.get(f)
                if pair is None:
                    pair = seen[f] = [0, 0]
                pair[0 if y == 1 else 1] += 1
        if len(seen) > REMEMBERED:   # hand over what is counted so far; the shuffle adds up
            out = finish(seen)
            seen.clear()
            return out
        return None

    def finish(seen):
        return [list(seen), [v[0] for v in seen.values()], [v[1] for v in seen.values()]] if seen else None

    part = map_texts(texts.select("text", "toxic"), fn, {"feature": "string", "a": "long", "b": "long"}, setup=setup, finish=finish)
    return part.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def marked_features(counts: DataFrame, limit: int = MAX_FEATURES) -> list[str]:
    """Features tied to toxic documents, most toxic documents first (a bounded top-k)."""
    rows = (counts.filter((F.col("a") >= MIN_SUPPORT) & (F.col("a") >= PURITY * (F.col("a") + F.col("b"))))
                  .orderBy(F.col("a").desc(), "b", "feature").limit(limit).collect())
    return [r["feature"] for r in rows]


class Crf:
    """Two states (0 neutral, 1 toxic); ``index``: feature -> column of ``weight``.

    Column 0 is the bias; the last two are "the token before / after carries
    a marked feature".
    """

    def __init__(self, feats: list[str]):
        self.index = {f: i + 1 for i, f in enumerate(feats)}
        self.weight = np.zeros(len(feats) + 3)
        self.move = np.zeros((2, 2))
        self.layer = np.zeros(3)

    def ids(self, word: str) -> tuple[int, int, int]:
        got = [self.index.get(f, 0) for f in features(word)]
        return tuple((got + [0, 0])[:3])

    def emissions(self, ids: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Score of state 1 over state 0 for chains of feature ids (n x CHAIN x 3)."""
        w = self.weight.copy()
        w[0] = 0
        e = self.weight[0] + w[ids].sum(2)
        marked = (ids[:, :, 0] > 0) | (ids[:, :, 1] > 0) | (ids[:, :, 2] > 0)
        e[:, 1:] += w[-2] * marked[:, :-1]
        e[:, :-1] += w[-1] * marked[:, 1:]
        return np.where(on, e, 0.0)

    def marginals(self, e: np.ndarray, on: np.ndarray):
        """Forward-backward: P(state 1) per token, log Z and expected transitions per chain."""
        n, length = e.shape
        m = self.move
        fwd, bwd = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        emit = np.stack([np.zeros_like(e), e], 2)
        fwd[0] = emit[:, 0]
        for t in range(1, length):
            step = np.logaddexp(fwd[t - 1][:, :1] + m[0], fwd[t - 1][:, 1:] + m[1]) + emit[:, t]
            fwd[t] = np.where(on[:, t, None], step, fwd[t - 1])
        for t in range(length - 2, -1, -1):
            nxt = emit[:, t + 1] + bwd[t + 1]
            step = np.logaddexp(m[:, 0] + nxt[:, :1], m[:, 1] + nxt[:, 1:])
            bwd[t] = np.where(on[:, t + 1, None], step, bwd[t + 1])
        z = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
        odds = (fwd + bwd)[:, :, 1] - (fwd + bwd)[:, :, 0]
        return odds.T, z, fwd, bwd, emit

    def fit(self, ids: np.ndarray, on: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> None:
        """Adam on the penalised chain likelihood."""
        theta = np.concatenate([self.weight, self.move.ravel()])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        marked = (ids > 0).any(2)
        before, after = np.zeros_like(marked), np.zeros_like(marked)
        before[:, 1:], after[:, :-1] = marked[:, :-1], marked[:, 1:]
        both = on[:, 1:]
        for k in range(1, steps + 1):
            self.weight, self.move = theta[:-4], theta[-4:].reshape(2, 2)
            odds, z, fwd, bwd, emit = self.marginals(self.emissions(ids, on), on)
            d = np.where(on, 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y, 0.0)
            g = np.bincount(ids.ravel(), np.repeat(d.ravel(), 3), len(self.weight))
            g[0], g[-2], g[-1] = d.sum(), (d * before).sum(), (d * after).sum()
            gm = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    joint = np.exp(fwd[:-1, :, a].T + self.move[a, b] + (emit[:, 1:, b] + bwd[1:, :, b].T) - z[:, None])
                    gm[a, b] = (joint * both).sum() - ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
            g = np.concatenate([g, gm.ravel()]) / len(ids) + l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        self.weight, self.move = theta[:-4], theta[-4:].reshape(2, 2)

    def fit_layer(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> None:
        """Logistic layer on (1, largest log-odds, log1p of expected toxic tokens), by Newton steps."""
        x = np.column_stack([np.ones(len(x)), x])
        w = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + l2 * w
            h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(3)
            w = w - np.clip(np.linalg.solve(h, g), -2, 2)
        self.layer = w


class Tagger:
    """Runs a field over whole texts; remembers the features of words met."""

    def __init__(self, crf: Crf):
        self.crf, self.known, self.rows = crf, {"": 0}, [(0, 0, 0)]
        self.shape = {(0, 0, 0): 0}

    def _id(self, word: str) -> int:
        """Index of the word's feature combination; few combinations exist."""
        got = self.crf.ids(word)
        at = self.shape.get(got)
        if at is None:
            at = self.shape[got] = len(self.rows)
            self.rows.append(got)
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.known[word] = at
        return at

    def chains(self, texts: list[str]):
        """Feature ids (n x CHAIN x 3), which cells hold a token, and the row of each chain."""
        got, size = [], []
        for t in texts:
            words = words_of(t)
            known = self.known
            got.append(np.array([known[w] if w in known else self._id(w) for w in words], np.int32))
            size.append(len(words))
        size = np.array(size, np.int64)
        count = -(-size // CHAIN)
        row = np.repeat(np.arange(len(texts)), count)
        flat = np.zeros(len(row) * CHAIN, np.int32)
        on = np.zeros(len(row) * CHAIN, bool)
        base = (np.cumsum(count) - count) * CHAIN
        at = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
        flat[at] = np.concatenate(got) if got else flat[:0]
        on[at] = True
        ids = np.array(self.rows, np.int64)[flat].reshape(len(row), CHAIN, 3)
        return ids, on.reshape(len(row), CHAIN), row

    def score(self, texts: list[str]):
        """Per text: (largest log-odds, expected toxic tokens); per chain: odds, on, row."""
        ids, on, row = self.chains(texts)
        neutral = float(np.clip(self.crf.weight[0], -12, 12))
        top, mass = np.full(len(texts), neutral), np.zeros(len(texts))
        odds = np.zeros((len(row), CHAIN))
        if len(row):
            odds = np.clip(self.crf.marginals(self.crf.emissions(ids, on), on)[0], -12, 12)
            np.maximum.at(top, row, np.where(on, odds, -12).max(1))
            np.add.at(mass, row, np.where(on & (odds > 0), 1 / (1 + np.exp(-odds)), 0).sum(1))
        return top, mass, odds, on, row

    def spans(self, text: str, hits: list[int]) -> tuple[list[int], list[int]]:
        """Code-point offsets of the tokens numbered in ``hits``."""
        want, begin, end = set(hits), [], []
        for k, m in enumerate(_WORD.finditer(text)):
            if k in want:
                begin.append(m.start())
                end.append(m.end())
        return begin, end


def train(docs: DataFrame, labels: DataFrame, chains: int = SAMPLE_CHAINS) -> tuple[Crf | None, float]:
    """(field, share of toxic labels); the field is None without labelled rows of both kinds."""
    chosen = cut_lineage(sample_labels(labels.select("doc_id", "toxic")))
    # the right side is the bounded sample: at most about SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    texts = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"))
    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(total.values())
    prior = total.get(1, 0) / n if n else 0.0
    if len(total) < 2:
        return None, prior
    crf = Crf(marked_features(feature_counts(texts)))

    def pick(rows, part, tagger):
        ids, on, row = tagger.chains(part)
        toxic = np.array(rows.column(1).to_pylist())
        y = ((ids > 0).any(2) & (toxic[row] == 1)[:, None]).astype(np.int64)
        number = np.arange(len(row)) - np.searchsorted(row, row)     # of the chain in its text
        place = np.array(rows.column(2).to_pylist(), np.int64)[row]
        return [ids.reshape(len(row), -1).tolist(), on.sum(1), y.tolist(), y.any(1).tolist(), place, number]

    rows = map_texts(texts.select("text", "toxic", F.xxhash64("doc_id", F.xxhash64("text")).alias("place")), pick, {
        "ids": "array<long>", "size": "long", "y": "array<long>", "toxic": "boolean", "place": "long", "number": "long"}, setup=lambda: Tagger(crf))
    counts = {(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # by where a chain stands, not by what it holds: equal chains are drawn apart
    draw = F.pmod(F.xxhash64("place", "number"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic"), F.lit(min(1.0, chains / max(1, counts.get(True, 0))))).otherwise(
        F.lit(min(1.0, chains / max(1, counts.get(False, 0)))))
    got = sorted((tuple(r["ids"]), tuple(r["y"]), r["size"]) for r in rows.filter(draw < share).select("ids", "y", "size").collect())
    if not got:
        return None, prior
    ids = np.array([g[0] for g in got], np.int64).reshape(len(got), CHAIN, 3)
    y = np.array([g[1] for g in got], np.int64)
    on = np.arange(CHAIN) < np.array([g[2] for g in got])[:, None]
    crf.fit(ids, on, y)

    def judge(rows, part, tagger):
        top, mass, *_ = tagger.score(part)
        return [top, mass, rows.column(1)]

    fit = map_texts(texts.select("text", F.col("toxic").cast("long").alias("toxic")), judge,
                    {"top": "double", "mass": "double", "toxic": "long"}, setup=lambda: Tagger(crf)).collect()
    fit = sorted((r["top"], r["mass"], r["toxic"]) for r in fit)
    x = np.array([[a, np.log1p(b)] for a, b, _ in fit])
    crf.fit_layer(x, np.array([c for *_, c in fit], float))
    return crf, prior


def score(docs: DataFrame, crf: Crf | None, prior: float = 0.0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, span_begin, span_end) for every row; spans are offending tokens, in code points."""
    key = dict(docs.dtypes)[id_col]

    def fn(rows, texts, tagger):
        if tagger is None:
            none = [[] for _ in texts]
            return [rows.column(0), [prior] * len(texts), none, none]
        top, mass, odds, on, row = tagger.score(texts)
        layer = tagger.crf.layer
        p = 1 / (1 + np.exp(-np.clip(layer[0] + layer[1] * top + layer[2] * np.log1p(mass), -30, 30)))
        begin, end = [[] for _ in texts], [[] for _ in texts]
        hit = (on & (odds >= 0)).reshape(-1, CHAIN)
        for i in np.unique(row[hit.any(1)]):
            part = np.flatnonzero(hit[row == i].ravel())
            begin[i], end[i] = tagger.spans(texts[i], part.tolist())
        return [rows.column(0), p, begin, end]

    out = map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), fn,
                    {"id": "long", "score": "double", "span_begin": "array<long>", "span_end": "array<long>"},
                    setup=lambda: None if crf is None else Tagger(crf))
    return out.select(F.col("id").cast(key).alias(id_col), "score", "span_begin", "span_end")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = fold("doc_id", 5) == 0
    crf, prior = train(docs, labels.filter(~held))
    return score(docs, crf, prior).select("doc_id", held.alias("held_out"), "score",
                                          (F.col("score") >= 0.5).cast("int").alias("predicted"), "span_begin", "span_end")
