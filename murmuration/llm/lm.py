"""Language-model scores from a log-bilinear model trained in numpy.

The model predicts a token's symbol from the two tokens before it. The most
frequent words and the end of a text are symbols of their own; every other
word belongs to a symbol by a hash of its ending, and shares that symbol's
probability by its absolutely discounted corpus count, unknown words taking
the discounted mass. The symbol score is log-bilinear: the vectors of the
last word and of the class of the word before are summed and multiplied with
the target's vector, plus its bias. Word classes come from clustering the
vectors of a first model that sees one word only.

Training is noise-contrastive estimation on statistics of the whole training
corpus: Spark counts (context, symbol) pairs over every training text, and
numpy follows the gradient of the NCE objective with the noise expectation in
closed form, so the model does not depend on how the data are partitioned.
The tables are bounded (SYMBOLS x CLASSES contexts by SYMBOLS); word counts
are a distributed table of any size. Batched matrix products then normalise
all contexts once; scoring looks token log-probabilities up.

The HEAD most frequent words are looked up inside the tasks (a broadcast of
HEAD entries at most); all others meet the count table in one join.

Defined results: a null text is empty and scores its end token alone; a null
id counts as training; repeated rows get equal scores; without training rows
all counts are 0, every base score is 0.0 and the model is uniform over
symbols.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import fold, map_texts
from murmuration.session import cut_lineage

WORDS = 383        # frequent words with a symbol of their own
ENDINGS = 128      # symbols of the other words, by their last bytes
SYMBOLS = 1 + WORDS + ENDINGS
CLASSES = 8        # classes of the word before the last
DIM = 24
NOISE = 10         # noise samples per token
HEAD = 150_000     # words looked up inside tasks: the bound of the broadcast
FLUSH = 300_000    # distinct words a task counts before handing them on
END = 0

_LN10 = float(np.log(10))


def ending(word: bytes) -> int:
    """Symbol of a word without one of its own: a hash of its last three bytes."""
    return 1 + WORDS + zlib.crc32(word[-3:]) % ENDINGS


def split(text: str) -> list[bytes]:
    """Words of a text: runs outside ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows (text): counted per task, then summed."""
    def fn(rows, texts, seen):
        for t in texts:
            seen.update(split(t))
        return finish(seen) if len(seen) > FLUSH else None

    def finish(seen):
        out = [list(seen.keys()), list(seen.values())] if seen else None
        seen.clear()
        return out

    part = map_texts(texts.select("text"), fn, {"word": "binary", "n": "long"}, setup=Counter, finish=finish)
    return part.groupBy("word").agg(F.sum("n").alias("n"))


class Symbols(dict):
    """word -> symbol for frequent words; other words by their ending."""

    def __missing__(self, word: bytes) -> int:
        return ending(word)


def context_counts(texts: DataFrame, words: list[bytes], classes: np.ndarray, n_class: int) -> np.ndarray:
    """Counts [context, symbol] over all rows; context = last symbol * classes + class of the one before."""
    def setup():
        return Symbols({w: i + 1 for i, w in enumerate(words)}), np.zeros(SYMBOLS * n_class * SYMBOLS, np.int32)

    def fn(rows, texts, state):
        symbol, table = state
        s, first = symbols(texts, symbol)
        ctx = contexts(s, first, classes, n_class)
        cells, n = np.unique(ctx * SYMBOLS + s, return_counts=True)
        table[cells] += n.astype(np.int32)   # a task's share of the input fits 2^31 tokens
        return None

    def finish(state):
        at = np.flatnonzero(state[1])
        return [at, state[1][at]] if len(at) else None

    part = map_texts(texts.select("text"), fn, {"cell": "long", "n": "long"}, setup=setup, finish=finish)
    got = part.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()   # SYMBOLS^2 * classes cells at most
    table = np.zeros(SYMBOLS * n_class * SYMBOLS)
    table[got["cell"].to_numpy()] = got["n"].to_numpy()
    return table.reshape(SYMBOLS * n_class, SYMBOLS)


def symbols(texts: list[str], symbol: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all tokens of some texts, each closed by END, and the index of each text's first."""
    parts, size = [], []
    for t in texts:
        words = split(t)
        parts.append(np.fromiter(map(symbol.__getitem__, words), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
        size.append(len(words) + 1)
    return np.concatenate(parts), np.cumsum([0, *size[:-1]])


def contexts(s: np.ndarray, first: np.ndarray, classes: np.ndarray, n_class: int) -> np.ndarray:
    """Context of each token; END stands before a text."""
    one = np.append(END, s[:-1])
    one[first] = END
    two = np.append([END, END], s[:-2])[:len(s)]
    two[first] = END
    second = first[np.diff(np.append(first, len(s))) > 1] + 1
    two[second] = END
    return one * n_class + classes[two]


class LogBilinear:
    """score(context, w) = (R[last] + G[class]) . Q[w] + b[w]."""

    def __init__(self, n_class: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.n_class = n_class
        self.p = {"R": rng.standard_normal((SYMBOLS, DIM)) * 0.1, "G": rng.standard_normal((n_class, DIM)) * 0.1,
                  "Q": rng.standard_normal((SYMBOLS, DIM)) * 0.1, "b": np.zeros(SYMBOLS)}

    def scores(self) -> np.ndarray:
        h = (self.p["R"][:, None] + self.p["G"][None]).reshape(-1, DIM)
        return h @ self.p["Q"].T + self.p["b"]

    def log10(self) -> np.ndarray:
        """Normalised log10 probabilities [context, symbol]."""
        s = self.scores()
        top = s.max(1, keepdims=True)
        return ((s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / _LN10).astype(np.float32)

    def fit(self, counts: np.ndarray, steps: int = 150, rate: float = 0.05) -> None:
        """Adam on the NCE objective of all counts; noise: smoothed symbol frequencies."""
        total = counts.sum()
        if not total:
            return
        q = counts.sum(0) + 0.5
        q /= q.sum()
        self.p["b"] = np.log(q)
        share, seen = counts / total, counts.sum(1, keepdims=True) / total
        noise = np.log(NOISE * q)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for step in range(1, steps + 1):
            h = (self.p["R"][:, None] + self.p["G"][None]).reshape(-1, DIM)
            real = 1 / (1 + np.exp(np.clip(noise - h @ self.p["Q"].T - self.p["b"], -60, 60)))   # P(data | pair)
            d = share * (1 - real) - seen * (NOISE * q) * real
            dh = (d @ self.p["Q"]).reshape(SYMBOLS, self.n_class, DIM)
            g = {"R": dh.sum(1), "G": dh.sum(0), "Q": d.T @ h, "b": d.sum(0)}
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] = self.p[k] + rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-9)

    def classes(self, weight: np.ndarray, k: int = CLASSES, seed: int = 5) -> np.ndarray:
        """Classes of symbols by weighted k-means on the direction of their predictions."""
        x = self.p["R"] / (np.linalg.norm(self.p["R"], axis=1, keepdims=True) + 1e-9)
        rng = np.random.default_rng(seed)
        centre = x[rng.choice(len(x), k, replace=False, p=(weight + 1e-9) / (weight + 1e-9).sum())]
        for _ in range(25):
            at = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            for c in range(k):
                on = at == c
                if on.any():
                    centre[c] = np.average(x[on], axis=0, weights=weight[on] + 1e-9)
        return at


def frequent_words(counts: DataFrame, limit: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent words, ``limit`` at most: all whose count reaches a cut-off.

    The cut-off comes from a histogram of counts (eight steps an octave), so
    no task sees more words than its own.
    """
    step = F.floor(F.log2("n") * 8).cast("long")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v")).collect()   # 512 rows at most
    total, least = 0, None
    for s, v in sorted(((r["step"], r["v"]) for r in sizes), reverse=True):
        total += v
        if total > limit:
            break
        least = s
    if least is None:
        return []
    got = counts.filter(step >= least).toArrow()
    return sorted(zip((bytes(w) for w in got["word"].to_pylist()), got["n"].to_pylist()), key=lambda x: (-x[1], x[0]))


class Model:
    """Corpus statistics and the trained network; ``counts`` stays a distributed table."""

    def __init__(self, texts: DataFrame, steps: int = 150):
        texts = texts.select("text")
        self.counts = cut_lineage(word_counts(texts))
        tail = F.col("n") == 1
        got = self.counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(tail.cast("long")), F.sum((F.col("n") == 2).cast("long"))).first()
        n_texts = texts.count()
        self.total = (got[0] or 0) + n_texts
        self.types = got[1] + (n_texts > 0)
        self.ends = n_texts
        self.discount = (got[2] or 0) / max(1, (got[2] or 0) + 2 * (got[3] or 0))
        self.discount = min(0.95, max(0.05, self.discount))
        head = frequent_words(self.counts)
        self.head = [w for w, _ in head]
        self.head_n = np.array([n for _, n in head], np.int64)
        words = self.head[:WORDS]
        # counts and types of each ending over all words without a symbol of their own
        z = F.lit(1 + WORDS) + F.pmod(F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")), F.lit(ENDINGS))
        sums = {r["z"]: (r["n"], r["v"]) for r in self.counts.groupBy(z.alias("z")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
        self.mass, self.kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        for s, (n, v) in sums.items():
            self.mass[s], self.kinds[s] = n, v
        for w, n in zip(words, self.head_n):
            self.mass[ending(w)] -= n
            self.kinds[ending(w)] -= 1
        first = LogBilinear(1)
        none = np.zeros(SYMBOLS, np.int64)
        pairs = context_counts(texts, words, none, 1)
        first.fit(pairs, steps)
        self.classes = first.classes(pairs.sum(0))
        full = LogBilinear(CLASSES)
        full.p["R"], full.p["Q"] = first.p["R"].copy(), first.p["Q"].copy()
        full.fit(context_counts(texts, words, self.classes, CLASSES), steps)
        self.network = full
        self.words = words

    def within(self, n: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of a word of count ``n`` given its symbol (n = 0: unknown)."""
        symbol = np.asarray(symbol)
        own = symbol <= WORDS
        mass, kinds = np.maximum(self.mass[symbol], 1e-300), self.kinds[symbol]
        p = np.where(np.asarray(n) > 0, np.maximum(n - self.discount, 1e-300) / mass, np.where(kinds > 0, self.discount * kinds / mass, 1.0))
        return np.where(own, 0.0, np.log10(p))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    key = dict(docs.dtypes)[id_col]
    denominator = model.total + (model.types + 1)
    base = np.log10((model.head_n + 1) / denominator)
    own = np.arange(len(model.head)) < len(model.words)
    symbol = np.array([i + 1 if o else ending(w) for i, (w, o) in enumerate(zip(model.head, own))], np.int64)
    inside = model.within(model.head_n, symbol) if len(symbol) else np.zeros(0)
    end_base = float(np.log10((model.ends + 1) / denominator))
    end_known = int(model.ends > 0)
    log10, classes = model.network.log10(), model.classes
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.head, base, inside, symbol, log10))   # HEAD words and SYMBOLS^2 * CLASSES floats at most

    def setup():
        head, base, inside, symbol, log10 = shared.value
        return {w: i for i, w in enumerate(head)}, np.append(base, 0.0), np.append(inside, 0.0), symbol, log10

    def fn(rows, texts, state):
        at, base, inside, symbol, log10 = state
        ids, size, rare = [], [], []
        for t in texts:
            words = split(t)
            got = np.fromiter(map(at.get, words, repeat(-1)), np.int64, len(words))
            miss = np.flatnonzero(got < 0)
            rare.append([words[i] for i in miss])
            ids += [got, _STOP]
            size.append(len(words) + 1)
        ids = np.concatenate(ids)
        first = np.cumsum([0, *size[:-1]])
        s = np.zeros(len(ids), np.int64)
        s[ids >= 0] = symbol[ids[ids >= 0]]
        s[ids == -1] = [ending(w) for part in rare for w in part]
        logp = log10.ravel()[contexts(s, first, classes, CLASSES) * SYMBOLS + s].astype(np.float64)
        head = np.maximum(ids, -1)   # -1: the added zero at the end
        b = np.add.reduceat(np.where(ids == -2, end_base, base[head]), first)
        p = np.add.reduceat(logp + inside[head], first)
        known = np.add.reduceat((ids >= 0).astype(np.int64), first) + end_known
        out = [list(range(len(texts))), [b" %d" % h for h in rows.column(1).to_pylist()], [0] * len(texts), [0] * len(texts),
               size, known.tolist(), b.tolist(), p.tolist()]
        for i, part in enumerate(rare):
            for w, n in Counter(part).items():
                for col, v in zip(out, (i, w, n, ending(w), None, None, None, None)):
                    col.append(v)
        row = np.array(out[0])
        return [rows.column(0).take(row), rows.column(1).take(row), *out[1:]]

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    part = map_texts(rows, fn, {"id": "string", "h": "long", "word": "binary", "n": "long", "z": "int", "n_tokens": "long",
                                "n_known": "long", "base": "double", "score": "double"}, setup=setup)
    # summary rows carry a key with a space, which no word has: they match nothing and spread evenly
    tail = model.counts.withColumnRenamed("n", "c")
    if len(model.head):
        tail = tail.filter(F.col("c") < int(model.head_n[-1]))   # the head holds all words from its last count on
    rare = part.join(tail, "word", "left")
    const = lambda x: F.element_at(F.array(*[F.lit(float(v)) for v in x]), F.col("z") + 1)
    mass = np.log10(np.maximum(model.mass, 1e-300))
    unknown = np.where(model.kinds > 0, np.log10(np.maximum(model.discount * model.kinds, 1e-300)) - mass, 0.0)
    c = F.coalesce("c", F.lit(0))
    inside_tail = F.when(c > 0, F.log10(c - F.lit(model.discount)) - const(mass)).otherwise(const(unknown))
    sums = rare.groupBy("id", "h").agg(
        F.count("n_tokens").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(c > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("n") * F.log10((c + 1) / F.lit(float(denominator))))).alias("base"),
        F.sum(F.coalesce("score", F.col("n") * inside_tail)).alias("score"))
    rows = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    whole = lambda x: F.expr(f"{x} div copies").alias(x)
    return rows.select(F.col("id").cast(key).alias(id_col), whole("n_tokens"), whole("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
                       (F.col("base") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


_STOP = np.array([-2], np.int64)


def op1(docs: DataFrame) -> DataFrame:
    held = fold("doc_id", 7) == 2
    model = Model(docs.filter(~held).select("text"))
    got = score(docs, model)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
