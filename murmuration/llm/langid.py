"""Language identification by a byte convolutional network in numpy.

Text bytes pass an embedding, filters of several widths, max pooling over a
fixed-length window and a softmax. Windows overlap by the widest filter less
one byte, so they cover the whole text; a text's class probabilities are the
mean over its windows, weighted by window length.

Training reads a bounded sample of labelled rows (``SAMPLE_PER_LANGUAGE``
windows a language, chosen by a hash of the id and the window); scoring
covers every byte of every row.

Defined results: a null text or one without a letter is ``und`` with score
0.0; with no labelled row at all every text is ``und``; ties go to the
alphabetically first language; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import fold, map_texts, mix

WINDOW = 512                  # bytes of a window
WIDTHS = (2, 3, 4, 5)         # filter widths in bytes
FILTERS = 12                  # filters of each width
DIM = 8                       # byte embedding
SAMPLE_PER_LANGUAGE = 1500    # expected training windows a language: the bound of the sample
MAX_LANGUAGES = 500           # distinct labels a model may have
SEED = 11

_LETTER = regex.compile(r"\p{L}")


def _padded(n: int) -> int:
    return n + max(WIDTHS) - 1


class ByteCnn:
    """Embedding (256 x DIM), one (width*DIM x FILTERS) matrix per width, dense softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        f32 = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"emb": f32(256, DIM, scale=0.5), "out": f32(len(WIDTHS) * FILTERS, len(languages), scale=0.1),
                  "bias": np.zeros(len(languages), np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = f32(w * DIM, FILTERS, scale=(w * DIM) ** -0.5)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _tables(self) -> dict[int, list[np.ndarray]]:
        """Per width and offset: what each byte adds to the filters (256 x FILTERS)."""
        return {w: [self.p["emb"] @ self.p[f"w{w}"][o * DIM:(o + 1) * DIM] for o in range(w)] for w in WIDTHS}

    def pooled(self, x: np.ndarray, where: bool = False):
        """Max-pooled, rectified filter answers of windows (n x WINDOW + widest - 1 bytes)."""
        n, length = len(x), WINDOW
        feats, places = [], []
        emb = self.p["emb"][x]                                   # n x padded x DIM
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1)[:, :length].transpose(0, 1, 3, 2)
            a = cols.reshape(n * length, w * DIM) @ self.p[f"w{w}"]
            a = a.reshape(n, length, FILTERS)
            if where:
                at = a.argmax(1)
                places.append(at)
                top = np.take_along_axis(a, at[:, None], 1)[:, 0]
            else:
                top = a.max(1)
            feats.append(np.maximum(top + self.p[f"b{w}"], 0))
        return np.concatenate(feats, 1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        feats, _ = self.pooled(x)
        z = feats @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = SEED) -> None:
        """Adam on cross-entropy; gradients reach the one place each filter was largest at."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                xb, yb = x[order[lo:lo + batch]], y[order[lo:lo + batch]]
                n = len(xb)
                feats, places = self.pooled(xb, where=True)
                z = feats @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(n), yb] -= 1
                z /= n
                g = {"out": feats.T @ z, "bias": z.sum(0), "emb": np.zeros_like(self.p["emb"])}
                back = (z @ self.p["out"].T) * (feats > 0)
                for k, w in enumerate(WIDTHS):
                    gf = back[:, k * FILTERS:(k + 1) * FILTERS]              # n x FILTERS
                    at = places[k][:, :, None] + np.arange(w)                 # n x FILTERS x w
                    bytes_at = xb[np.arange(n)[:, None, None], at]
                    seen = self.p["emb"][bytes_at]                           # n x FILTERS x w x DIM
                    g[f"w{w}"] = np.einsum("nf,nfwd->wdf", gf, seen).reshape(w * DIM, FILTERS)
                    g[f"b{w}"] = gf.sum(0)
                    kernel = self.p[f"w{w}"].reshape(w, DIM, FILTERS).transpose(2, 0, 1)
                    np.add.at(g["emb"], bytes_at.ravel(), (gf[:, :, None, None] * kernel[None]).reshape(-1, DIM))
                step += 1
                for name, grad in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.999 * v[name] + 0.001 * grad ** 2
                    self.p[name] -= (rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, zero-padded: (bytes, row, length)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(texts)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    gap = _padded(WINDOW)
    blob = np.frombuffer((b"\0" * gap).join(texts) + b"\0" * gap, np.uint8)
    base = np.cumsum(size + gap) - (size + gap)
    start = base[row] + k * WINDOW
    x = np.lib.stride_tricks.sliding_window_view(blob, gap)[start] if len(row) else np.zeros((0, gap), np.uint8)
    return x, row, np.minimum(size[row] - k * WINDOW, WINDOW)


def _lower(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def training_windows(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of (window, language) from rows (id, text, lang).

    A first pass counts the windows of each language; a second keeps a window
    when a hash of (id, window number) falls under per_language / count, so
    about ``per_language`` of each reach the driver whatever the input size.
    """
    # an upper bound of the window count from the byte length: no text is cut
    n_windows = F.greatest(F.ceil(F.octet_length("text") / F.lit(WINDOW)), F.lit(1))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.sum(n_windows).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = {k: min(1.0, per_language / n) for k, n in counts.items()}

    def fn(rows, texts, _):
        x, row, _len = windows([_lower(t) for t in texts])
        lang = rows.column(2).to_pylist()
        ids = np.array([hash_id(i) for i in rows.column(0).to_pylist()], np.uint64)
        k = np.arange(len(row), dtype=np.uint64) - np.searchsorted(row, row).astype(np.uint64)
        draw = mix(ids[row] * np.uint64(1_000_003) + k + np.uint64(1)).astype(np.float64) / 2.0 ** 64
        on = np.flatnonzero(draw < np.array([share[v] for v in lang])[row]) if len(row) else []
        if not len(on):
            return None
        return [[draw[i] for i in on], [lang[row[i]] for i in on], [x[i].tobytes() for i in on]]

    def hash_id(i):
        return (0 if i is None else int(i) + 1) & 0xFFFFFFFFFFFFFFFF

    picked = map_texts(labelled.select("id", "text", "lang"), fn, {"draw": "double", "lang": "string", "bytes": "binary"})
    got = sorted((r["lang"], r["draw"], bytes(r["bytes"])) for r in picked.collect())
    languages = sorted(counts)
    x = np.frombuffer(b"".join(b for *_, b in got), np.uint8).reshape(-1, _padded(WINDOW))
    return languages, x, np.array([languages.index(k) for k, *_ in got], np.int64)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ByteCnn | None:
    """Fit on rows (id, text, lang) with a language and a text; None when there are none."""
    rows = labelled.filter(F.col("lang").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    languages, x, y = training_windows(rows, per_language)
    if not len(x):
        return None
    model = ByteCnn(languages)
    model.fit(x, y)
    return model


def classify(texts: list[str], model: ByteCnn | None, batch: int = 64) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    has = [i for i, t in enumerate(texts) if model is not None and _LETTER.search(t)]
    if has:
        x, row, length = windows([_lower(texts[i]) for i in has])
        total = np.zeros((len(has), len(model.languages)))
        for lo in range(0, len(x), batch):
            part = slice(lo, lo + batch)
            np.add.at(total, row[part], model.probabilities(x[part]) * length[part, None])
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for i, b, p in zip(has, best, total[np.arange(len(has)), best]):
            lang[i], score[i] = model.languages[b], min(1.0, float(p))
    return lang, score


def identify(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    key = dict(docs.dtypes)[id_col]

    def fn(rows, texts, _):
        return [rows.column(0), *classify(texts, model)]

    out = map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), fn,
                    {"id": "long", "lang_pred": "string", "score": "double"})
    return out.select(F.col("id").cast(key).alias(id_col), "lang_pred", "score")


def op8(docs: DataFrame) -> DataFrame:
    held = fold("doc_id", 3) == 1
    model = train(docs.filter(~held).select(F.col("doc_id").cast("long").alias("id"), "text", "lang"))
    got = identify(docs, model)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
