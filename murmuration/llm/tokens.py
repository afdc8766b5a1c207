"""Token counts by rank-synchronous byte-pair merging.

Texts are split into pre-tokens; those not met before are held as ragged
numpy arrays (flat symbols, limits of each sequence). In every round each
sequence applies its own lowest-rank pair, all sequences at once, until no
pair has a rank; the surviving symbols are the token count of a pre-token.

Defined results: a null text counts as empty (0 tokens); the strings of
special tokens inside a text count as one token each, as the library's
default does; repeated rows are counted row by row.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import map_texts

# --- fixed values: the pre-token pattern and byte alphabet of byte-level BPE ---
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
# --- end of fixed values ---

# pre-tokens whose counts a worker remembers; when full it starts afresh
REMEMBERED = 400_000


def byte_alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in the vocabulary file."""
    plain = [b for r in PRINTABLE for b in r]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.byte_id = np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*pairs))
        order = np.argsort((left << 20) | right)
        self.key = ((left << 20) | right)[order]
        self.rank, self.made = order.astype(np.int64), made   # rank = line of the merge
        self.none = len(pairs)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte string."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), size)
        out = size.copy()
        # rank of the pair that starts at each symbol; none at a sequence's last
        pair = np.full(len(sym), self.none)
        same = np.flatnonzero(seq[:-1] == seq[1:])
        pair[same] = self.ranks(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.minimum.reduceat(pair, first)
            live = np.diff(np.append(first, len(seq)))
            out[seq[first]] = live
            on = np.repeat(low < self.none, live)
            low = np.repeat(low, live)[on]
            sym, seq, pair = sym[on], seq[on], pair[on]   # finished sequences leave
            if not len(sym):
                break
            hit = pair == low
            # equal neighbours overlap (aaa): take every second one of a run
            run = np.flatnonzero(hit[1:] & hit[:-1])
            if len(run):
                i = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), i, 0))
                touching = hit & (np.append(False, sym[1:] == sym[:-1]))   # only x x x pairs overlap
                hit &= ~(touching & ((i - begin) % 2 == 1))
            at = np.flatnonzero(hit)
            sym[at] = self.made[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, pair, at = sym[keep], seq[keep], pair[keep], place[at]
            # only pairs next to a merged symbol change
            redo = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inner = redo[redo + 1 < len(seq)]
            inner = inner[seq[inner] == seq[inner + 1]]
            pair[redo] = self.none
            pair[inner] = self.ranks(sym[inner], sym[inner + 1])
        return out


class _Counter:
    """Counts whole texts; keeps the counts of pre-tokens it has met."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pattern = regex.compile(PRE_TOKEN)
        self.split = regex.compile("|".join(regex.escape(s) for s in self.merges.specials)) if self.merges.specials else None
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        base, pieces = [], []
        for t in texts:
            n = 0
            if self.split is not None and self.split.search(t):
                parts = self.split.split(t)
                n, found = len(parts) - 1, [p for part in parts for p in self.pattern.findall(part)]
            else:
                found = self.pattern.findall(t)
            base.append(n)
            pieces.append(found)
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*pieces) - self.known.keys()) if pieces else []
        if new:
            self.known.update(zip(new, self.merges.count([p.encode("utf-8", "surrogatepass") for p in new]).tolist()))
        get = self.known.__getitem__
        return [n + sum(map(get, found)) for n, found in zip(base, pieces)]


_COUNTERS: dict[str, _Counter] = {}


def _counter(path: str) -> _Counter:
    """One counter per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = _Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row; ``vocabulary`` is a path every worker can open."""
    key = dict(docs.dtypes)[id_col]

    def fn(rows, texts, counter):
        return [rows.column(0), [len(t.encode("utf-8", "surrogatepass")) for t in texts], counter(texts)]

    rows = map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), fn,
                     {"id": "long", "n_bytes": "long", "n_tokens": "long"}, setup=lambda: _counter(vocabulary))
    return rows.select(F.col("id").cast(key).alias(id_col), "n_bytes", "n_tokens")


def op2(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
