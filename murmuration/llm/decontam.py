"""Benchmark decontamination by winnowing.

Both sides keep the minimum K-gram hash of every window of W consecutive
K-grams, so any shared run of K + W - 1 = 10 words shares a kept hash
(Schleimer et al., 2003). Kept hashes are joined, each match is extended
word by word to both sides and counts when it spans ten words; as every
ten-word window holds a kept K-gram, the extended matches cover exactly the
document words inside an occurrence. Items of fewer words are looked up as
whole runs of their own length.

The benchmark's hashes reach the tasks in blocks of at most BLOCK hashes
(one pass over the documents each), so the broadcast is bounded whatever the
benchmark's size; no block leaves anything out.

Defined results: null and empty texts have no words and are clean; a
benchmark without words marks nothing; items with equal words are reported
under all their ids; a null item id is written as "null"; repeated document
rows get equal results; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import ALNUM_TABLE, Words, map_texts, unused
from murmuration.session import cut_lineage

K = 5              # words of a fingerprint
SPAN = 10          # words of a window; W = SPAN - K + 1
BLOCK = 1 << 20    # benchmark hashes broadcast at once (8 MB)

_HIT = {"hash": "long", "k": "int", "pos": "int", "before": "array<string>", "gram": "string", "after": "array<string>"}


def winnow(words: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the kept k-grams: minima of the windows that span ``span`` words."""
    h, at = words.grams(k)
    w = span - k + 1
    n = len(h) - w + 1
    if n <= 0:
        return h[:0], at[:0]
    row = words.doc[at]
    whole = row[:n] == row[w - 1:]
    low = h[:n].copy()
    for j in range(1, w):
        np.minimum(low, h[j:j + n], out=low)
    keep = np.zeros(len(h), bool)
    for j in range(w):       # ties are all kept
        keep[j:j + n] |= whole & (h[j:j + n] == low)
    return h[keep], at[keep]


def _salted(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of different lengths do not meet."""
    return (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def _context(words: Words, i: int, k: int, reach: int):
    """Up to ``reach`` words before (nearest first), the gram, and up to ``reach`` after."""
    row = words.doc[i]
    lo, hi = words.first[row], words.first[row] + words.count[row]
    text = lambda a: words.word(a).decode("utf-8", "surrogatepass")
    return ([text(a) for a in range(i - 1, max(lo, i - reach) - 1, -1)], " ".join(text(a) for a in range(i, i + k)),
            [text(a) for a in range(i + k, min(hi, i + k + reach))])


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(item_id, k, need, hash, before, gram, after) of the benchmark items (item_id string, text)."""
    def fn(rows, texts, _):
        words = Words(texts, ALNUM_TABLE)
        ids = rows.column(0).to_pylist()
        out = [[] for _ in range(7)]
        picked = [(K, SPAN, *winnow(words, K, SPAN))]
        for m in sorted(set(words.count[(words.count > 0) & (words.count < SPAN)].tolist())):
            h, at = words.grams(m)
            on = words.count[words.doc[at]] == m
            picked.append((m, m, h[on], at[on]))
        for k, need, h, at in picked:
            # a short item of K words has its own length as salt too
            for x, i in zip(_salted(h, k if need == SPAN else -need).tolist(), at.tolist()):
                for col, v in zip(out, (ids[words.doc[i]], k, need, x, *_context(words, i, k, need - k))):
                    col.append(v)
        return out if out[0] else None

    return map_texts(items, fn, {"item_id": "string", "k": "int", "need": "int", "hash": "long", "before": "array<string>",
                                 "gram": "string", "after": "array<string>"})


def _matches(docs: DataFrame, long_hashes: np.ndarray, short: dict[int, np.ndarray], summary: bool) -> DataFrame:
    """Per document row (id, h, text): a summary row, and a row per kept hash that the block holds."""
    def found(sorted_hashes, h):
        at = np.searchsorted(sorted_hashes, h)
        at[at == len(sorted_hashes)] = 0
        return sorted_hashes[at] == h

    def fn(rows, texts, _):
        words = Words(texts, ALNUM_TABLE)
        hits = []
        if len(long_hashes):
            h, at = winnow(words, K, SPAN)
            h = _salted(h, K)
            on = found(long_hashes, h)
            hits += [(K, x, i) for x, i in zip(h[on].tolist(), at[on].tolist())]
        for m, known in short.items():
            h, at = words.grams(m)
            h = _salted(h, -m)
            on = found(known, h)
            hits += [(m, x, i) for x, i in zip(h[on].tolist(), at[on].tolist())]
        n = len(texts) if summary else 0
        out = {"row": list(range(n)), "n_words": words.count[:n].tolist()} | {c: [None] * n for c in _HIT}
        for k, x, i in hits:
            row = int(words.doc[i])
            out["row"].append(row)
            out["n_words"].append(None)
            for c, v in zip(_HIT, (x, k, i - int(words.first[row]), *_context(words, i, k, SPAN - K))):
                out[c].append(v)
        at = np.array(out.pop("row"), np.int64)
        return [rows.column(0).take(at), rows.column(1).take(at), *out.values()] if len(at) else None

    def arrow_fn(rows, texts, state):
        import pyarrow as pa
        got = fn(rows, texts, state)
        return got and [got[0], got[1], *[pa.array(c, t) for c, t in zip(got[2:], (
            pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())))]]

    return map_texts(docs, arrow_fn, {"id": "string", "h": "long", "n_words": "long"} | _HIT)


def _same_run(a: Column, b: Column, reach: int) -> Column:
    """Length of the common prefix of two word arrays, up to ``reach``."""
    n = F.lit(0)
    for j in reversed(range(reach)):
        n = F.when(F.get(a, F.lit(j)) == F.get(b, F.lit(j)), n + 1).otherwise(0)
    return n


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
                  block: int = BLOCK) -> DataFrame:
    """One row per distinct (id, text): id (string), h, copies, n_words, n_hit, item_ids (sorted strings), spans."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").alias("text"))
    prints = cut_lineage(item_fingerprints(items))
    n = prints.select("hash").distinct().count()
    blocks = max(1, -(-n // block))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    passes = None
    for b in range(blocks):
        part = prints.filter(F.pmod("hash", F.lit(blocks)) == b).select("k", "need", "hash").distinct().collect()  # bounded by ``block``
        long_hashes = np.unique(np.array([r["hash"] for r in part if r["need"] == SPAN], np.int64))
        short = {}
        for r in part:
            if r["need"] < SPAN:
                short.setdefault(r["k"], set()).add(r["hash"])
        found = _matches(rows, long_hashes, {m: np.array(sorted(v), np.int64) for m, v in sorted(short.items())}, summary=b == 0)
        passes = found if passes is None else passes.unionByName(found)
    passes = cut_lineage(passes)   # read twice below; small: summaries and matches
    d, p = passes.filter("hash IS NOT NULL").alias("d"), prints.alias("p")
    left = _same_run(F.col("d.before"), F.col("p.before"), SPAN - K)
    right = _same_run(F.col("d.after"), F.col("p.after"), SPAN - K)
    spans = (d.join(p, (F.col("d.hash") == F.col("p.hash")) & (F.col("d.k") == F.col("p.k")) & (F.col("d.gram") == F.col("p.gram")))
              .select("d.id", "d.h", "p.item_id", F.col("d.pos").alias("pos"), F.col("d.k").alias("k"), left.alias("l"), right.alias("r"), "p.need")
              .filter(F.col("l") + F.col("k") + F.col("r") >= F.col("need"))
              .select("id", "h", F.lit(None).cast("long").alias("n_words"), "item_id",
                      F.struct((F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("k") + F.col("r")).alias("end")).alias("span")))
    summary = passes.filter("n_words IS NOT NULL").select(
        "id", "h", "n_words", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    # a group holds the matches of one document
    merged = (summary.unionByName(spans).groupBy("id", "h")
              .agg(F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
                   F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["to"], x["begin"].cast("long")))).alias("n"),
        F.greatest(s["to"], x["end"].cast("long")).alias("to")), lambda s: s["n"])
    return merged.withColumn("n_hit", covered)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` without a benchmark window, columns unchanged."""
    hit = contamination(docs, benchmark, id_col, text).filter("n_hit > 0").select(
        F.coalesce(F.col("id"), F.lit("")).alias("_id"), F.col("id").isNull().alias("_null"), F.col("h").alias("_h")).alias("_hit")
    mark = unused("_h", docs.columns)
    own = docs.withColumn(mark, F.xxhash64(F.col(text)))
    key = F.col(f"_own.`{id_col}`").cast("string")
    return (own.alias("_own").join(hit, (F.coalesce(key, F.lit("")) == F.col("_hit._id")) & (key.isNull() == F.col("_hit._null"))
                                   & (F.col(f"_own.{mark}") == F.col("_hit._h")), "left_anti").drop(mark))


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = contamination(docs, benchmark)
    rows = got.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.col("id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "n_words", F.col("n_hit").cast("long").alias("n_hit"),
                       F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = """
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT rid, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, m, unnest([array_to_string(w[j:j + m - 1], ' ') FOR j IN range(1, len(w) - m + 2)]) AS g
    FROM (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0) x),
dw AS (SELECT rid, m, unnest([array_to_string(w[j:j + m - 1], ' ') FOR j IN range(1, len(w) - m + 2)]) AS g, unnest(range(1, len(w) - m + 2)) AS j
    FROM d CROSS JOIN (SELECT DISTINCT m FROM iw) ms WHERE len(w) >= m),
hit AS (SELECT DISTINCT dw.rid, dw.j, dw.m, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
p AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(j, j + m)) AS pos FROM (SELECT DISTINCT rid, j, m FROM hit) x) y GROUP BY rid),
n AS (SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) x GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(n.n, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
  coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN n USING (rid)
"""
