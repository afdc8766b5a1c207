"""Phrase collocations of any corpus by multikey three-way quicksort of suffixes.

A suffix is a word position with the words after it, MAX_WORDS at most, inside
its piece of text. Suffixes are routed by their language and two leading words,
so all suffixes that start with a phrase meet; there a multikey three-way
quicksort orders pointers to them word by word, the sizes of its equal
partitions are the phrases' counts, and every partition below ``least`` is
abandoned at once, whatever it holds.

What is routed is kept small without losing a phrase: a phrase that occurs
``least`` times consists of word pairs that do. Pairs are counted first, by a
hash of PAIR_BITS bits, and the frequent ones set bits of a filter of fixed
size (FILTER_BITS); suffixes end before a pair that is not in it. Pairs with
equal hashes and a full filter only let more through. Tasks add up equal
suffixes before they are routed, the commonest words (NUMBERED of them at
most) travel as small numbers, and the suffixes of the very frequent pairs (HOT
of them at most) are routed by three words, beside one row with the pair's own
count.

Words are compared by 63-bit hashes: V distinct words have two equal ones with
probability V^2 / 2^64 (10^8 words: 0.0005).

Defined results: null texts are empty, a null language is ``und``; repeated
rows count each time; empty tables have no phrases; words of any length count;
extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import Words, byte_table, map_texts, mix
from murmuration.session import cut_lineage

MAX_WORDS = 4
LEAST = 30              # occurrences of a candidate
TOP = 2000              # phrases of a language
COVERED = 80            # percent of a phrase's occurrences that lie in one longer candidate
SCALE = 2_000_000
FILTER_BITS = 1 << 26   # 8 MB
HOT = 1000              # a pair with this share of all words is routed by three words
NUMBERED = 1 << 17      # a word with this share of all words gets a number
PAIR_BITS, ROUTE_BITS = 40, 24
BUFFER = 24 << 20       # bytes of suffixes, pairs or words that a task adds up before it passes them on
ROUTED = 1 << 18        # suffixes sorted at once
NUL = 0xFF              # stands for the character U+0000, in no UTF-8 text

_PIECE = [ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))
TABLE = byte_table([0x20, 0x09, *_PIECE])
TABLE[0] = NUL
_ENDS = np.zeros(256, bool)
_ENDS[_PIECE] = True


class Tokens:
    """Words of a few texts: their hashes, languages, and the pieces they lie in."""

    def __init__(self, texts: list[str], lang: np.ndarray):
        words = Words(texts, TABLE)
        raw = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\0", np.uint8)
        self.words = words
        self.hash = np.maximum(words.hash, np.uint64(1))    # 0: no word
        self.lang = lang[words.doc]
        self.piece = np.cumsum(_ENDS[raw], dtype=np.int64)[words.start]

    def together(self) -> np.ndarray:
        """For each word but the last, whether the next one lies in its piece."""
        return self.piece[1:] == self.piece[:-1]

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at some places."""
        start, size = self.words.start[at], (self.words.end - self.words.start)[at]
        offset = np.concatenate([[0], np.cumsum(size)])
        data = self.words.blob[np.arange(offset[-1]) + np.repeat(start - offset[:-1], size)]
        data = np.where(data == NUL, 0, data).astype(np.uint8)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several columns."""
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + x)
    return h


def _groups(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, starts and sizes of groups of equal rows; ``key`` is a hash of ``columns``, which are compared too.

    The rows are ordered by the first of the columns, then by ``key``.
    """
    order = np.lexsort((key, columns[0])) if columns else np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    start = np.flatnonzero(new)
    return order, start, np.diff(np.append(start, len(key)))


class _Sums:
    """Columns of rows, kept until they have BUFFER bytes."""

    def __init__(self):
        self.parts, self.bytes = [], 0

    def add(self, part: list) -> bool:
        self.parts.append(part)
        self.bytes += sum(c.nbytes for c in part)
        return self.bytes >= BUFFER

    def take(self) -> list:
        parts, self.parts, self.bytes = self.parts, [], 0
        return [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*parts)]


def _summed(docs: DataFrame, part: Callable, pack: Callable, schema: dict[str, str]) -> DataFrame:
    """``pack`` of the parts that ``part(Tokens)`` gives, a buffer of them at a time."""
    def fn(rows, texts, state):
        lang = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return pack(state.take()) if state.add(part(Tokens(texts, lang))) else None

    return map_texts(docs, fn, schema, setup=_Sums, finish=lambda state: pack(state.take()) if state.parts else None)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang_key, word, n) of every word of every language; a null word has the number of all."""
    def part(t):
        key = chain(t.lang, t.hash)
        order, start, size = _groups(key)
        at = order[start]
        return [key[at], t.lang[at], size, t.strings(at)]

    def pack(cols):
        key, lang, n, word = cols
        order, start, _ = _groups(key)
        at = order[start]
        langs, back = np.unique(lang, return_inverse=True)
        total = np.bincount(back, n, len(langs)).astype(np.int64)
        return [np.concatenate([lang[at], langs]).view(np.int64), pa.concat_arrays([word.take(pa.array(at)), pa.nulls(len(langs), pa.string())]),
                np.concatenate([np.add.reduceat(n[order], start), total])]

    got = _summed(docs, part, pack, {"lang_key": "long", "word": "string", "n": "long"})
    return got.groupBy("lang_key", "word").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(pair, n) of the hashes of all word pairs of a language."""
    def part(t):
        key = pair_key(t)[t.together()] if len(t.hash) else t.hash
        order, start, size = _groups(key)
        return [key[order[start]], size]

    def pack(cols):
        order, start, _ = _groups(cols[0])
        return [cols[0][order[start]].view(np.int64), np.add.reduceat(cols[1][order], start)]

    return _summed(docs, part, pack, {"pair": "long", "n": "long"}).groupBy("pair").agg(F.sum("n").alias("n"))


def pair_key(t: Tokens) -> np.ndarray:
    """PAIR_BITS bits for each word and the next, in one piece or not."""
    return chain(t.lang[:-1], t.hash[:-1], t.hash[1:]) >> np.uint64(64 - PAIR_BITS)


def bit_filter(pairs: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, as bytes, with those of ``pairs`` set."""
    cell = F.pmod("pair", F.lit(FILTER_BITS)) + 1    # bitmap positions count from 1
    rows = pairs.groupBy(F.bitmap_bucket_number(cell).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, bits in rows:    # 4 KB each, all of them as large as the filter
        out[(b - 1) * 4096:][:4096] = np.frombuffer(bits, np.uint8)
    return out


def codes(h: np.ndarray, numbered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The words' numbers, or their hashes with the highest bit set."""
    known, number = numbered
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    high = h | np.uint64(1 << 63)
    return np.where(known[at] == h, number[at], high) if len(known) else high


def suffixes(docs: DataFrame, bits: np.ndarray, hot: np.ndarray, numbered: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(route, lang_key, w1 .. w4, c2, c): suffixes of frequent pairs, their words as ``codes``, and how often a task met them.

    ``w3`` and ``w4`` are 0 where the suffix ends. ``c2`` counts towards its
    pair, ``c`` towards longer phrases; they differ for ``hot`` pairs only.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bits, np.sort(hot), numbered))

    def part(t):
        bits, hot, numbered = shared.value
        n = max(len(t.hash) - 1, 0)
        pair = pair_key(t) if n else t.hash[:0]
        cell = (pair % np.uint64(FILTER_BITS)).astype(np.int64)
        on = np.zeros(n + MAX_WORDS, bool)
        on[:n] = t.together() & ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool) if n else on[:0]
        at = np.flatnonzero(on)
        word = np.concatenate([codes(t.hash, numbered), np.zeros(MAX_WORDS, np.uint64)])
        cols, far = [t.lang[at], word[at], word[at + 1]], np.ones(len(at), bool)
        for k in range(2, MAX_WORDS):
            far = far & on[at + k - 1]
            cols.append(np.where(far, word[at + k], np.uint64(0)))
        route = pair[at]
        often = np.isin(route, hot) if len(hot) else np.zeros(len(at), bool)
        longer = often & (cols[3] != 0)
        one = np.ones(len(at), np.int64)
        route = route >> np.uint64(PAIR_BITS - ROUTE_BITS)
        rows = [np.where(longer, chain(pair[at], cols[3]) >> np.uint64(64 - ROUTE_BITS), route), *cols, np.where(often, 0, one), one]
        own = [route[often], *[c[often] for c in cols[:3]], *[np.zeros(often.sum(), np.uint64)] * (MAX_WORDS - 2), one[often], one[often] * 0]
        rows = [np.concatenate(c) for c in zip(rows, own)]
        return add_up(chain(*rows[1:-2], (rows[-1] > 0).astype(np.uint64)), rows)

    def add_up(key, rows):
        order, start, _ = _groups(key, *rows[:-2])
        sums = [np.add.reduceat(c[order], start) if len(start) else c for c in rows[-2:]]
        return [key[order[start]], *[c[order[start]] for c in rows[:-2]], *sums]

    def pack(cols):
        return [c.view(np.int64) for c in add_up(cols[0], cols[1:])[1:]]

    names = ["route", "lang_key", *[f"w{k}" for k in range(1, MAX_WORDS + 1)], "c2", "c"]
    return _summed(docs, part, pack, dict.fromkeys(names, "long"))


def three_way(words: np.ndarray, c2: np.ndarray, c: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers to the rows of ``words`` (language, words, 0 where none): (row, words, count) of the frequent phrases.

    All open partitions are split in one turn: the column at a partition's
    depth is compared with its middle row's. The equal part goes on one word
    deeper, and parts that hold fewer than ``least`` suffixes are abandoned.
    """
    ptr, seg = np.arange(len(words)), np.zeros(len(words), np.int64)
    start, depth = np.zeros(min(1, len(words)), np.int64), np.zeros(min(1, len(words)), np.int64)
    found = []
    while len(ptr):
        size = np.diff(np.append(start, len(ptr)))
        pivot = words[ptr[start + size // 2], depth]
        key = words[ptr, depth[seg]]
        side = (key >= pivot[seg]).astype(np.int64) + (key > pivot[seg])
        part = 3 * seg + side
        many = 3 * len(start)
        n2, n = (np.bincount(part, x[ptr], many).astype(np.int64) for x in (c2, c))
        deep = np.repeat(depth, 3)
        deep[1::3] += 1
        # a phrase of two words or more ends where an equal part begins
        ends = (np.arange(many) % 3 == 1) & (deep > 2) & (np.repeat(pivot, 3) != 0)
        count = np.where(deep == 3, n2, n)
        report = np.flatnonzero(ends & (count >= least))
        if len(report):
            some = np.zeros(many, np.int64)
            some[part] = ptr
            found.append((some[report], deep[report] - 1, count[report]))
        goes_on = np.where(deep < 3, np.maximum(n2, n), n) >= least
        goes_on &= deep < words.shape[1]
        goes_on[1::3] &= (pivot != 0) | (depth == 0)
        stays = goes_on[part]
        # positions in the new order: counted inside each part
        ptr, part, old = ptr[stays], part[stays], side[stays]
        kept = np.bincount(part, minlength=many)
        first = np.cumsum(kept) - kept
        place = np.empty(len(ptr), np.int64)
        for s in range(3):
            mine = np.flatnonzero(old == s)
            p = part[mine]
            before = np.cumsum(kept[s::3]) - kept[s::3]
            place[mine] = first[p] + np.arange(len(mine)) - before[p // 3]
        moved = np.empty_like(ptr)
        moved[place] = ptr
        ptr = moved
        open_parts = np.flatnonzero(kept)
        seg = np.repeat(np.arange(len(open_parts)), kept[open_parts])
        start, depth = first[open_parts], deep[open_parts]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def phrase_counts(rows: DataFrame, least: int) -> DataFrame:
    """(key, a): frequent phrases as arrays of their language and words, from routed ``suffixes``."""
    out = pa.schema([("key", pa.list_(pa.int64())), ("a", pa.int64())])

    def sort(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(i).to_numpy() for i in range(1, table.num_columns)]
        words = np.stack(cols[:-2], axis=1).view(np.uint64)
        row, depth, n = three_way(words, cols[-2], cols[-1], least)
        whole = words[row]
        inside = np.arange(whole.shape[1]) <= depth[:, None]
        offset = np.concatenate([[0], np.cumsum(depth + 1)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offset), pa.array(whole[inside].view(np.int64))), pa.array(n)], schema=out)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= ROUTED:
                table = pa.Table.from_batches(held)
                route = table.column(0).to_numpy()
                cut = int(np.searchsorted(route, route[-1]))    # the last route may go on in the next batch
                if cut:
                    yield sort(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size -= cut
        if size:
            yield sort(pa.Table.from_batches(held))

    return rows.repartition("route").sortWithinPartitions("route").mapInArrow(run, "key array<long>, a long")


def coded_words(counts: DataFrame, all_words: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """``word_counts`` with the words' ``codes`` as ``w``, and the numbered words' hashes, ordered, with their numbers."""
    def fn(rows, texts, _):
        return [rows.column(0), rows.column(1), rows.column(2), np.maximum(Words(texts, TABLE).hash, np.uint64(1)).view(np.int64)]

    words = map_texts(counts.select("lang_key", "word", "n"), fn, {"lang_key": "long", "word": "string", "n": "long", "h": "long"}, text="word")
    words = cut_lineage(words)
    often = words.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * NUMBERED > all_words)    # fewer than NUMBERED
    known = np.array([r["h"] for r in often.orderBy(F.col("n").desc(), "h").select("h").collect()], np.int64).view(np.uint64)
    order = np.argsort(known)
    numbered = known[order], (order + 1).astype(np.uint64)

    def code(batches):
        for batch in batches:
            w = codes(batch.column(3).to_numpy().view(np.uint64), numbered).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(w)], names=["lang_key", "word", "n", "w"])

    return cut_lineage(words.mapInArrow(code, "lang_key long, word string, n long, w long")), numbered


def cut(key: Column | str, first: Column, last: Column) -> Column:
    """The key of the words ``first`` to ``last`` (from 1) of a phrase."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.slice(key, 1, 1), F.slice(key, first + 1, last - first + 1))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to MAX_WORDS words."""
    own = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).withColumn("lang_key", F.xxhash64("lang"))
    texts = own.select("lang_key", "text")
    counts = cut_lineage(word_counts(texts).filter(F.col("word").isNull() | (F.col("n") >= least)))
    total = counts.filter("word IS NULL").select("lang_key", "n")
    all_words = total.agg(F.sum("n")).first()[0] or 0
    words, numbered = coded_words(counts.filter("word IS NOT NULL"), all_words)
    pairs = cut_lineage(pair_counts(texts).filter(F.col("n") >= least))
    hot = np.array([r[0] for r in pairs.filter(F.col("n") * HOT > all_words).select("pair").collect()], np.int64).view(np.uint64)
    found = cut_lineage(phrase_counts(suffixes(texts, bit_filter(pairs), hot, numbered), least))

    # both parts of a phrase occur as often as it does: they are known
    known = words.select(F.array("lang_key", "w").alias("key"), F.col("n").alias("f")).unionByName(found.select("key", F.col("a").alias("f")))
    size = F.size("key") - 1
    cuts = found.select("key", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", cut("key", F.lit(1), F.col("k")).alias("left"), cut("key", F.col("k") + 1, size).alias("right"))
    cuts = (cuts.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
                .join(known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right"))
    score = F.expr(f"cast({SCALE} AS decimal(10,0)) * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    best = cuts.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")).select("key", "a", "b.*")

    # phrases that lie in a longer candidate most of the time go
    places = [(i, j) for i in range(1, MAX_WORDS + 1) for j in range(i + 1, MAX_WORDS + 1)]
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in places])
    longer = found.filter(size > 2).withColumn("p", F.explode(parts)).filter((F.col("p.j") <= size) & (F.col("p.j") - F.col("p.i") + 1 < size))
    longer = longer.groupBy(cut("key", F.col("p.i"), F.col("p.j")).alias("key")).agg(F.max("a").alias("most"))
    best = best.join(longer, "key", "left").filter(F.coalesce(F.col("most"), F.lit(0)).cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVERED)

    order = [F.col("score").desc(), F.col("a").desc()]
    best = best.withColumn("lang_key", F.get("key", F.lit(0)))
    by_lang = Window.partitionBy("lang_key")
    best = best.withColumn("place", F.rank().over(by_lang.orderBy(*order))).filter(F.col("place") <= top)    # ties are told apart below
    best = cut_lineage(best)
    spelled = best.select("key", "lang_key", F.posexplode(F.slice("key", 2, MAX_WORDS)).alias("at", "w")).join(words.select("lang_key", "w", "word"), ["lang_key", "w"])
    spelled = spelled.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    langs = own.select("lang", "lang_key").distinct()
    got = best.join(spelled, "key").join(total, "lang_key").join(langs, "lang_key")
    got = got.withColumn("rank", F.row_number().over(by_lang.orderBy(*order, "phrase"))).filter(F.col("rank") <= top)
    return got.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    """The best phrases of every language of ``docs``."""
    return collocations(docs)


OP12_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT lang, w[i:i + k - 1] AS ph FROM i, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, ph, count(*) AS f FROM s GROUP BY lang, ph HAVING count(*) >= {LEAST}),
c AS (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1),
k AS (SELECT *, unnest(range(1, len(ph))) AS k FROM c),
x AS (SELECT k.lang, k.ph, a, k, l.f AS l, r.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.ph = k.ph[1:k] JOIN f r ON r.lang = k.lang AND r.ph = k.ph[k + 1:len(k.ph)]),
best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
part AS (SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS most FROM (SELECT *, unnest(range(1, len(ph))) AS i FROM c), (SELECT unnest(range(2, {MAX_WORDS})) AS m)
  WHERE m < len(ph) AND i + m - 1 <= len(ph) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.ph, ' ') AS phrase FROM best LEFT JOIN part ON part.lang = best.lang AND part.ph = best.ph
  WHERE 100 * CAST(coalesce(most, 0) AS HUGEINT) < {COVERED} * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= {TOP}
"""
