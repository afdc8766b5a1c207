"""Small tables with awkward rows."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) if rng.random() < 0.7
                    else rng.choice(["the", "of", "and", "in", "to"]) for _ in range(n))


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(rng.choice(["changed", "word"]) if rng.random() < share else w for w in text.split(" "))


def rows():
    """Copies, near copies, shared passages, nulls, blanks, ties, repeated rows and a very long text."""
    base = [prose(s, 120) for s in range(6)]
    passage = prose(99, 60)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, t.upper()) for i, t in enumerate(base[:2])]                       # equal but for case
    out += [(100 + i, edited(base[0], i, 0.02)) for i in range(45)]                     # a large group of near copies
    out += [(200 + i, passage + " " + prose(300 + i, 40)) for i in range(45)]           # a passage in many texts
    out += [(300 + i, base[3] + "\n" + passage + "\n" + prose(500 + i, 30)) for i in range(5)]
    out += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one"), (405, "one two three"), (406, "a b c d"), (407, "a b c d e")]
    out += [(None, base[4]), (None, None), (500, base[5]), (500, base[5]), (501, prose(7, 9000)), (502, "é ü 中文 字 x y ÀB")]
    return [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t) if t is not None else None) for i, t in out]


def documents(spark, extra=True):
    df = spark.createDataFrame(rows(), SCHEMA)
    if extra:   # names that operators use inside
        for c in ("h", "node", "n_words", "kept", "quality", "mix_slot", "_h", "_d", "id", "key", "hash", "pos", "_q_w"):
            df = df.withColumn(c, F.lit("x"))
    return df


def pairs():
    return [(r[0], r[1]) for r in rows()]
