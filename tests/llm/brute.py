"""Plain reference computations for small inputs."""

import collections
import hashlib
import math
import re
from fractions import Fraction


def lower_ascii(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(t or ""))


def components(sets, num=80, den=100):
    """Component number of each non-empty set, links at Jaccard >= num/den; all pairs that share an element."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    seen = collections.defaultdict(list)
    for i, s in enumerate(sets):
        near = {j for g in s for j in seen[g]}
        for j in near:
            x = len(s & sets[j])
            if den * x >= num * (len(s) + len(sets[j]) - x):
                parent[find(i)] = find(j)
        for g in s:
            seen[g].append(i)
    return [find(i) for i in range(len(sets))]


def shingles(t, k):
    w = words(t)
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def near_duplicates(docs, k=4):
    """[(doc_id, n_shingles, component_id)] for rows (doc_id, text)."""
    distinct = list(dict.fromkeys(s for s in (shingles(t, k) for _, t in docs) if s))
    part = dict(zip(distinct, components(distinct)))
    least = {}
    for i, t in docs:
        s = shingles(t, k)
        if s and i is not None:
            least[part[s]] = min(least.get(part[s], i), i)
    return [(i, len(s), least.get(part[s]) if s else i) for i, s in ((i, shingles(t, k)) for i, t in docs)]


def line_sets(norm, k=5):
    return frozenset(norm[i:i + k] for i in range(len(norm) - k + 1)) if len(norm) >= k else frozenset([norm])


def dropped_lines(docs):
    """{(doc_id, text): positions} of the lines to drop."""
    at = collections.defaultdict(set)
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            n = line.strip(" \t\n\x0b\f\r").lower()
            if len(n) >= 12:
                at[n].add((i is None, -1 if i is None else i, t, p))
    nodes = list(at)
    groups = collections.defaultdict(set)
    for n, c in zip(nodes, components([line_sets(n) for n in nodes])):
        groups[c] |= at[n]
    out = collections.defaultdict(list)
    for g in groups.values():
        for x in g - {min(g)}:
            out[(None if x[0] else x[1], x[2])].append(x[3])
    return {k: sorted(v) for k, v in out.items()}


def windows(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or ""))


def contamination(docs, items):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)]."""
    table = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, t in items:
        w = windows(t)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            table[m][tuple(w[j:j + m])].add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = windows(t), set(), set()
        for m, known in table.items():
            for j in range(len(w) - m + 1):
                ids = known.get(tuple(w[j:j + m]))
                if ids:
                    found |= ids
                    hit |= set(range(j, j + m))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def quality(t):
    """The contract's statistics and base verdict of one text."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeat),
            "base_failed": len(w) < 50 or 100 * len(repeat) > 50 * len(w)}


def mixture(docs, block_rows, weight=None):
    """{(doc_id, source): (block, slot, row)} by a slot-by-slot simulation over rows (doc_id, source), ids distinct."""
    by = collections.defaultdict(list)
    for i, s in docs:
        by["-" if s is None else "+" + s].append(i)
    names = sorted(by)
    weight = {s: Fraction(weight[s]) if weight else Fraction(int(math.sqrt(len(by[s])) * 2**20)) for s in names}
    total = sum(weight.values())
    blocks = {s: -(-len(by[s]) // block_rows) for s in names}
    had, slots, t = dict.fromkeys(names, 0), {}, 0
    while any(had[s] < blocks[s] for s in names):
        ready = [(math.ceil((had[s] + 1) * total / weight[s]), s) for s in names
                 if had[s] < blocks[s] and math.floor(had[s] * total / weight[s]) <= t]
        if ready:
            s = min(ready)[1]
            slots[s, had[s]] = t
            had[s] += 1
        t += 1
    out = {}
    for s in names:
        order = sorted(by[s], key=lambda i: (hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i))
        for n, i in enumerate(order):
            out[i, s] = (n // block_rows, slots[s, n // block_rows], n % block_rows)
    return out


def passes_rules(t, rules, stop_words):
    """The method's verdict of the quality rules."""
    q = quality(t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    q |= {"n_lines": len(lines), "n_alpha_words": sum(any(c.isalpha() for c in x) for x in w),
          "n_stop_words": sum(x.lower() in stop_words for x in w), "n_shouts": (t or "").count("!"),
          "n_ellipsis_lines": sum(x.endswith(("...", "…")) for x in lines), "n_bullet_lines": sum(x.startswith(("- ", "* ", "•")) for x in lines)}
    return not q["base_failed"] and all((least is None or 100 * q[a] >= least * q[b]) and (most is None or 100 * q[a] <= most * q[b])
                                        for _, a, b, least, most in rules)


def pipeline(docs, items, rules, stop_words):
    """{doc_id: text} after the first four stages over rows (doc_id, text) with distinct ids."""
    docs = [(i, t) for i, t in docs if passes_rules(t, rules, stop_words)]
    gone, left = dropped_lines(docs), []
    for i, t in docs:
        drop = gone.get((i, t))
        new = t if drop is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop)
        if new.strip(" \t\n\x0b\f\r"):
            left.append((i, new))
    least = {i for i, n, c in near_duplicates(left, 5) if i == c}
    left = [(i, t) for i, t in left if i in least]
    bad = {r[0] for r in contamination(left, items) if r[-1]}
    return {i: t for i, t in left if i not in bad}
