"""SQL building blocks for the DuckDB oracle (independent re-statements).

Graph metrics are re-derived by other formulas than the Spark operators:
BFS levels unrolled as MATERIALIZED CTEs, betweenness from pair
dependencies sigma(s,v) sigma(v,t) / sigma(s,t), percentiles from rank
windows, and the power iteration as a chain of steps from which the first
converged one is picked.
"""

from __future__ import annotations

import re

# Fixed values of the registered queries (shared with catalog.py).
TOPIC = "launch"
GIVEN = "user7"
COMPONENT_TOPIC = "happy news"
SEED = "123456789"
GAIN = 500.0
BITS = 256           # DuckDB has no SHA-224; the registered queries hash with SHA-256
BFS_DEPTH = 12       # unrolled levels; the last one must come out empty
MAX_ITER = 100
TOL = 1.0e-6
AS_OF = "2024-02-01 00:00:00"

MENTION = r"@(\w+)"
HASHTAG = r"#(\w+)"
URL = r"(https|http)://([^\s]+)"
P6 = (r"@\w+|^rt |[^a-z| ]|(http|ftp|https)://([\w_-]+(?:(?:\.[\w_-]+)+))"
      r"([\w.,@?^=%&:/~+#-]*[\w@?^=%&/~+#-])?")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def net_posts(topic: str = TOPIC, src: str = "posts") -> str:
    return (f"SELECT post_id, created_at, lower(author) AS author, lower(text) AS text FROM {src} "
            f"WHERE contains(lower(text), {q(topic.lower())}) AND lang = 'en'")


def raw_edges(src: str = "net_posts") -> str:
    return (f"SELECT post_id, CAST(generate_subscripts(ms, 1) - 1 AS BIGINT) AS pos, author AS sender, "
            f"unnest(ms) AS receiver FROM (SELECT post_id, author, regexp_extract_all(text, {q(MENTION)}, 1) AS ms "
            f"FROM {src}) x")


def network_ctes(topic: str = TOPIC, given: str = GIVEN, bits: int = BITS, prefix: str = "",
                 src: str = "posts") -> list[tuple]:
    """net_posts, raw_edges, hmap (node, display), edges (displayed handles); names get ``prefix``."""
    p = prefix
    return [
        (f"{p}net_posts", net_posts(topic, src)),
        (f"{p}raw_edges", raw_edges(f"{p}net_posts")),
        (f"{p}hnodes", f"SELECT sender AS node FROM {p}raw_edges UNION SELECT receiver FROM {p}raw_edges"),
        (f"{p}dict_names", "SELECT DISTINCT lower(screen_name) AS h FROM verified_dictionary"),
        (f"{p}hmap", f"SELECT node, CASE WHEN node = {q(given)} OR d.h IS NOT NULL THEN node "
                     f"ELSE sha{bits}(node) END AS display FROM {p}hnodes LEFT JOIN {p}dict_names d ON node = d.h"),
        (f"{p}edges", f"SELECT e.post_id, e.pos, s.display AS sender, r.display AS receiver FROM {p}raw_edges e "
                      f"JOIN {p}hmap s ON e.sender = s.node JOIN {p}hmap r ON e.receiver = r.node", True),
    ]


def size_sql(edges: str = "edges") -> str:
    return ("SELECT n AS nodes, m AS edges, CASE WHEN n > 1 THEN CAST(m AS DOUBLE) / (n * (n - 1)) * 100.0 ELSE 0.0 END "
            "AS density_pct, CAST(loops AS BIGINT) AS self_loops FROM (SELECT count(*) AS n FROM "
            f"(SELECT sender AS node FROM {edges} UNION SELECT receiver FROM {edges}) x) a CROSS JOIN "
            f"(SELECT count(*) AS m, count(*) FILTER (WHERE sender = receiver) AS loops FROM {edges}) b")


def centrality_ctes(graph: str = "graph", depth: int = BFS_DEPTH, max_iter: int = MAX_ITER,
                    tol: float = TOL) -> list[tuple]:
    """nodes, nn, deg_c, lvl0..lvlD, dist, close_c, betw_c, eig_c, cent, bfs_check."""
    out: list[tuple] = [
        ("nodes", f"SELECT sender AS node FROM {graph} UNION SELECT receiver FROM {graph}", True),
        ("nn", "SELECT count(*) AS n FROM nodes"),
        ("deg", f"SELECT node, sum(o) AS out_n, sum(i) AS in_n FROM (SELECT sender AS node, 1 AS o, 0 AS i FROM {graph} "
                f"UNION ALL SELECT receiver, 0, 1 FROM {graph}) d GROUP BY node"),
        ("deg_c", "SELECT nodes.node, "
                  "CASE WHEN n <= 1 THEN 1.0 ELSE CAST(coalesce(in_n, 0) + coalesce(out_n, 0) AS DOUBLE) / (n - 1) END AS degree, "
                  "CASE WHEN n <= 1 THEN 1.0 ELSE CAST(coalesce(in_n, 0) AS DOUBLE) / (n - 1) END AS in_degree, "
                  "CASE WHEN n <= 1 THEN 1.0 ELSE CAST(coalesce(out_n, 0) AS DOUBLE) / (n - 1) END AS out_degree "
                  "FROM nodes CROSS JOIN nn LEFT JOIN deg ON nodes.node = deg.node"),
        ("adj", f"SELECT DISTINCT sender, receiver FROM {graph} WHERE sender <> receiver", True),
        ("lvl0", "SELECT DISTINCT sender AS src, sender AS node, CAST(1.0 AS DOUBLE) AS sigma FROM adj", True),
    ]
    for d in range(1, depth + 1):
        seen = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM lvl{k} p WHERE p.src = f.src AND p.node = a.receiver)" for k in range(d))
        out.append((f"lvl{d}", f"SELECT f.src, a.receiver AS node, sum(f.sigma) AS sigma FROM lvl{d - 1} f "
                               f"JOIN adj a ON f.node = a.sender WHERE {seen} GROUP BY f.src, a.receiver", True))
    out.append(("dist", " UNION ALL ".join(f"SELECT src, node, {d} AS d, sigma FROM lvl{d}" for d in range(depth + 1)), True))
    out.append(("bfs_check", f"SELECT count(*) AS deepest_rows FROM lvl{depth}"))
    out.append(("reach", "SELECT node, count(*) AS r, sum(d) AS s FROM dist WHERE d >= 1 GROUP BY node"))
    out.append(("close_c", "SELECT nodes.node, CASE WHEN coalesce(s, 0) > 0 AND n > 1 THEN "
                           "(CAST(r AS DOUBLE) / s) * (CAST(r AS DOUBLE) / (n - 1)) ELSE 0.0 END AS closeness "
                           "FROM nodes CROSS JOIN nn LEFT JOIN reach ON nodes.node = reach.node"))
    out.append(("pairdep", "SELECT sv.node AS node, sum(sv.sigma * vt.sigma / st.sigma) AS dep "
                           "FROM dist sv JOIN dist vt ON sv.node = vt.src "
                           "JOIN dist st ON st.src = sv.src AND st.node = vt.node "
                           "WHERE sv.d >= 1 AND vt.d >= 1 AND st.d = sv.d + vt.d GROUP BY sv.node"))
    out.append(("betw_c", "SELECT nodes.node, coalesce(dep, 0.0) * CASE WHEN n > 2 THEN 1.0 / ((n - 1) * (n - 2)) ELSE 1.0 END "
                          "AS betweenness FROM nodes CROSS JOIN nn LEFT JOIN pairdep ON nodes.node = pairdep.node"))
    # power iteration with A + I, L2 normalisation, first step with L1 change < n * tol
    out.append(("push", f"SELECT DISTINCT sender AS node, receiver AS to_node FROM {graph}", True))
    out.append(("x0", "SELECT node, 1.0 / n AS x FROM nodes CROSS JOIN nn", True))
    for k in range(1, max_iter + 1):
        out.append((f"y{k}", f"SELECT a.node, a.x + coalesce(i.inflow, 0.0) AS y FROM x{k - 1} a LEFT JOIN "
                             f"(SELECT p.to_node AS node, sum(b.x) AS inflow FROM push p JOIN x{k - 1} b ON p.node = b.node "
                             f"GROUP BY p.to_node) i ON a.node = i.node", True))
        out.append((f"x{k}", f"SELECT node, y / (SELECT CASE WHEN sqrt(sum(y * y)) = 0 THEN 1.0 ELSE sqrt(sum(y * y)) END "
                             f"FROM y{k}) AS x FROM y{k}", True))
    out.append(("steps", " UNION ALL ".join(
        f"SELECT {k} AS step, sum(abs(a.x - b.x)) AS diff FROM x{k} a JOIN x{k - 1} b ON a.node = b.node"
        for k in range(1, max_iter + 1))))
    out.append(("conv", f"SELECT min(step) AS step FROM steps CROSS JOIN nn WHERE diff < n * {tol!r}"))
    out.append(("xs", " UNION ALL ".join(f"SELECT {k} AS step, node, x FROM x{k}" for k in range(1, max_iter + 1))))
    out.append(("eig_c", "SELECT nodes.node, coalesce(xs.x, 0.0) AS eigenvector FROM nodes "
                         "LEFT JOIN (SELECT xs.node, xs.x FROM xs JOIN conv ON xs.step = conv.step) xs ON nodes.node = xs.node"))
    digits = "CAST(printf('%.9e', {0}) AS DOUBLE)"
    out.append(("cent", "SELECT d.node, degree, in_degree, out_degree, closeness, "
                        f"{digits.format('betweenness')} AS betweenness, {digits.format('eigenvector')} AS eigenvector, "
                        f"degree + closeness + {digits.format('eigenvector')} AS score "
                        "FROM deg_c d JOIN close_c c ON d.node = c.node JOIN betw_c b ON d.node = b.node "
                        "JOIN eig_c e ON d.node = e.node", True))
    return out


def score_ctes(prefix: str, graph: str) -> list[tuple]:
    """{p}score (node, score, pct): the percentile of every account of ``graph``, under names of their own."""
    unread = ("bfs_check", "pairdep", "betw_c", "cent")
    ctes = [c for c in centrality_ctes(graph) if c[0] not in unread]
    ctes.append(("summed", "SELECT d.node, degree + closeness + CAST(printf('%.9e', eigenvector) AS DOUBLE) AS score FROM deg_c d "
                           "JOIN close_c c ON d.node = c.node JOIN eig_c e ON d.node = e.node", True))
    ctes.append(("score_t", "SELECT node, score, ((rank() OVER (ORDER BY score)) - 1 + count(*) OVER (ORDER BY score RANGE BETWEEN "
                            "UNBOUNDED PRECEDING AND CURRENT ROW) + 1) * 50.0 / count(*) OVER () AS pct FROM summed"))
    own = re.compile(r"(?<![\w.])(" + "|".join(c[0] for c in ctes) + r")\b")
    return [(prefix + c[0], own.sub(lambda m: prefix + m.group(1), c[1]), *c[2:]) for c in ctes]


def ranking_ctes(given: str = GIVEN, gain: float = GAIN, seed: str = SEED) -> list[tuple]:
    """pct (cent + percentile), rk (rank order), report rows."""
    u = f"(CAST(('0x' || substr(md5({q(seed)} || node), 1, 8)) AS BIGINT) / 4294967296.0)"
    return [
        ("pct", "SELECT c.*, ((rank() OVER (ORDER BY score)) - 1 "
                "+ count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1) * 50.0 "
                "/ count(*) OVER () AS pct FROM cent c"),
        ("rk", f"SELECT p.*, length(node) < 56 AND node <> {q(given)} AS visible, "
               "row_number() OVER (ORDER BY degree DESC, closeness DESC, eigenvector DESC, node) AS rn FROM pct p"),
        ("g", f"SELECT rn AS g_rn, pct AS g_pct FROM rk WHERE node = {q(given)}"),
        ("gb", "SELECT count(rk.node) AS g_before FROM g LEFT JOIN rk ON rk.visible AND rk.rn < g.g_rn"),
        ("vis", "SELECT rk.*, row_number() OVER (ORDER BY rn) AS vrn FROM rk WHERE visible"),
        ("ntop", "SELECT CASE WHEN g_before <= 9 THEN 9 ELSE 10 END AS n_top FROM gb"),
        ("top_block", "SELECT 'top' AS section, node, pct, score FROM vis CROSS JOIN ntop CROSS JOIN g WHERE vrn <= n_top"),
        ("given_row", f"SELECT 'given' AS section, node, pct, score FROM rk WHERE node = {q(given)}"),
        ("tail_c", f"SELECT vis.*, row_number() OVER (ORDER BY rn) AS trn FROM vis CROSS JOIN ntop CROSS JOIN g "
                   f"WHERE vrn > n_top AND pct <= g_pct AND {u} < {gain!r} / (g_pct * g_pct)"),
        ("tail_block", "SELECT 'tail' AS section, node, pct, score FROM tail_c CROSS JOIN ntop WHERE trn <= 19 - n_top"),
    ]


def sentiment_ctes(corpus: str, dedup: bool = True, prefix: str = "s") -> list[tuple]:
    """{p}_sc (post_id, text, polarity) and {p}_sum (mean, n_posts, example, sd, label)."""
    p = prefix
    if dedup:
        base = f"SELECT min(post_id) AS post_id, text FROM (SELECT post_id, regexp_replace(text, {q(URL)}, 'URL', 'g') AS text FROM {corpus}) m GROUP BY text"
    else:
        base = f"SELECT post_id, text FROM {corpus}"
    return [
        (f"{p}_base", base),
        (f"{p}_tok", f"SELECT post_id, t, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM "
                     f"(SELECT post_id, regexp_extract_all(regexp_replace(text, {q(P6)}, '', 'g'), '[a-z]+', 0) AS t FROM {p}_base) x"),
        (f"{p}_ctx", f"SELECT post_id, tok, CASE WHEN i > 1 THEN t[i - 1] END AS prev1, CASE WHEN i > 2 THEN t[i - 2] END AS prev2 FROM {p}_tok"),
        (f"{p}_word", f"SELECT c.post_id, "
                      f"least(1.0, greatest(-1.0, w.weight * coalesce(iv.weight, 1.0))) "
                      f"* CASE WHEN n1.token IS NOT NULL OR (iv.token IS NOT NULL AND n2.token IS NOT NULL) THEN -0.5 ELSE 1.0 END AS score "
                      f"FROM {p}_ctx c JOIN lexicon w ON w.kind = 'word' AND c.tok = w.token "
                      f"LEFT JOIN lexicon iv ON iv.kind = 'intensifier' AND c.prev1 = iv.token "
                      f"LEFT JOIN lexicon n1 ON n1.kind = 'negator' AND c.prev1 = n1.token "
                      f"LEFT JOIN lexicon n2 ON n2.kind = 'negator' AND c.prev2 = n2.token"),
        (f"{p}_sc", f"SELECT b.post_id, b.text, coalesce(x.pol, 0.0) AS polarity FROM {p}_base b LEFT JOIN "
                    f"(SELECT post_id, avg(score) AS pol FROM {p}_word GROUP BY post_id) x ON b.post_id = x.post_id"),
        (f"{p}_mean", f"SELECT {trunc('avg(polarity)')} AS mean, count(*) AS n_posts FROM {p}_sc"),
        (f"{p}_sum", f"SELECT m.mean, CAST(m.n_posts AS BIGINT) AS n_posts, "
                     f"(SELECT text FROM {p}_sc ORDER BY abs(polarity - m.mean), text, post_id LIMIT 1) AS example, "
                     f"{trunc(f'(SELECT sqrt(avg((polarity - m.mean) * (polarity - m.mean))) FROM {p}_sc)')} AS sd, "
                     f"{label('m.mean')} AS label FROM {p}_mean m"),
    ]


def trunc(x: str) -> str:
    """P13 in SQL: two decimals toward zero for x >= 0, one for x < 0."""
    return (f"(CASE WHEN ({x}) >= 0 THEN CAST(floor(CAST(({x}) AS DECIMAL(20,10)) * 100) AS DOUBLE) / 100 "
            f"ELSE CAST(ceil(CAST(({x}) AS DECIMAL(20,10)) * 10) AS DOUBLE) / 10 END + 0.0)")


def label(x: str) -> str:
    return (f"CASE WHEN {x} <= -0.5 THEN 'very negative' WHEN {x} <= -0.3 THEN 'negative' "
            f"WHEN {x} <= -0.1 THEN 'slightly negative' WHEN {x} < 0.1 THEN 'neutral' "
            f"WHEN {x} < 0.3 THEN 'slightly positive' WHEN {x} < 0.5 THEN 'positive' "
            f"WHEN {x} >= 0.5 THEN 'very positive' END")
