"""The fixture rules of ``fixtures.py`` stated in SQL for the DuckDB oracle.

``with_fixtures(sql, *names)`` prefixes a query with the CTEs it needs; the
supplied tables are views of the same names in the oracle session.
"""

from __future__ import annotations

from murmuration.sources import fixtures as fx

_SQL = {
    "posts": f"""
SELECT event_id AS post_id,
       concat('User', CAST(user_id AS VARCHAR)) AS author,
       ts AS created_at,
       event_type = 'view' AS is_retweet,
       CASE WHEN k % 10 = 0 THEN 'de' ELSE 'en' END AS lang,
       CASE event_type
         WHEN 'view' THEN concat('RT @User', CAST(b AS VARCHAR), ': Great launch, love it #Launch',
                                 CAST(k % 3 AS VARCHAR), ' https://t.example/', CAST(event_id AS VARCHAR))
         WHEN 'click' THEN concat('Hi @User', CAST(b AS VARCHAR), ' and @user', CAST(c AS VARCHAR),
                                  ' not good!! #Promo #promo', CAST(k % 5 AS VARCHAR),
                                  ' http://t.example/', CAST(event_id AS VARCHAR))
         WHEN 'error' THEN concat('Terrible service, very bad day ', CAST(k AS VARCHAR), ' #Fail')
         WHEN 'signup' THEN concat('Thanks @User', CAST(g AS VARCHAR), ' for the happy news #Launch')
         ELSE CASE WHEN k < 4 THEN concat('Mail me: x', CAST(k AS VARCHAR), '@shop.example buying stuff')
                   ELSE concat('Buying stuff as @User', CAST(user_id AS VARCHAR)) END
       END AS text
FROM (SELECT event_id, ts, user_id, event_type, k,
             (user_id * user_id + 7 * k + 3) % space AS b,
             (user_id + k * k) % space AS c,
             user_id - user_id % {fx.COMMUNITY} + k % {fx.COMMUNITY} AS g
      FROM (SELECT event_id, ts, user_id, event_type,
                   CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
            FROM events) e0
      CROSS JOIN (SELECT max(user_id) + 1 AS space FROM events) s) e1""",
    "raw_posts": """
SELECT post_id AS id, author AS screen_name, created_at, lang,
       CASE WHEN is_retweet THEN substr(text, 1, 40) ELSE text END AS full_text,
       CASE WHEN second(created_at) < 2 THEN NULL
            ELSE regexp_extract(text, '@(\\w+)', 1) END AS first_mention,
       CASE WHEN is_retweet AND lang <> 'de'
            THEN substr(text, strpos(text, ': ') + 2) END AS rt_full_text
FROM posts""",
    "accounts": f"""
SELECT c_custkey AS account_id,
       concat('User', CAST(c_custkey AS VARCHAR)) AS screen_name,
       CASE WHEN c_nationkey = {fx.NO_FLAG_NATION} THEN NULL
            ELSE c_acctbal >= {fx.VERIFIED_MIN_BALANCE} END AS verified
FROM customer WHERE c_nationkey <> {fx.NOT_FOUND_NATION}""",
    "friend_ids": "SELECT o_custkey AS account_id FROM orders",
    "previous_friend_ids": f"""
SELECT o_custkey AS account_id FROM orders WHERE o_orderdate < TIMESTAMP '{fx.ORDERS_CUTOFF}'""",
    "verified_dictionary": """
SELECT CAST(account_id AS VARCHAR) AS account_id, screen_name FROM accounts WHERE verified""",
    "lexicon": "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', {w}, '{k}')" for t, w, k in fx.LEXICON_ROWS) + ") AS v(token, weight, kind)",
    "stop_words": "SELECT * FROM (VALUES " + ", ".join(
        "('" + w.replace("'", "''") + "')" for w in fx.STOP_WORDS) + ") AS v(token)",
}

_DEPS = {
    "posts": (), "raw_posts": ("posts",), "accounts": (), "friend_ids": (),
    "previous_friend_ids": (), "verified_dictionary": ("accounts",),
    "lexicon": (), "stop_words": (),
}


def fixture_sql(name: str) -> str:
    return _SQL[name]


def with_fixtures(body: str, *names: str, extra: list[tuple] | None = None) -> str:
    """``WITH <fixture CTEs>, <extra CTEs> <body>`` with dependencies first.

    ``extra`` holds (name, sql) or (name, sql, True) for a MATERIALIZED CTE.
    """
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS[n]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({_SQL[n]}\n)" for n in ordered]
    for item in extra or []:
        n, q = item[0], item[1]
        mat = " MATERIALIZED" if len(item) > 2 and item[2] else ""
        ctes.append(f"{n} AS{mat} ({q}\n)")
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
