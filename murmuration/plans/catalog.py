"""The query catalogue: one Spark query per operator of the survey, each with
an independent SQL statement of the same result for the DuckDB oracle.

Every query reads the supplied tables (through the fixture adapters) in
full. Doubles are rounded to 6 decimals and integers are BIGINT in both
engines so results hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from murmuration.functions import privacy as PV
from murmuration.functions import text as T
from murmuration.operators import accounts as A
from murmuration.operators import centrality as C
from murmuration.operators import components as CC
from murmuration.operators import export as X
from murmuration.operators import graph as G
from murmuration.operators import posts as P
from murmuration.operators import ranking as R
from murmuration.operators import sentiment as S
from murmuration.operators import topics as TP
from murmuration.plans import oracle as O
from murmuration.plans.network import NetworkParams, analyse_network, handle_map, network_edges, network_posts
from murmuration.plans.verified import update_dictionary
from murmuration.session import cut_lineage
from murmuration.sources import fixtures as fx
from murmuration.sources.fixture_sql import with_fixtures
from murmuration.sources.settled import SettledStore

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; cast every integral column to BIGINT."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (Ty.DoubleType, Ty.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, (Ty.IntegerType, Ty.ShortType, Ty.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ shared inputs

def _posts(spark, sf):
    return fx.posts(spark, sf)


def _params(**kw) -> NetworkParams:
    base = dict(query=O.TOPIC, given_user=O.GIVEN, hash_bits=O.BITS, gain=O.GAIN, seed=O.SEED)
    base.update(kw)
    return NetworkParams(**base)


def _network(spark, sf, **kw):
    return analyse_network(_posts(spark, sf), fx.verified_dictionary(spark, sf), _params(**kw))


def _lower_posts(spark, sf, topic=O.TOPIC):
    return network_posts(_posts(spark, sf), _params(query=topic))


NET = O.network_ctes()
CENT = NET + [("graph", "SELECT sender, receiver FROM edges")] + O.centrality_ctes()
RANK = CENT + O.ranking_ctes()


def net_sql(body: str, extra: list[tuple] | None = None, base: list[tuple] | None = None,
            names: tuple[str, ...] = ()) -> str:
    return with_fixtures(body, "posts", "verified_dictionary", *names,
                         extra=(base if base is not None else NET) + (extra or []))


# ================================================================== 2.1 sources

@query("topic_posts", with_fixtures(
    "SELECT post_id, author, is_retweet, text FROM posts WHERE contains(lower(text), 'launch') AND lang = 'en'", "posts"))
def q_topic_posts(spark, sf):
    return P.topic_posts(_posts(spark, sf), O.TOPIC).select("post_id", "author", "is_retweet", "text")


@query("posts_by_account", with_fixtures(
    "SELECT post_id, text FROM posts WHERE lower(author) = 'user7'", "posts"))
def q_posts_by_account(spark, sf):
    return P.posts_by_account(_posts(spark, sf), "User7").select("post_id", "text")


@query("posts_at_account", with_fixtures(
    f"SELECT post_id, author, text FROM posts WHERE lang = 'en' "
    f"AND list_contains(regexp_extract_all(lower(text), {O.q(O.MENTION)}, 1), 'user7')", "posts"))
def q_posts_at_account(spark, sf):
    return P.posts_at_account(_posts(spark, sf), "@User7").select("post_id", "author", "text")


@query("mentions_on_topic", with_fixtures(
    "SELECT post_id, author, text FROM posts WHERE lang = 'en' AND contains(lower(text), 'user7') "
    "AND contains(lower(text), 'launch')", "posts"))
def q_mentions_on_topic(spark, sf):
    return P.mentions_on_topic(_posts(spark, sf), "User7", O.TOPIC).select("post_id", "author", "text")


@query("account_ids", with_fixtures("SELECT DISTINCT account_id FROM friend_ids", "friend_ids"))
def q_account_ids(spark, sf):
    """The listing as it came, repeats included, is stored; its distinct ids are read from the cached copy."""
    path = _scratch(spark, "id-listing")
    SK.save_account_ids(fx.friend_ids(spark, sf), path)
    return A.unique_ids(RD.read_account_ids(spark, path))


# ================================================================== 2.3 projections

@query("resolve_full_text", with_fixtures(
    "SELECT id, CASE WHEN contains(full_text, 'RT @') THEN coalesce('RT @' || first_mention || ': ' || rt_full_text, full_text) "
    "ELSE full_text END AS text FROM raw_posts", "raw_posts"))
def q_resolve_full_text(spark, sf):
    r = fx.raw_posts(spark, sf)
    return r.select("id", T.resolve_full_text("full_text", "entities.user_mentions", "retweeted_status.full_text").alias("text"))


@query("normalise_case", with_fixtures(
    "SELECT post_id, lower(author) AS author, lower(text) AS text FROM posts", "posts"))
def q_normalise_case(spark, sf):
    return _posts(spark, sf).select("post_id", F.lower("author").alias("author"), F.lower("text").alias("text"))


@query("extract_mentions", with_fixtures(
    f"SELECT post_id, CAST(generate_subscripts(ms, 1) - 1 AS BIGINT) AS pos, unnest(ms) AS handle FROM "
    f"(SELECT post_id, regexp_extract_all(lower(text), {O.q(O.MENTION)}, 1) AS ms FROM posts) x", "posts"))
def q_extract_mentions(spark, sf):
    p = _posts(spark, sf)
    return p.select("post_id", F.posexplode(T.extract_mentions(F.lower("text"))).alias("pos", "handle")) \
            .select("post_id", F.col("pos").cast("long").alias("pos"), "handle")


@query("extract_hashtags", with_fixtures(
    f"SELECT post_id, CAST(generate_subscripts(ts, 1) - 1 AS BIGINT) AS pos, unnest(ts) AS tag FROM "
    f"(SELECT post_id, regexp_extract_all(text, {O.q(O.HASHTAG)}, 1) AS ts FROM posts) x", "posts"))
def q_extract_hashtags(spark, sf):
    p = _posts(spark, sf)
    return p.select("post_id", F.posexplode(T.extract_hashtags("text")).alias("pos", "tag")) \
            .select("post_id", F.col("pos").cast("long").alias("pos"), "tag")


@query("mask_urls", with_fixtures(
    f"SELECT post_id, regexp_replace(text, {O.q(O.URL)}, 'URL', 'g') AS masked FROM posts", "posts"))
def q_mask_urls(spark, sf):
    return _posts(spark, sf).select("post_id", T.mask_urls("text").alias("masked"))


@query("clean_for_sentiment", with_fixtures(
    f"SELECT post_id, regexp_replace(lower(text), {O.q(O.P6)}, '', 'g') AS clean FROM posts", "posts"))
def q_clean_for_sentiment(spark, sf):
    return _posts(spark, sf).select("post_id", T.clean_for_sentiment(F.lower("text")).alias("clean"))


def _topic_clean_sql(col: str) -> str:
    out = f"lower({col})"
    # Unicode word class as RE2 spells it (the corpora hold letters, digits, space and newline)
    for pat in (r"http\S+", r"bit.ly/\S+", r"rt @[\p{L}0-9_]+:", r"#[\p{L}0-9_]+", r"[^\p{L}0-9_\s]", "htt", r"\d+"):
        out = f"regexp_replace({out}, {O.q(pat)}, '', 'g')"
    out = f"regexp_replace({out}, {O.q(chr(92) + 's' + chr(92) + 's+')}, ' ', 'g')"
    out = f"regexp_replace({out}, {O.q(chr(92) + 'n')}, ' ', 'g')"
    return f"regexp_replace({out}, {O.q('^' + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g')"


@query("clean_for_topics", with_fixtures(f"SELECT post_id, {_topic_clean_sql('text')} AS clean FROM posts", "posts"))
def q_clean_for_topics(spark, sf):
    return _posts(spark, sf).select("post_id", T.clean_for_topics("text").alias("clean"))


@query("tokenise", with_fixtures(
    f"SELECT post_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token FROM "
    f"(SELECT post_id, string_split({_topic_clean_sql('text')}, ' ') AS t FROM posts) x", "posts"))
def q_tokenise(spark, sf):
    p = _posts(spark, sf)
    return p.select("post_id", F.posexplode(T.tokenise(T.clean_for_topics("text"))).alias("pos", "token")) \
            .select("post_id", F.col("pos").cast("long").alias("pos"), "token")


def _kept_sql(src: str = "posts", id_col: str = "post_id", text_col: str = "text", keys: str = "created_at") -> str:
    return (f"SELECT {id_col} AS post_id, {keys}, list_filter(string_split({_topic_clean_sql(text_col)}, ' '), "
            f"lambda x: NOT list_contains(sw, x)) AS kept FROM {src} CROSS JOIN (SELECT list(token) AS sw FROM stop_words) s")


@query("remove_stop_words", with_fixtures(
    "SELECT post_id, CAST(generate_subscripts(kept, 1) - 1 AS BIGINT) AS pos, unnest(kept) AS token FROM kept",
    "posts", "stop_words", extra=[("kept", _kept_sql())]))
def q_remove_stop_words(spark, sf):
    k = TP.kept_tokens(_posts(spark, sf))
    return k.select("post_id", F.posexplode("kept").alias("pos", "token")) \
            .select("post_id", F.col("pos").cast("long").alias("pos"), "token")


@query("bigrams", with_fixtures(
    "SELECT post_id, CAST(i - 1 AS BIGINT) AS pos, kept[i] || '_' || kept[i + 1] AS bigram FROM "
    "(SELECT post_id, kept, unnest(range(1, len(kept))) AS i FROM kept) x",
    "posts", "stop_words", extra=[("kept", _kept_sql())]))
def q_bigrams(spark, sf):
    k = TP.kept_tokens(_posts(spark, sf))
    return k.select("post_id", F.posexplode(T.within_post_bigrams("kept")).alias("pos", "bigram")) \
            .select("post_id", F.col("pos").cast("long").alias("pos"), "bigram")


@query("pseudonymise", net_sql("SELECT node, display, length(display) >= 56 AS is_hidden FROM hmap"))
def q_pseudonymise(spark, sf):
    p = _params()
    raw = G.mention_edges(network_posts(_posts(spark, sf), p))
    m = handle_map(raw, fx.verified_dictionary(spark, sf), p.given, p.hashing, p.hash_bits)
    return m.select("node", "display", PV.is_hidden(F.col("display")).alias("is_hidden"))


@query("age_days", with_fixtures(
    f"SELECT post_id, CAST(floor((epoch_us(TIMESTAMP '{O.AS_OF}') - epoch_us(created_at)) / 86400000000.0) AS BIGINT) "
    f"AS age_days FROM posts", "posts"))
def q_age_days(spark, sf):
    return _posts(spark, sf).select("post_id", T.age_days("created_at", O.AS_OF).cast("long").alias("age_days"))


@query("post_polarity", with_fixtures(
    f"SELECT post_id, round(polarity, 6) AS polarity, {O.trunc('polarity')} AS truncated, {O.label('polarity')} AS label "
    f"FROM s_sc", "posts", "lexicon", extra=[("corp", "SELECT post_id, lower(text) AS text FROM posts")]
    + O.sentiment_ctes("corp", dedup=False)))
def q_post_polarity(spark, sf):
    corp = _posts(spark, sf).select("post_id", F.lower("text").alias("text"))
    s = S.scored_corpus(corp, fx.lexicon(spark), remove_duplicates=False)
    return rounded(s.select("post_id", "polarity", T.truncate_score("polarity").alias("truncated"),
                            T.sentiment_label("polarity").alias("label")))


@query("abs_deviation", with_fixtures(
    "SELECT post_id, round(abs(polarity - m.mean), 6) AS deviation, "
    "round((polarity - m.mean) * (polarity - m.mean), 6) AS deviation_sq FROM s_sc CROSS JOIN s_mean m",
    "posts", "lexicon", extra=[("corp", "SELECT post_id, lower(text) AS text FROM posts")]
    + O.sentiment_ctes("corp", dedup=False)))
def q_abs_deviation(spark, sf):
    corp = _posts(spark, sf).select("post_id", F.lower("text").alias("text"))
    s = S.scored_corpus(corp, fx.lexicon(spark), remove_duplicates=False)
    mean = s.agg(T.truncate_score(F.avg("polarity")).alias("mean"))
    d = F.col("polarity") - F.col("mean")
    return rounded(s.crossJoin(F.broadcast(mean)).select("post_id", F.abs(d).alias("deviation"), (d * d).alias("deviation_sq")))


@query("capitalise", with_fixtures(
    "SELECT post_id, upper(substr(lower(author), 1, 1)) || lower(substr(lower(author), 2)) AS name FROM posts", "posts"))
def q_capitalise(spark, sf):
    return _posts(spark, sf).select("post_id", T.capitalise(F.lower("author")).alias("name"))


@query("dyad_key", net_sql("SELECT post_id, pos, sender || ';' || receiver AS dyad FROM edges"))
def q_dyad_key(spark, sf):
    r = _network_edges(spark, sf)
    return r.select("post_id", "pos", F.concat_ws(";", "sender", "receiver").alias("dyad"))


def _network_edges(spark, sf, **kw):
    p = _params(**kw)
    return network_edges(network_posts(_posts(spark, sf), p), fx.verified_dictionary(spark, sf), p)


# ================================================================== 2.4 filters

@query("topic_filter", with_fixtures("SELECT post_id FROM posts WHERE contains(lower(text), 'launch')", "posts"))
def q_topic_filter(spark, sf):
    return P.topic_filter(_posts(spark, sf), O.TOPIC).select("post_id")


@query("language_filter", with_fixtures("SELECT post_id FROM posts WHERE lang = 'en'", "posts"))
def q_language_filter(spark, sf):
    return P.language_filter(_posts(spark, sf)).select("post_id")


@query("exclude_retweets", with_fixtures("SELECT post_id FROM posts WHERE NOT contains(text, 'RT @')", "posts"))
def q_exclude_retweets(spark, sf):
    return P.exclude_retweets(_posts(spark, sf)).select("post_id")


@query("newer_than_oldest", with_fixtures(
    "SELECT post_id FROM posts WHERE lower(author) = 'user7' AND post_id > "
    "(SELECT min(post_id) FROM posts WHERE contains(lower(text), 'happy news') AND lang = 'en')", "posts"))
def q_newer_than_oldest(spark, sf):
    p = _posts(spark, sf)
    return P.newer_than_oldest(P.posts_by_account(p, "User7"), P.topic_posts(p, O.COMPONENT_TOPIC)).select("post_id")


@query("mention_corpus", with_fixtures(
    "SELECT post_id, lower(text) AS text FROM posts WHERE contains(lower(text), '@user7 ')", "posts"))
def q_mention_corpus(spark, sf):
    corp = _posts(spark, sf).select("post_id", F.lower("text").alias("text"))
    return S.mention_corpus(corp, O.GIVEN)


@query("account_and_topic", with_fixtures(
    "SELECT post_id FROM posts WHERE contains(lower(text), 'user1') AND contains(lower(text), 'promo')", "posts"))
def q_account_and_topic(spark, sf):
    low = F.lower("text")
    return _posts(spark, sf).filter(low.contains("user1") & low.contains("promo")).select("post_id")


@query("recent_posts", with_fixtures(
    f"SELECT post_id FROM posts WHERE floor((epoch_us(TIMESTAMP '{O.AS_OF}') - epoch_us(created_at)) / 86400000000.0) <= 7",
    "posts"))
def q_recent_posts(spark, sf):
    return P.recent_posts(_posts(spark, sf), 7, O.AS_OF).select("post_id")


@query("self_loop_policy", with_fixtures(
    f"SELECT post_id, CAST(generate_subscripts(ms, 1) - 1 AS BIGINT) AS pos, author AS sender, unnest(ms) AS receiver FROM "
    f"(SELECT post_id, author, CASE WHEN len(regexp_extract_all(text, {O.q(O.MENTION)}, 1)) = 0 THEN [author] "
    f"ELSE regexp_extract_all(text, {O.q(O.MENTION)}, 1) END AS ms FROM "
    f"(SELECT post_id, lower(author) AS author, lower(text) AS text FROM posts) p) x", "posts"))
def q_self_loop_policy(spark, sf):
    return G.mention_edges(_posts(spark, sf), selfloop=True)


@query("visible_accounts", net_sql("SELECT node FROM cent WHERE length(node) < 56", base=CENT))
def q_visible_accounts(spark, sf):
    res = _network(spark, sf)
    return res.centrality.filter(~PV.is_hidden(F.col("node"))).select("node")


@query("verified_status_filter", with_fixtures(
    "SELECT f.account_id, CASE WHEN a.account_id IS NULL THEN 'error' WHEN a.verified THEN 'valid' "
    "WHEN NOT a.verified THEN 'invalid' ELSE 'error' END AS status "
    "FROM (SELECT DISTINCT account_id FROM friend_ids) f LEFT JOIN accounts a ON f.account_id = a.account_id",
    "friend_ids", "accounts"))
def q_verified_status_filter(spark, sf):
    return A.hydrate(A.unique_ids(fx.friend_ids(spark, sf)), fx.accounts(spark, sf)).select("account_id", "status")


@query("account_in_network", net_sql("SELECT count(*) > 0 AS present FROM hnodes WHERE node = 'user7'"))
def q_account_in_network(spark, sf):
    e = G.mention_edges(network_posts(_posts(spark, sf), _params()))
    return G.node_list(e).agg(F.count_if(F.col("node") == O.GIVEN).alias("n")).select((F.col("n") > 0).alias("present"))


@query("no_posts_guard", with_fixtures(
    "SELECT count(*) AS n_posts, NULL::VARCHAR AS oldest_created_at, NULL::BIGINT AS oldest_age_days "
    "FROM posts WHERE contains(lower(text), 'no such topic')", "posts"))
def q_no_posts_guard(spark, sf):
    return rounded(P.corpus_window(P.topic_filter(_posts(spark, sf), "no such topic"), O.AS_OF))


@query("tail_sample", net_sql(
    f"SELECT node, round(CAST(('0x' || substr(md5('{O.SEED}' || node), 1, 8)) AS BIGINT) / 4294967296.0, 6) AS u FROM hmap"))
def q_tail_sample(spark, sf):
    p = _params()
    raw = G.mention_edges(network_posts(_posts(spark, sf), p))
    return rounded(G.node_list(raw).select("node", PV.uniform_hash(O.SEED, F.col("node")).alias("u")))


# ================================================================== 2.5 joins

def _settled_sql() -> list[tuple]:
    """The previous run: statuses of the ids it had listed."""
    return [
        ("prev_status", "SELECT f.account_id, a.screen_name, CASE WHEN a.account_id IS NULL THEN 'error' "
                        "WHEN a.verified THEN 'valid' WHEN NOT a.verified THEN 'invalid' ELSE 'error' END AS status "
                        "FROM (SELECT DISTINCT account_id FROM previous_friend_ids) f "
                        "LEFT JOIN accounts a ON f.account_id = a.account_id"),
        ("cur_ids", "SELECT DISTINCT account_id FROM friend_ids"),
    ]


def _previous_run(spark, sf) -> A.DictionaryRun:
    return A.run_dictionary(fx.previous_friend_ids(spark, sf), fx.accounts(spark, sf))


def _current_run(spark, sf) -> A.DictionaryRun:
    prev = _previous_run(spark, sf)
    return A.run_dictionary(fx.friend_ids(spark, sf), fx.accounts(spark, sf), prev.dictionary, prev.invalid, prev.error)


_ACC = ("friend_ids", "previous_friend_ids", "accounts")
_STORE_BUCKETS = 8      # of the stores that registered queries make for themselves


@query("skip_known_valid", with_fixtures(
    "SELECT account_id FROM cur_ids WHERE account_id NOT IN (SELECT account_id FROM prev_status WHERE status = 'valid')",
    *_ACC, extra=_settled_sql()))
def q_skip_known_valid(spark, sf):
    prev = _previous_run(spark, sf)
    empty = spark.createDataFrame([], "account_id long")
    return A.skip_settled(A.unique_ids(fx.friend_ids(spark, sf)), prev.dictionary, empty, empty)


@query("skip_known_invalid", with_fixtures(
    "SELECT account_id FROM cur_ids WHERE account_id NOT IN (SELECT account_id FROM prev_status WHERE status = 'invalid')",
    *_ACC, extra=_settled_sql()))
def q_skip_known_invalid(spark, sf):
    prev = _previous_run(spark, sf)
    empty = spark.createDataFrame([], "account_id long")
    return A.skip_settled(A.unique_ids(fx.friend_ids(spark, sf)), empty.selectExpr("CAST(account_id AS STRING) AS account_id"),
                          prev.invalid, empty)


@query("skip_known_error", with_fixtures(
    "SELECT account_id FROM cur_ids WHERE account_id NOT IN (SELECT account_id FROM prev_status WHERE status = 'error')",
    *_ACC, extra=_settled_sql()))
def q_skip_known_error(spark, sf):
    prev = _previous_run(spark, sf)
    empty = spark.createDataFrame([], "account_id long")
    return A.skip_settled(A.unique_ids(fx.friend_ids(spark, sf)), empty.selectExpr("CAST(account_id AS STRING) AS account_id"),
                          empty, prev.error)


@query("new_timeline_posts", with_fixtures(
    "SELECT post_id FROM posts WHERE lower(author) = 'user7' AND post_id NOT IN "
    "(SELECT post_id FROM posts WHERE contains(lower(text), 'launch') AND lang = 'en')", "posts"))
def q_new_timeline_posts(spark, sf):
    p = _posts(spark, sf)
    return P.new_posts(P.posts_by_account(p, "User7"), P.topic_posts(p, O.TOPIC)).select("post_id")


@query("flag_verified", net_sql("SELECT node, d.h IS NOT NULL AS verified FROM hnodes LEFT JOIN dict_names d ON node = d.h"))
def q_flag_verified(spark, sf):
    e = G.mention_edges(network_posts(_posts(spark, sf), _params()))
    return A.flag_verified(G.node_list(e), fx.verified_dictionary(spark, sf))


@query("centrality_table", net_sql(
    "SELECT node, round(degree, 6) AS degree, round(in_degree, 6) AS in_degree, round(out_degree, 6) AS out_degree, "
    "round(closeness, 6) AS closeness, round(betweenness, 6) AS betweenness, round(eigenvector, 6) AS eigenvector FROM cent",
    base=CENT))
def q_centrality_table(spark, sf):
    res = _network(spark, sf)
    return rounded(res.centrality.drop("score"))


@query("hydrate_accounts", with_fixtures(
    "SELECT f.account_id, CASE WHEN a.verified THEN a.screen_name END AS screen_name, "
    "CASE WHEN a.account_id IS NULL THEN 'error' WHEN a.verified THEN 'valid' WHEN NOT a.verified THEN 'invalid' "
    "ELSE 'error' END AS status FROM (SELECT DISTINCT account_id FROM friend_ids) f "
    "LEFT JOIN accounts a ON f.account_id = a.account_id", "friend_ids", "accounts"))
def q_hydrate_accounts(spark, sf):
    return A.hydrate(A.unique_ids(fx.friend_ids(spark, sf)), fx.accounts(spark, sf))


@query("protect_edges", net_sql("SELECT post_id, pos, sender, receiver FROM edges"))
def q_protect_edges(spark, sf):
    return _network_edges(spark, sf)


# ================================================================== 2.6 aggregations

@query("top_hashtags", with_fixtures(
    f"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(O.HASHTAG)}, 1)) AS tag FROM posts) t "
    f"GROUP BY tag", "posts"))
def q_top_hashtags(spark, sf):
    return TP.hashtag_counts(_posts(spark, sf))


@query("hashtag_substring_counts", with_fixtures(
    "SELECT t.tag, CAST(sum(u.n * (length(u.tag) - length(replace(u.tag, t.tag, ''))) / length(t.tag)) AS BIGINT) AS n "
    "FROM tags t JOIN tags u ON contains(u.tag, t.tag) GROUP BY t.tag", "posts",
    extra=[("tags", f"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(O.HASHTAG)}, 1)) "
                    f"AS tag FROM posts) t GROUP BY tag")]))
def q_hashtag_substring_counts(spark, sf):
    return TP.hashtag_counts(_posts(spark, sf), match="substring")


@query("edge_weights", net_sql(
    "SELECT e.post_id, e.pos, e.sender, e.receiver, w.weight FROM edges e JOIN "
    "(SELECT sender, receiver, count(*) AS weight FROM edges GROUP BY sender, receiver) w "
    "ON e.sender = w.sender AND e.receiver = w.receiver"))
def q_edge_weights(spark, sf):
    return G.edge_weights(_network_edges(spark, sf)).select("post_id", "pos", "sender", "receiver", "weight")


@query("node_list", net_sql("SELECT sender AS node FROM edges UNION SELECT receiver FROM edges"))
def q_node_list(spark, sf):
    return G.node_list(_network_edges(spark, sf))


_SIZE_SQL = O.size_sql()


@query("network_size", net_sql(f"SELECT nodes, edges, round(density_pct, 6) AS density_pct, self_loops FROM ({_SIZE_SQL}) s"))
def q_network_size(spark, sf):
    return rounded(G.network_size(_network_edges(spark, sf)))


@query("self_loops", net_sql("SELECT count(*) FILTER (WHERE sender = receiver) AS self_loops FROM edges"))
def q_self_loops(spark, sf):
    return G.network_size(_network_edges(spark, sf)).select("self_loops")


@query("transitivity", net_sql(
    "SELECT round(CASE WHEN coalesce(num, 0) = 0 THEN 0.0 ELSE CAST(num AS DOUBLE) / den END, 6) AS transitivity FROM "
    "(SELECT count(*) AS num FROM se a JOIN se b ON a.sender = b.sender AND a.receiver <> b.receiver "
    " JOIN se c ON c.sender = a.receiver AND c.receiver = b.receiver) x CROSS JOIN "
    "(SELECT sum(d * (d - 1)) AS den FROM (SELECT sender, count(*) AS d FROM se GROUP BY sender) y) z",
    extra=[("se", "SELECT DISTINCT sender, receiver FROM edges WHERE sender <> receiver")]))
def q_transitivity(spark, sf):
    return rounded(G.transitivity(_network_edges(spark, sf)))


def _sent_sql(body: str, corpus_sql: str, dedup: bool = True) -> str:
    return net_sql(body, extra=[("corp", corpus_sql)] + O.sentiment_ctes("corp", dedup=dedup), names=("lexicon",))


@query("mean_sentiment", _sent_sql("SELECT mean, n_posts FROM s_sum", "SELECT post_id, text FROM net_posts"))
def q_mean_sentiment(spark, sf):
    return S.sentiment_summary(_lower_posts(spark, sf), fx.lexicon(spark)).select("mean", "n_posts")


@query("sentiment_spread", _sent_sql("SELECT sd FROM s_sum", "SELECT post_id, text FROM net_posts"))
def q_sentiment_spread(spark, sf):
    return S.sentiment_summary(_lower_posts(spark, sf), fx.lexicon(spark)).select("sd")


@query("sentiment_summary", _sent_sql("SELECT mean, n_posts, example, sd, label FROM s_sum", "SELECT post_id, text FROM net_posts"))
def q_sentiment_summary(spark, sf):
    return S.sentiment_summary(_lower_posts(spark, sf), fx.lexicon(spark))


@query("mention_sentiment", _sent_sql("SELECT mean, n_posts, example, sd, label FROM s_sum",
                                      "SELECT post_id, text FROM net_posts WHERE contains(text, '@user7 ')"))
def q_mention_sentiment(spark, sf):
    c = S.mention_corpus(_lower_posts(spark, sf), O.GIVEN)
    return S.sentiment_summary(c, fx.lexicon(spark))


@query("distinct_posts", net_sql(
    f"SELECT min(post_id) AS post_id, m AS text FROM (SELECT post_id, regexp_replace(text, {O.q(O.URL)}, 'URL', 'g') AS m "
    f"FROM net_posts) x GROUP BY m"))
def q_distinct_posts(spark, sf):
    return S.distinct_posts(_lower_posts(spark, sf))


@query("duplicate_ids", with_fixtures(
    "SELECT account_id, count(*) AS n FROM friend_ids GROUP BY account_id HAVING count(*) > 1", "friend_ids"))
def q_duplicate_ids(spark, sf):
    return A.duplicate_ids(fx.friend_ids(spark, sf))


@query("duplicate_summary", with_fixtures(
    "SELECT count(*) AS listed, count(DISTINCT account_id) AS distinct_ids, count(*) - count(DISTINCT account_id) AS surplus "
    "FROM friend_ids", "friend_ids"))
def q_duplicate_summary(spark, sf):
    return A.duplicate_summary(fx.friend_ids(spark, sf))


_OUTCOME_SQL = (
    "SELECT CAST(count(*) FILTER (WHERE status = 'valid') AS BIGINT) AS valid, "
    "CAST(count(*) FILTER (WHERE status = 'invalid') AS BIGINT) AS invalid, "
    "CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error, "
    "(SELECT count(*) FROM cur_ids) AS distinct_ids FROM "
    "(SELECT account_id, status FROM prev_status UNION ALL "
    " SELECT c.account_id, CASE WHEN a.account_id IS NULL THEN 'error' WHEN a.verified THEN 'valid' "
    " WHEN NOT a.verified THEN 'invalid' ELSE 'error' END FROM cur_ids c LEFT JOIN accounts a ON c.account_id = a.account_id "
    " WHERE c.account_id NOT IN (SELECT account_id FROM prev_status)) s")


@query("outcome_counts", with_fixtures(f"SELECT valid, invalid, error FROM ({_OUTCOME_SQL}) o", *_ACC, extra=_settled_sql()))
def q_outcome_counts(spark, sf):
    run = _current_run(spark, sf)
    return A.outcome_counts(run, fx.friend_ids(spark, sf)).select("valid", "invalid", "error")


@query("reconcile_outcomes", with_fixtures(
    f"SELECT distinct_ids, valid + invalid + error = distinct_ids AS reconciled FROM ({_OUTCOME_SQL}) o",
    *_ACC, extra=_settled_sql()))
def q_reconcile_outcomes(spark, sf):
    run = _current_run(spark, sf)
    return A.outcome_counts(run, fx.friend_ids(spark, sf)).select("distinct_ids", "reconciled")


@query("corpus_window", with_fixtures(
    f"SELECT count(*) AS n_posts, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest_created_at, "
    f"CAST(floor((epoch_us(TIMESTAMP '{O.AS_OF}') - epoch_us(min(created_at))) / 86400000000.0) AS BIGINT) AS oldest_age_days "
    f"FROM posts WHERE lower(author) = 'user7'", "posts"))
def q_corpus_window(spark, sf):
    return P.corpus_window(P.posts_by_account(_posts(spark, sf), "User7"), O.AS_OF)


@query("oldest_post_id", with_fixtures(
    "SELECT min(post_id) AS oldest_post_id FROM posts WHERE contains(lower(text), 'launch') AND lang = 'en'", "posts"))
def q_oldest_post_id(spark, sf):
    return P.oldest_post_id(P.topic_posts(_posts(spark, sf), O.TOPIC))


# ================================================================== 2.7 graph operators

@query("mention_edges", with_fixtures(
    f"SELECT post_id, CAST(generate_subscripts(ms, 1) - 1 AS BIGINT) AS pos, author AS sender, unnest(ms) AS receiver FROM "
    f"(SELECT post_id, lower(author) AS author, regexp_extract_all(lower(text), {O.q(O.MENTION)}, 1) AS ms FROM posts) x",
    "posts"))
def q_mention_edges(spark, sf):
    return G.mention_edges(_posts(spark, sf))


@query("build_graph", net_sql("SELECT DISTINCT sender, receiver FROM edges"))
def q_build_graph(spark, sf):
    return G.build_graph(_network_edges(spark, sf), multi=False)


def _degree_only(spark, sf):
    e = _network_edges(spark, sf)
    nodes = G.node_list(e)
    return C.degree_centrality(e, nodes, nodes.count())


@query("degree_centrality", net_sql("SELECT node, round(degree, 6) AS degree FROM deg_c",
                                    base=NET + [("graph", "SELECT sender, receiver FROM edges")] + O.centrality_ctes()[:4]))
def q_degree_centrality(spark, sf):
    return rounded(_degree_only(spark, sf).select("node", "degree"))


@query("in_degree_centrality", net_sql("SELECT node, round(in_degree, 6) AS in_degree FROM deg_c",
                                       base=NET + [("graph", "SELECT sender, receiver FROM edges")] + O.centrality_ctes()[:4]))
def q_in_degree_centrality(spark, sf):
    return rounded(_degree_only(spark, sf).select("node", "in_degree"))


@query("out_degree_centrality", net_sql("SELECT node, round(out_degree, 6) AS out_degree FROM deg_c",
                                        base=NET + [("graph", "SELECT sender, receiver FROM edges")] + O.centrality_ctes()[:4]))
def q_out_degree_centrality(spark, sf):
    return rounded(_degree_only(spark, sf).select("node", "out_degree"))


def _paths(spark, sf, **wanted):
    e = cut_lineage(_network_edges(spark, sf))    # read by every step
    nodes = G.node_list(e)
    return C.path_centralities(e, nodes, nodes.count(), **wanted)


@query("closeness_centrality", net_sql("SELECT node, round(closeness, 6) AS closeness FROM close_c", base=CENT))
def q_closeness_centrality(spark, sf):
    return rounded(_paths(spark, sf, want_betweenness=False).closeness)


@query("betweenness_centrality", net_sql("SELECT node, round(betweenness, 6) AS betweenness FROM betw_c", base=CENT))
def q_betweenness_centrality(spark, sf):
    return rounded(_paths(spark, sf, want_closeness=False).betweenness)


@query("bfs_depth_check", net_sql("SELECT deepest_rows FROM bfs_check", base=CENT))
def q_bfs_depth_check(spark, sf):
    """Accounts that some other account reaches in 12 steps or more: the oracle unrolls so many levels."""
    e = cut_lineage(_network_edges(spark, sf))
    ids, edges = C._prepared(e, G.node_list(e), None)
    adj = C._adjacency(edges)
    reach = C.arrivals(adj, ids.count(), C.state_budget_of(spark))
    return reach.agg(F.count_if(F.col("far") >= O.BFS_DEPTH).alias("deepest_rows"))


@query("eigenvector_centrality", net_sql("SELECT node, round(eigenvector, 6) AS eigenvector FROM eig_c", base=CENT))
def q_eigenvector_centrality(spark, sf):
    e = cut_lineage(_network_edges(spark, sf))    # read by the node list, the ids and the arcs
    nodes = G.node_list(e)
    return rounded(C.eigenvector_centrality(e, nodes, nodes.count()).scores)


@query("to_undirected", net_sql("SELECT DISTINCT least(sender, receiver) AS a, greatest(sender, receiver) AS b FROM edges"))
def q_to_undirected(spark, sf):
    return G.to_undirected(_network_edges(spark, sf))


def _comp_ctes(graph: str = "edges") -> list[tuple]:
    return [
        ("und", f"SELECT sender AS a, receiver AS b FROM {graph} UNION SELECT receiver, sender FROM {graph}"),
        ("cnodes", f"SELECT sender AS node FROM {graph} UNION SELECT receiver FROM {graph}"),
        ("reach_c", "SELECT * FROM (WITH RECURSIVE r(node, lbl) AS (SELECT node, node FROM cnodes UNION "
                    "SELECT und.b, r.lbl FROM r JOIN und ON r.node = und.a) SELECT node, min(lbl) AS component FROM r GROUP BY node) z"),
    ]


_COMP_NET = O.network_ctes(topic=O.COMPONENT_TOPIC)


@query("connected_components", net_sql("SELECT node, component FROM reach_c", base=_COMP_NET, extra=_comp_ctes()))
def q_connected_components(spark, sf):
    return CC.connected_components(_network_edges(spark, sf, query=O.COMPONENT_TOPIC))


@query("largest_component", net_sql(
    "SELECT component, count(*) AS size FROM reach_c GROUP BY component ORDER BY size DESC, component LIMIT 1",
    base=_COMP_NET, extra=_comp_ctes()))
def q_largest_component(spark, sf):
    return CC.largest_component(CC.connected_components(_network_edges(spark, sf, query=O.COMPONENT_TOPIC)))


@query("centrality", net_sql(
    "SELECT node, round(degree, 6) AS degree, round(in_degree, 6) AS in_degree, round(out_degree, 6) AS out_degree, "
    "round(closeness, 6) AS closeness, round(betweenness, 6) AS betweenness, round(eigenvector, 6) AS eigenvector, "
    "round(score, 6) AS score FROM cent", base=CENT))
def q_centrality(spark, sf):
    return rounded(_network(spark, sf).centrality)


_PREV_NET = [("prev_posts", f"SELECT * FROM posts WHERE created_at < TIMESTAMP '{fx.RUN_CUTOFF}'")] + O.network_ctes(prefix="p_", src="prev_posts")


@query("network_summary", net_sql(
    f"SELECT s.nodes, s.edges, round(s.density_pct, 6) AS density_pct, s.self_loops, NULL::DOUBLE AS transitivity, "
    f"true AS allow_retweets, true AS repeated_contact, true AS remove_duplicates, false AS self_loops_allowed, "
    f"false AS user_activity, p.nodes AS previous_nodes, s.nodes - p.nodes AS delta_nodes, p.edges AS previous_edges, "
    f"s.edges - p.edges AS delta_edges, round(p.density_pct, 6) AS previous_density_pct, "
    f"round(s.density_pct - p.density_pct, 6) AS delta_density_pct FROM ({_SIZE_SQL}) s CROSS JOIN ({O.size_sql('p_edges')}) p",
    extra=_PREV_NET))
def q_network_summary(spark, sf):
    """G13 next to the network of the run before."""
    from murmuration.plans.network import NETWORK_METRICS, network_summary
    p = _params()
    now = network_summary(G.build_graph(_network_edges(spark, sf), True), p)
    earlier = network_posts(_earlier(_posts(spark, sf)), p)
    edges = network_edges(earlier, fx.verified_dictionary(spark, sf), p)
    return rounded(H.with_previous(now, G.network_size(edges), NETWORK_METRICS))


def _lcc_ctes() -> list[tuple]:
    return _comp_ctes() + [
        ("lcc", "SELECT component FROM reach_c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1"),
        ("keep", "SELECT node FROM reach_c WHERE component IN (SELECT component FROM lcc) "
                 f"UNION SELECT node FROM cnodes WHERE node = {O.q(O.GIVEN)}"),
        ("kept_edges", "SELECT * FROM edges WHERE sender IN (SELECT node FROM keep) AND receiver IN (SELECT node FROM keep)"),
        ("ids", "SELECT node, CAST(row_number() OVER (ORDER BY node = " + O.q(O.GIVEN) + ", node) - 1 AS BIGINT) AS id FROM "
                "(SELECT sender AS node FROM kept_edges UNION SELECT receiver FROM kept_edges) n"),
    ]


@query("largest_component_edges", net_sql("SELECT post_id, pos, sender, receiver FROM kept_edges",
                                          base=_COMP_NET, extra=_lcc_ctes()))
def q_largest_component_edges(spark, sf):
    return X.largest_component_edges(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)


@query("export_nodes", net_sql(
    "SELECT id, CASE WHEN length(node) >= 56 THEN ' ' ELSE node END AS name, "
    f"CAST(CASE WHEN length(node) >= 56 THEN 2 WHEN node = {O.q(O.GIVEN)} THEN 3 ELSE 1 END AS BIGINT) AS \"group\", "
    "CAST(10 AS BIGINT) AS size FROM ids", base=_COMP_NET, extra=_lcc_ctes()))
def q_export_nodes(spark, sf):
    return X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)[0]


@query("export_links", net_sql(
    "SELECT s.id AS source, t.id AS target, w.value FROM kept_edges e "
    "JOIN (SELECT sender, receiver, count(*) AS value FROM kept_edges GROUP BY sender, receiver) w "
    "ON e.sender = w.sender AND e.receiver = w.receiver JOIN ids s ON e.sender = s.node JOIN ids t ON e.receiver = t.node",
    base=_COMP_NET, extra=_lcc_ctes()))
def q_export_links(spark, sf):
    return X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)[1]


@query("node_style", net_sql(
    f"SELECT node, CASE WHEN node = {O.q(O.GIVEN)} THEN '#FF0000' ELSE '#23b7ce' END AS colour, "
    f"CAST(CASE WHEN node = {O.q(O.GIVEN)} THEN 250 ELSE 35 END AS BIGINT) AS draw_size, substr(node, 1, 15) AS label "
    f"FROM (SELECT sender AS node FROM edges UNION SELECT receiver FROM edges) n"))
def q_node_style(spark, sf):
    return X.node_style(G.node_list(_network_edges(spark, sf)), O.GIVEN)


# ================================================================== 2.8 windows, 2.9 sorts

@query("percentile_rank", net_sql("SELECT node, round(score, 6) AS score, round(pct, 6) AS pct FROM pct", base=RANK))
def q_percentile_rank(spark, sf):
    res = _network(spark, sf)
    return rounded(R.percentile_rank(res.centrality, "score", "pct").select("node", "score", "pct"))


@query("account_position", net_sql(f"SELECT node, CAST(rn - 1 AS BIGINT) AS position FROM rk WHERE node = {O.q(O.GIVEN)}",
                                   base=RANK))
def q_account_position(spark, sf):
    return R.account_position(_network(spark, sf).centrality, O.GIVEN)


@query("influence_report", net_sql(
    "SELECT section, node, round(pct, 6) AS pct, round(score, 6) AS score FROM "
    "(SELECT * FROM top_block UNION ALL SELECT * FROM given_row UNION ALL SELECT * FROM tail_block) r", base=RANK))
def q_influence_report(spark, sf):
    return rounded(_network(spark, sf).report().select("section", "node", "pct", "score"))


@query("sequential_ids", net_sql(
    f"SELECT node, CAST(row_number() OVER (ORDER BY node = {O.q(O.GIVEN)}, node) - 1 AS BIGINT) AS id FROM "
    f"(SELECT sender AS node FROM edges UNION SELECT receiver FROM edges) n"))
def q_sequential_ids(spark, sf):
    return R.sequential_ids(G.node_list(_network_edges(spark, sf)), O.GIVEN)


@query("rank_accounts", net_sql("SELECT node, CAST(rn - 1 AS BIGINT) AS position FROM rk", base=RANK))
def q_rank_accounts(spark, sf):
    from murmuration.operators.ordering import row_number0
    return row_number0(_network(spark, sf).centrality.select("node", *R.RANK_ORDER), R.rank_order(), "position").select("node", "position")


@query("top_k_hashtags", with_fixtures(
    f"SELECT CAST(row_number() OVER (ORDER BY n DESC, tag) AS BIGINT) AS rank, tag, n, "
    f"CAST(row_number() OVER (ORDER BY n DESC, tag) AS VARCHAR) || '. #' || tag || ' used ' || CAST(n AS VARCHAR) || "
    f"CASE WHEN n = 1 THEN ' time.' ELSE ' times.' END AS message FROM "
    f"(SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(O.HASHTAG)}, 1)) AS tag FROM posts "
    f"WHERE lang = 'en' AND list_contains(regexp_extract_all(lower(text), {O.q(O.MENTION)}, 1), 'user7')) t "
    f"GROUP BY tag ORDER BY n DESC, tag LIMIT 10) x", "posts"))
def q_top_k_hashtags(spark, sf):
    corpus = P.posts_at_account(_posts(spark, sf), "@User7")
    return TP.top_hashtags(TP.hashtag_counts(corpus), 10)


@query("top_visible", net_sql("SELECT node, round(pct, 6) AS pct, round(score, 6) AS score FROM vis WHERE vrn <= 10",
                              base=RANK))
def q_top_visible(spark, sf):
    res = _network(spark, sf)
    ranked = R.percentile_rank(res.centrality, "score", "pct")
    vis = ranked.filter(~PV.is_hidden(F.col("node")) & (F.col("node") != O.GIVEN))
    return rounded(vis.orderBy(*R.rank_order()).limit(10).select("node", "pct", "score"))


@query("typical_post", _sent_sql("SELECT example FROM s_sum", "SELECT post_id, text FROM net_posts"))
def q_typical_post(spark, sf):
    return S.sentiment_summary(_lower_posts(spark, sf), fx.lexicon(spark)).select("example")


@query("cap_results", with_fixtures(
    "SELECT post_id FROM posts WHERE contains(lower(text), 'launch') AND lang = 'en' "
    "ORDER BY created_at DESC, post_id DESC LIMIT 700", "posts"))
def q_cap_results(spark, sf):
    return P.topic_posts(_posts(spark, sf), O.TOPIC, max_posts=700).select("post_id")


# ================================================================== 2.10 set operations

@query("enrich_with_timeline", with_fixtures(
    "SELECT post_id FROM s UNION SELECT post_id FROM posts WHERE (lower(author) = 'user7' OR "
    "(lang = 'en' AND contains(lower(text), 'user7') AND contains(lower(text), 'launch'))) "
    "AND post_id > (SELECT min(post_id) FROM s) AND post_id NOT IN (SELECT post_id FROM s) AND contains(lower(text), 'launch')",
    "posts", extra=[("s", "SELECT post_id FROM posts WHERE contains(lower(text), 'launch') AND lang = 'en'")]))
def q_enrich_with_timeline(spark, sf):
    return P.enrich_with_timeline(_posts(spark, sf), O.TOPIC, "User7", include_mentions=True).select("post_id")


@query("all_handles", net_sql("SELECT sender AS node FROM raw_edges UNION SELECT receiver FROM raw_edges"))
def q_all_handles(spark, sf):
    return G.node_list(G.mention_edges(network_posts(_posts(spark, sf), _params())))


@query("unique_ids", with_fixtures("SELECT DISTINCT account_id FROM friend_ids", "friend_ids"))
def q_unique_ids(spark, sf):
    return A.unique_ids(fx.friend_ids(spark, sf))


@query("flatten", with_fixtures(
    f"SELECT unnest(regexp_extract_all(lower(text), {O.q(O.HASHTAG)}, 1)) AS tag FROM posts", "posts"))
def q_flatten(spark, sf):
    return _posts(spark, sf).select(F.explode(T.extract_hashtags(F.lower("text"))).alias("tag"))


# ================================================================== topics over posts and documents

FEATURE_SQL = r"[\p{L}0-9_]+|\$[0-9.]+|\S+"


def _items_ctes(src: str, id_col: str, text_col: str, order_sql: str, keys: str) -> list[tuple]:
    """kept, items (item, kind): words, in-post bigrams, cross-post bigrams."""
    return [
        ("kept", _kept_sql(src, id_col, text_col, keys)),
        ("items", "SELECT unnest(kept) AS item, 'word' AS kind FROM kept UNION ALL "
                  "SELECT kept[i] || '_' || kept[i + 1], 'bigram' FROM (SELECT kept, unnest(range(1, len(kept))) AS i FROM kept) b "
                  "UNION ALL SELECT last_tok || '_' || next_first, 'bigram' FROM "
                  f"(SELECT kept[len(kept)] AS last_tok, lead(kept[1]) OVER (ORDER BY {order_sql}) AS next_first "
                  "FROM kept WHERE len(kept) > 0) c WHERE next_first IS NOT NULL"),
        ("feats", f"SELECT feature, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(item, {O.q(FEATURE_SQL)}, 0))) "
                  "AS feature FROM items) f GROUP BY feature"),
        ("freq", "SELECT feature, df FROM feats CROSS JOIN (SELECT count(*) AS n_docs FROM items) n "
                 "WHERE df >= 10 AND df <= 0.9 * n_docs"),
    ]


_POST_ITEMS = _items_ctes("posts", "post_id", "text", "created_at DESC, post_id DESC", "created_at")
_AT_SRC = ("SELECT * FROM posts WHERE lang = 'en' AND list_contains(regexp_extract_all(lower(text), "
           f"{O.q(O.MENTION)}, 1), 'user7')")
_AT_ITEMS = [("at_posts", _AT_SRC)] + _items_ctes("at_posts", "post_id", "text", "created_at DESC, post_id DESC", "created_at")
_DOC_ITEMS = _items_ctes("documents", "doc_id", "text", "post_id", "doc_id AS d_key")
_POST_ORDER = [("created_at", True), ("post_id", True)]


def _post_items(spark, sf):
    return TP.topic_items(_posts(spark, sf), _POST_ORDER)


def _documents(spark, sf, doc_id=None):
    from murmuration.sources.tables import read_table
    return TP.spread(read_table(spark, sf, "documents").select("doc_id", "text"), doc_id)


def _doc_items(spark, sf):
    return TP.topic_items(_documents(spark, sf), [("doc_id", False)])


@query("words_and_bigrams", with_fixtures("SELECT item, kind, count(*) AS n FROM items GROUP BY item, kind",
                                          "posts", "stop_words", extra=_POST_ITEMS))
def q_words_and_bigrams(spark, sf):
    return _post_items(spark, sf).groupBy("item", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("token_frequency", with_fixtures("SELECT feature, df FROM feats", "posts", "stop_words", extra=_POST_ITEMS))
def q_token_frequency(spark, sf):
    return TP.token_frequency(_post_items(spark, sf))


@query("doc_frequency_filter", with_fixtures("SELECT feature, df FROM freq", "posts", "stop_words", extra=_POST_ITEMS))
def q_doc_frequency_filter(spark, sf):
    return TP.frequent_features(_post_items(spark, sf))


@query("suggested_topics", with_fixtures(
    "SELECT CAST(row_number() OVER (ORDER BY feature) AS BIGINT) AS rank, feature, df, "
    "upper(substr(feature, 1, 1)) || lower(substr(feature, 2)) AS topic FROM (SELECT * FROM freq ORDER BY feature LIMIT 10) x",
    "posts", "stop_words", extra=_AT_ITEMS))
def q_suggested_topics(spark, sf):
    corpus = P.posts_at_account(_posts(spark, sf), "@User7")
    return TP.suggested_topics(TP.frequent_features(TP.topic_items(corpus, _POST_ORDER)))


@query("document_token_frequency", with_fixtures("SELECT feature, df FROM feats", "stop_words", extra=_DOC_ITEMS))
def q_document_token_frequency(spark, sf):
    return TP.token_frequency(_doc_items(spark, sf))


@query("document_topics", with_fixtures(
    "SELECT CAST(row_number() OVER (ORDER BY df DESC, feature) AS BIGINT) AS rank, feature, df, "
    "upper(substr(feature, 1, 1)) || lower(substr(feature, 2)) AS topic FROM (SELECT * FROM freq ORDER BY df DESC, feature LIMIT 10) x",
    "stop_words", extra=_DOC_ITEMS))
def q_document_topics(spark, sf):
    return TP.suggested_topics(TP.frequent_features(_doc_items(spark, sf)), order="frequency")


def _lda_ctes(k: int = 3, steps: int = 10, inner: int = 2) -> list[tuple]:
    """The steps of M1 unrolled: pairs (doc, word, n), w0 .. w{steps} (word, l0 ..)."""
    ts = range(k)

    def cols(pattern: str) -> str:
        return ", ".join(pattern.format(t=t) for t in ts)

    out = [
        ("kept", _kept_sql("documents", "doc_id", "text", "doc_id AS d_key")),
        ("counted", "SELECT post_id AS doc, word, CAST(count(*) AS DOUBLE) AS n FROM (SELECT post_id, unnest(kept) AS word FROM kept) u "
                    "WHERE word <> '' GROUP BY ALL", True),
        ("vocabulary", "SELECT word FROM counted GROUP BY word HAVING count(*) >= 10 AND "
                       "count(*) <= 0.9 * (SELECT count(DISTINCT doc) FROM counted)"),
        ("pairs", "SELECT * FROM counted WHERE word IN (SELECT word FROM vocabulary)", True),
        ("w0", "SELECT word, " + cols("1.0::DOUBLE + CAST(('0x' || substr(md5(word || '#{t}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS l{t}")
               + " FROM (SELECT DISTINCT word FROM pairs) v", True),
    ]
    for step in range(1, steps + 1):
        out.append((f"b_{step}", "SELECT word, " + ", ".join(f"exp({TP.digamma(f'l{t}')} - {TP.digamma(f's{t}')}) AS b{t}" for t in ts)
                    + f" FROM w{step - 1} CROSS JOIN (SELECT " + cols("sum(l{t}) AS s{t}") + f" FROM w{step - 1}) s", True))
        src, share = f"SELECT doc, word, n, {cols('b{t}')}, {cols('b{t} AS e{t}')} FROM pairs JOIN b_{step} USING (word)", None
        for i in range(inner):
            out.append((f"e_{step}_{i}", src, True))
            total = " + ".join(f"e{t}" for t in ts)
            out.append((f"g_{step}_{i}", "SELECT doc, " + cols(f"{1.0 / k!r} + sum(n * e{{t}} / ({total})) AS g{{t}}") + f" FROM e_{step}_{i} GROUP BY doc", True))
            src = (f"SELECT doc, word, n, {cols('b{t}')}, " + ", ".join(f"exp({TP.digamma(f'g{t}')}) * b{t} AS e{t}" for t in ts)
                   + f" FROM e_{step}_{i} JOIN g_{step}_{i} USING (doc)")
        total = " + ".join(f"e{t}" for t in ts)
        out.append((f"w{step}", "SELECT word, " + cols(f"{1.0 / k!r} + sum(n * e{{t}} / ({total})) AS l{{t}}") + f" FROM ({src}) f GROUP BY word", True))
    return out


@query("lda_topics", with_fixtures(" UNION ALL ".join(
    f"SELECT * FROM (SELECT CAST({t} AS BIGINT) AS topic, CAST(row_number() OVER (ORDER BY weight DESC, word) - 1 AS BIGINT) AS rank, word, weight "
    f"FROM (SELECT word, round(l{t} / (SELECT sum(l{t}) FROM w10), 6) AS weight FROM w10) x) y WHERE rank < 5" for t in range(3)),
    "stop_words", extra=_lda_ctes()))
def q_lda_topics(spark, sf):
    """M1 over all documents of every language: 3 topics x 5 words after ten full steps."""
    return TP.lda_topics(_documents(spark, sf, "doc_id"), "doc_id")


# ================================================================== history, stored state

from murmuration.operators import history as H  # noqa: E402
from murmuration.sources import readers as RD  # noqa: E402
from murmuration.sources import sinks as SK  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location for stored state."""
    import uuid
    from murmuration.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/state-{name}-{uuid.uuid4().hex}"


HISTORY_METRICS = ("nodes", "edges", "density_pct", "percentile", "sentiment_all", "sentiment_user")


def _run(spark, sf, posts_df: DataFrame, **kw):
    return analyse_network(posts_df, fx.verified_dictionary(spark, sf), _params(betweenness=False, **kw))


def _earlier(posts_df: DataFrame) -> DataFrame:
    return posts_df.filter(F.col("created_at") < F.lit(fx.RUN_CUTOFF).cast("timestamp"))


def _runs(spark, sf):
    posts, lex = _posts(spark, sf), fx.lexicon(spark)
    return (_run(spark, sf, _earlier(posts)).metrics(lex, fx.RUN_CUTOFF), _run(spark, sf, posts).metrics(lex, fx.AS_OF))


def _runs_sql(src: str = "posts") -> list[tuple]:
    out = [("prev_posts", f"SELECT * FROM {src} WHERE created_at < TIMESTAMP '{fx.RUN_CUTOFF}'")]
    for r, ts, of in (("p", fx.RUN_CUTOFF, "prev_posts"), ("c", O.AS_OF, src)):
        out += O.network_ctes(prefix=f"{r}_", src=of)
        out += O.sentiment_ctes(f"{r}_net_posts", prefix=f"{r}a")
        out += [(f"{r}_ment", f"SELECT post_id, text FROM {r}_net_posts WHERE contains(text, '@user7 ')")]
        out += O.sentiment_ctes(f"{r}_ment", prefix=f"{r}u") + O.score_ctes(f"{r}_", f"{r}_edges")
        out.append((f"{r}_row", f"SELECT 'user7' AS given_user, 'launch' AS query, TIMESTAMP '{ts}' AS run_ts, nodes, edges, "
                                f"density_pct, (SELECT max(pct) FROM {r}_score_t WHERE node = {O.q(O.GIVEN)}) AS percentile, "
                                f"(SELECT mean FROM {r}a_sum) AS sentiment_all, (SELECT mean FROM {r}u_sum) AS sentiment_user "
                                f"FROM ({O.size_sql(r + '_edges')}) s", True))
    return out


def _hist_sql(body: str, src: str = "posts", extra=lambda: []) -> str:
    api = [("api_posts", "SELECT id AS post_id, screen_name AS author, created_at, contains(full_text, 'RT @') AS is_retweet, lang, "
                         "CASE WHEN contains(full_text, 'RT @') THEN coalesce('RT @' || first_mention || ': ' || rt_full_text, full_text) "
                         "ELSE full_text END AS text FROM raw_posts")] if src == "api_posts" else []
    return with_fixtures(body, "posts", "raw_posts", "verified_dictionary", "lexicon", extra=api + _runs_sql(src) + extra())


_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query("compare_last_run", _hist_sql(
    f"SELECT c.given_user, c.query, {_TS.format(c='c.run_ts')} AS run_ts, {_TS.format(c='p.run_ts')} AS previous_run_ts, "
    + ", ".join(f"round(c.{m}, 6) AS {m}, round(p.{m}, 6) AS previous_{m}, round(c.{m} - p.{m}, 6) AS delta_{m}"
                for m in HISTORY_METRICS)
    + " FROM c_row c LEFT JOIN p_row p ON c.given_user = p.given_user AND c.query = p.query AND p.run_ts < c.run_ts"))
def q_compare_last_run(spark, sf):
    prev, cur = _runs(spark, sf)
    out = H.compare_last_run(cur, prev)
    return rounded(out.withColumn("run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss"))
                      .withColumn("previous_run_ts", F.date_format("previous_run_ts", "yyyy-MM-dd HH:mm:ss")))


@query("previous_value", _hist_sql(
    f"SELECT given_user, query, {_TS.format(c='run_ts')} AS run_ts, nodes, "
    f"lag(nodes) OVER (PARTITION BY given_user, query ORDER BY run_ts) AS previous_nodes, round(percentile, 6) AS percentile, "
    f"round(lag(percentile) OVER (PARTITION BY given_user, query ORDER BY run_ts), 6) AS previous_percentile "
    f"FROM (SELECT * FROM p_row UNION ALL SELECT * FROM c_row) h"))
def q_previous_value(spark, sf):
    prev, cur = _runs(spark, sf)
    return rounded(H.previous_value(prev.unionByName(cur), "nodes", "percentile").withColumn(
        "run_ts", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss")))


@query("read_run_history", _hist_sql(
    f"SELECT given_user, query, {_TS.format(c='run_ts')} AS run_ts, nodes, edges, round(density_pct, 6) AS density_pct, "
    f"round(percentile, 6) AS percentile FROM c_row"))
def q_read_run_history(spark, sf):
    """S8 + K6: both runs appended to a history table, read back, newest per key."""
    prev, cur = _runs(spark, sf)
    path = _scratch(spark, "history")
    empty = RD.read_run_history(spark, path)          # first run: no table yet
    SK.append_run_history(prev.unionByName(empty), path)
    SK.append_run_history(cur, path)
    hist = H.latest_runs(RD.read_run_history(spark, path))
    return rounded(hist.select("given_user", "query", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts"),
                               "nodes", "edges", "density_pct", "percentile"))


@query("influence_run", _hist_sql(
    "SELECT section, node AS item, round(pct, 6) AS value, CAST(NULL AS DOUBLE) AS previous, CAST(NULL AS DOUBLE) AS delta FROM "
    "(SELECT * FROM top_block UNION ALL SELECT * FROM given_row UNION ALL SELECT * FROM tail_block) r "
    + "".join(f"UNION ALL SELECT 'comparison', '{m}', round(CAST(c.{m} AS DOUBLE), 6), round(CAST(p.{m} AS DOUBLE), 6), "
              f"round(CAST(c.{m} - p.{m} AS DOUBLE), 6) FROM c_row c CROSS JOIN p_row p " for m in HISTORY_METRICS)
    + "".join(f"UNION ALL SELECT 'network', '{m}', round(CAST(c.{m} AS DOUBLE), 6), round(CAST(p.{m} AS DOUBLE), 6), "
              f"round(CAST(c.{m} - p.{m} AS DOUBLE), 6) FROM c_row c CROSS JOIN p_row p " for m in ("nodes", "edges", "density_pct"))
    + "UNION ALL SELECT 'export', 'nodes', CAST((SELECT count(*) FROM ids) AS DOUBLE), NULL, NULL "
      "UNION ALL SELECT 'export', 'links', CAST((SELECT count(*) FROM kept_edges) AS DOUBLE), NULL, NULL",
    src="api_posts", extra=lambda: [("edges", "SELECT * FROM c_edges", True),
                                    ("cent", "SELECT d.node, degree, in_degree, out_degree, closeness, CAST(printf('%.9e', eigenvector) "
                                             "AS DOUBLE) AS eigenvector, score FROM c_deg_c d JOIN c_close_c c ON d.node = c.node "
                                             "JOIN c_eig_c e ON d.node = e.node JOIN c_summed s ON d.node = s.node", True)]
    + O.ranking_ctes() + _lcc_ctes()))
def q_influence_run(spark, sf):
    """Entry 1 end to end on API-shaped posts: two runs, the second compared with the stored first, both exported."""
    from murmuration.plans.network import run_and_store
    raw, lex, folder = fx.raw_posts(spark, sf), fx.lexicon(spark), _scratch(spark, "influence-run")
    run_and_store(_run(spark, sf, _earlier(raw)), lex, fx.RUN_CUTOFF, folder)
    rep = run_and_store(_run(spark, sf, raw), lex, fx.AS_OF, folder)
    none = F.lit(None).cast("double")

    def unpivot(df: DataFrame, section: str, cols) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("item"), F.col(c).cast("double").alias("value"), F.col(f"previous_{c}").cast("double").alias("previous"),
            F.col(f"delta_{c}").cast("double").alias("delta")) for c in cols])).alias("r")).select(F.lit(section).alias("section"), "r.*")

    out = rep.accounts.select("section", F.col("node").alias("item"), F.col("pct").alias("value"), none.alias("previous"), none.alias("delta"))
    out = out.unionByName(unpivot(rep.comparison, "comparison", HISTORY_METRICS))
    out = out.unionByName(unpivot(rep.network, "network", ("nodes", "edges", "density_pct")))
    for table in ("nodes", "links"):
        n = spark.read.option("header", True).csv(f"{folder}/{table}").agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(n.select(F.lit("export").alias("section"), F.lit(table).alias("item"), "value", none.alias("previous"), none.alias("delta")))
    return rounded(out)


@query("read_verified_dictionary_object", with_fixtures("SELECT account_id, screen_name FROM verified_dictionary", "accounts",
                                                        "verified_dictionary"))
def q_read_verified_dictionary_object(spark, sf):
    """K1 + S6: the dictionary written as one {id: handle} object over many part files and read back."""
    path = _scratch(spark, "dictionary-object")
    SK.write_verified_dictionary(fx.verified_dictionary(spark, sf), path, fmt="object")
    return RD.read_verified_dictionary(spark, path, fmt="object")


@query("read_verified_dictionary", with_fixtures("SELECT account_id, screen_name FROM verified_dictionary", "accounts",
                                                 "verified_dictionary"))
def q_read_verified_dictionary(spark, sf):
    """K1 + S6: the dictionary written as JSON lines and read back."""
    path = _scratch(spark, "dictionary")
    SK.write_verified_dictionary(fx.verified_dictionary(spark, sf), path)
    return RD.read_verified_dictionary(spark, path)


@query("read_id_list", with_fixtures("SELECT account_id FROM prev_status WHERE status <> 'valid'", *_ACC, extra=_settled_sql()))
def q_read_id_list(spark, sf):
    """K3 + S7: invalid and error ids of the previous run appended as text lines, read back."""
    path = _scratch(spark, "outcomes")
    SK.append_outcome_ids(_previous_run(spark, sf).outcomes, path)
    return RD.read_id_list(spark, path)


@query("write_verified_dictionary", with_fixtures(
    "SELECT CAST(account_id AS VARCHAR) AS account_id, screen_name FROM prev_status WHERE status = 'valid' UNION ALL "
    "SELECT CAST(c.account_id AS VARCHAR), a.screen_name FROM cur_ids c JOIN accounts a ON c.account_id = a.account_id "
    "WHERE a.verified AND c.account_id NOT IN (SELECT account_id FROM prev_status)", *_ACC, extra=_settled_sql()))
def q_write_verified_dictionary(spark, sf):
    """Entry 3 end to end: resume from the previous run, write the dictionary (K1), read it."""
    run = _current_run(spark, sf)
    path = _scratch(spark, "dictionary-final")
    SK.write_verified_dictionary(run.dictionary, path, fmt="parquet")
    return RD.read_verified_dictionary(spark, path, fmt="parquet")


@query("checkpoint_progress", with_fixtures(
    "SELECT account_id, status FROM prev_status", *_ACC, extra=_settled_sql()))
def q_checkpoint_progress(spark, sf):
    """K2: outcomes of a run stored batch by batch; a batch that runs again replaces itself."""
    store = SettledStore(spark, _scratch(spark, "progress"), _STORE_BUCKETS)
    outcomes = _previous_run(spark, sf).outcomes
    settled = F.col("status") == A.VALID
    for key, rows in (("0", outcomes.filter(settled)), ("1", outcomes.filter(~settled)), ("1", outcomes.filter(~settled))):
        store.commit(key, rows)
    return store.settled().select("account_id", "status")


class _CutOff(Exception):
    pass


def _interrupted_store(spark, sf) -> SettledStore:
    """The older listing settled in three batches, cut off after the first and finished by the next call with the whole listing."""
    folder = _scratch(spark, "resumed")

    def cut(_):
        raise _CutOff

    profiles = fx.accounts(spark, sf)
    try:
        update_dictionary(spark, fx.previous_friend_ids(spark, sf), profiles, folder, parts=3, progress=cut, buckets=_STORE_BUCKETS)
    except _CutOff:
        pass
    update_dictionary(spark, fx.friend_ids(spark, sf), profiles, folder, parts=2)
    return SettledStore(spark, f"{folder}/outcomes")


@query("resumed_dictionary", with_fixtures(
    "SELECT f.account_id, CASE WHEN a.verified THEN a.screen_name END AS screen_name, CASE WHEN a.verified THEN 'valid' "
    "WHEN NOT a.verified THEN 'invalid' ELSE 'error' END AS status FROM (SELECT DISTINCT account_id FROM friend_ids) f "
    "LEFT JOIN accounts a ON f.account_id = a.account_id", "friend_ids", "accounts"))
def q_resumed_dictionary(spark, sf):
    """Entry 3 cut off after one batch and resumed: every listed id is settled once."""
    return _interrupted_store(spark, sf).settled().select("account_id", "screen_name", "status")


@query("dictionary_progress", with_fixtures(
    "SELECT CAST(count(DISTINCT f.account_id) AS BIGINT) AS settled, CAST(count(DISTINCT f.account_id) FILTER (a.verified) AS BIGINT) AS valid, "
    "CAST(5 AS BIGINT) AS batches FROM friend_ids f LEFT JOIN accounts a ON f.account_id = a.account_id", "friend_ids", "accounts"))
def q_dictionary_progress(spark, sf):
    """Progress of entry 3 from the ledger: ids settled and valid so far over all finished batches."""
    return _interrupted_store(spark, sf).ledger().agg(
        F.sum(F.col("valid") + F.col("invalid") + F.col("error")).alias("settled"), F.sum("valid").alias("valid"),
        F.count(F.lit(1)).alias("batches"))


@query("dictionary_stream", with_fixtures(
    "SELECT CAST(a.account_id AS VARCHAR) AS account_id, a.screen_name FROM (SELECT DISTINCT account_id FROM friend_ids) f "
    "JOIN accounts a ON f.account_id = a.account_id WHERE a.verified", "friend_ids", "accounts"))
def q_dictionary_stream(spark, sf):
    """Streaming upkeep: the id listing arrives as two files (older orders first)."""
    from murmuration.streaming.dictionary_stream import dictionary_from_outcomes, start_dictionary_stream
    ids_dir, out, ckpt = _scratch(spark, "ids"), _scratch(spark, "stream-out"), _scratch(spark, "stream-ckpt")
    prev = fx.previous_friend_ids(spark, sf)
    prev.write.mode("overwrite").parquet(f"{ids_dir}/part=0")
    # merged: a broadcast would pass the older listing through the driver
    fx.friend_ids(spark, sf).join(prev.distinct().hint("merge"), "account_id", "left_anti").write.mode("overwrite").parquet(f"{ids_dir}/part=1")
    q = start_dictionary_stream(spark, f"{ids_dir}/*", fx.accounts(spark, sf), out, ckpt, buckets=_STORE_BUCKETS)
    q.awaitTermination()
    return dictionary_from_outcomes(spark, out)


# ================================================================== survey names that are parts of larger queries

_POL = [("corp", "SELECT post_id, lower(text) AS text FROM posts")] + O.sentiment_ctes("corp", dedup=False)


def _post_scores(spark, sf):
    corp = _posts(spark, sf).select("post_id", F.lower("text").alias("text"))
    return S.scored_corpus(corp, fx.lexicon(spark), remove_duplicates=False)


@query("polarity", with_fixtures("SELECT post_id, round(polarity, 6) AS polarity FROM s_sc", "posts", "lexicon", extra=_POL))
def q_polarity(spark, sf):
    """P14."""
    return rounded(_post_scores(spark, sf).select("post_id", "polarity"))


@query("truncate_score", with_fixtures(f"SELECT post_id, {O.trunc('polarity')} AS truncated FROM s_sc", "posts", "lexicon",
                                       extra=_POL))
def q_truncate_score(spark, sf):
    """P13."""
    return rounded(_post_scores(spark, sf).select("post_id", T.truncate_score("polarity").alias("truncated")))


@query("sentiment_label", with_fixtures(f"SELECT post_id, {O.label('polarity')} AS label FROM s_sc", "posts", "lexicon",
                                        extra=_POL))
def q_sentiment_label(spark, sf):
    """P12."""
    return _post_scores(spark, sf).select("post_id", T.sentiment_label("polarity").alias("label"))


_EXPORT_IDS_SQL = "SELECT node, id FROM ids"


@query("node_group", net_sql(
    f"SELECT node, CAST(CASE WHEN length(node) >= 56 THEN 2 WHEN node = {O.q(O.GIVEN)} THEN 3 ELSE 1 END AS BIGINT) AS \"group\" "
    f"FROM (SELECT sender AS node FROM edges UNION SELECT receiver FROM edges) n"))
def q_node_group(spark, sf):
    """P16."""
    hidden = PV.is_hidden(F.col("node"))
    return G.node_list(_network_edges(spark, sf)).select(
        "node", F.when(hidden, F.lit(2)).when(F.col("node") == O.GIVEN, F.lit(3)).otherwise(F.lit(1)).cast("long").alias("group"))


@query("blank_hidden_label", net_sql(
    "SELECT node, CASE WHEN length(node) >= 56 THEN ' ' ELSE node END AS name "
    "FROM (SELECT sender AS node FROM edges UNION SELECT receiver FROM edges) n"))
def q_blank_hidden_label(spark, sf):
    """P17."""
    return G.node_list(_network_edges(spark, sf)).select(
        "node", F.when(PV.is_hidden(F.col("node")), F.lit(" ")).otherwise(F.col("node")).alias("name"))


@query("node_size", net_sql("SELECT id, size FROM (SELECT id, CAST(10 AS BIGINT) AS size FROM ids) x",
                            base=_COMP_NET, extra=_lcc_ctes()))
def q_node_size(spark, sf):
    """P18."""
    return X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)[0].select("id", "size")


@query("usage_message", with_fixtures(
    f"SELECT CAST(row_number() OVER (ORDER BY n DESC, tag) AS VARCHAR) || '. #' || tag || ' used ' || CAST(n AS VARCHAR) || "
    f"CASE WHEN n = 1 THEN ' time.' ELSE ' times.' END AS message FROM "
    f"(SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {O.q(O.HASHTAG)}, 1)) AS tag FROM posts) t "
    f"GROUP BY tag ORDER BY n DESC, tag LIMIT 10) x", "posts"))
def q_usage_message(spark, sf):
    """P22."""
    return TP.top_hashtags(TP.hashtag_counts(_posts(spark, sf)), 10).select("message")


@query("metric_delta", _hist_sql(
    "SELECT c.nodes - p.nodes AS delta_nodes, c.edges - p.edges AS delta_edges, "
    "round(c.density_pct - p.density_pct, 6) AS delta_density_pct FROM c_row c CROSS JOIN p_row p"))
def q_metric_delta(spark, sf):
    """P23."""
    prev, cur = _runs(spark, sf)
    return rounded(H.compare_last_run(cur, prev).select("delta_nodes", "delta_edges", "delta_density_pct"))


@query("percent_density", net_sql(f"SELECT round(density_pct, 6) AS density_pct FROM ({_SIZE_SQL}) s"))
def q_percent_density(spark, sf):
    """P24."""
    return rounded(G.network_size(_network_edges(spark, sf)).select("density_pct"))


@query("network_density", net_sql(
    f"SELECT nodes, edges, round(density_pct / 100.0, 9) AS density FROM ({_SIZE_SQL}) s"))
def q_network_density(spark, sf):
    """A5: directed m / (n (n - 1))."""
    s = G.network_size(_network_edges(spark, sf))
    return s.select("nodes", "edges", F.round(F.col("density_pct") / 100.0, 9).alias("density"))


@query("encode_links", net_sql(
    "SELECT s.id AS source, t.id AS target FROM kept_edges e JOIN ids s ON e.sender = s.node JOIN ids t ON e.receiver = t.node",
    base=_COMP_NET, extra=_lcc_ctes()))
def q_encode_links(spark, sf):
    """Both ends of the exported edges as 0-based ids."""
    return X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)[1].select("source", "target")


@query("export_graph", net_sql(
    "SELECT 'node' AS part, id AS a, CASE WHEN length(node) >= 56 THEN ' ' ELSE node END AS name, NULL::BIGINT AS b, "
    "NULL::BIGINT AS value FROM ids UNION ALL SELECT 'link', s.id, NULL, t.id, w.value FROM kept_edges e "
    "JOIN (SELECT sender, receiver, count(*) AS value FROM kept_edges GROUP BY sender, receiver) w "
    "ON e.sender = w.sender AND e.receiver = w.receiver JOIN ids s ON e.sender = s.node JOIN ids t ON e.receiver = t.node",
    base=_COMP_NET, extra=_lcc_ctes()))
def q_export_graph(spark, sf):
    """Node and link tables of the largest component, stacked."""
    nodes, links = X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)
    n = nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), "name", F.lit(None).cast("long").alias("b"),
                     F.lit(None).cast("long").alias("value"))
    lk = links.select(F.lit("link").alias("part"), F.col("source").alias("a"), F.lit(None).cast("string").alias("name"),
                      F.col("target").alias("b"), "value")
    return n.unionByName(lk)


@query("export_nodes_csv", net_sql(
    "SELECT id, CASE WHEN length(node) >= 56 THEN ' ' ELSE node END AS name, "
    f"CAST(CASE WHEN length(node) >= 56 THEN 2 WHEN node = {O.q(O.GIVEN)} THEN 3 ELSE 1 END AS BIGINT) AS \"group\", "
    "CAST(10 AS BIGINT) AS size FROM ids", base=_COMP_NET, extra=_lcc_ctes()))
def q_export_nodes_csv(spark, sf):
    """K4: node table written as CSV with a header and read back."""
    path = _scratch(spark, "nodes-csv")
    SK.export_csv(X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)[0], path, encoding="iso-8859-1")
    return spark.read.option("header", True).option("encoding", "iso-8859-1").schema(
        "id long, name string, `group` long, size long").csv(path)


@query("export_links_csv", net_sql(
    "SELECT s.id AS source, t.id AS target, w.value FROM kept_edges e "
    "JOIN (SELECT sender, receiver, count(*) AS value FROM kept_edges GROUP BY sender, receiver) w "
    "ON e.sender = w.sender AND e.receiver = w.receiver JOIN ids s ON e.sender = s.node JOIN ids t ON e.receiver = t.node",
    base=_COMP_NET, extra=_lcc_ctes()))
def q_export_links_csv(spark, sf):
    """K5: link table written as CSV with a header and read back."""
    path = _scratch(spark, "links-csv")
    SK.export_csv(X.export_graph(_network_edges(spark, sf, query=O.COMPONENT_TOPIC), O.GIVEN)[1], path)
    return spark.read.option("header", True).schema("source long, target long, value long").csv(path)


@query("append_outcome_ids", with_fixtures("SELECT account_id, status FROM prev_status WHERE status <> 'valid'",
                                           *_ACC, extra=_settled_sql()))
def q_append_outcome_ids(spark, sf):
    """K3: invalid / error ids appended as text lines, one folder per status."""
    path = _scratch(spark, "outcome-ids")
    SK.append_outcome_ids(_previous_run(spark, sf).outcomes, path)
    lines = spark.read.text(path)    # the partition folder brings the status back
    return lines.select(F.col("value").cast("long").alias("account_id"), "status")


@query("append_run_history", _hist_sql(
    f"SELECT given_user, query, {_TS.format(c='run_ts')} AS run_ts, nodes, edges, round(percentile, 6) AS percentile "
    f"FROM (SELECT * FROM p_row UNION ALL SELECT * FROM c_row) h"))
def q_append_run_history(spark, sf):
    """K6: every run is kept (append), not overwritten."""
    prev, cur = _runs(spark, sf)
    path = _scratch(spark, "history-all")
    SK.append_run_history(prev, path)
    SK.append_run_history(cur, path)
    h = RD.read_run_history(spark, path)
    return rounded(h.select("given_user", "query", F.date_format("run_ts", "yyyy-MM-dd HH:mm:ss").alias("run_ts"), "nodes", "edges", "percentile"))


@query("network_summary_simple", net_sql(
    f"SELECT s.nodes, s.edges, round(s.density_pct, 6) AS density_pct, s.self_loops, round(t.transitivity, 6) AS transitivity "
    f"FROM ({O.size_sql('sg')}) s CROSS JOIN (SELECT CASE WHEN coalesce(num, 0) = 0 THEN 0.0 ELSE CAST(num AS DOUBLE) / den END "
    f"AS transitivity FROM (SELECT count(*) AS num FROM se a JOIN se b ON a.sender = b.sender AND a.receiver <> b.receiver "
    f"JOIN se c ON c.sender = a.receiver AND c.receiver = b.receiver) x CROSS JOIN "
    f"(SELECT sum(d * (d - 1)) AS den FROM (SELECT sender, count(*) AS d FROM se GROUP BY sender) y) z) t",
    extra=[("sg", "SELECT DISTINCT sender, receiver FROM edges"),
           ("se", "SELECT DISTINCT sender, receiver FROM edges WHERE sender <> receiver")]))
def q_network_summary_simple(spark, sf):
    """G13 with repeated contact off: simple graph, transitivity reported."""
    from murmuration.plans.network import network_summary
    e = _network_edges(spark, sf)
    return rounded(network_summary(G.build_graph(e, False), _params(multi=False))
                   .select("nodes", "edges", "density_pct", "self_loops", "transitivity"))


@query("topic_sentiment", with_fixtures(
    "SELECT mean, n_posts, example, sd, label FROM ts_sum", "posts", "lexicon",
    extra=[("ts_corpus", f"SELECT post_id, lower(text) AS text FROM posts WHERE lang = 'en' "
                         f"AND list_contains(regexp_extract_all(lower(text), {O.q(O.MENTION)}, 1), 'user7') "
                         f"AND floor((epoch_us(TIMESTAMP '{O.AS_OF}') - epoch_us(created_at)) / 86400000000.0) <= 30")]
    + O.sentiment_ctes("ts_corpus", dedup=False, prefix="ts")))
def q_topic_sentiment(spark, sf):
    """Entry 2: sentiment of the posts about an account in the last 30 days."""
    from murmuration.plans.topic_report import TopicParams, topic_report
    rep = topic_report(_posts(spark, sf), fx.lexicon(spark), TopicParams(given_user="@User7", days=30, as_of=O.AS_OF))
    return rep.sentiment


@query("dyad_substring_counts", net_sql(
    "SELECT a.sender, a.receiver, CAST(sum(b.n) AS BIGINT) AS weight FROM dy a JOIN dy b "
    "ON suffix(b.sender, a.sender) AND starts_with(b.receiver, a.receiver) GROUP BY a.sender, a.receiver",
    extra=[("dy", "SELECT sender, receiver, count(*) AS n FROM edges GROUP BY sender, receiver")]))
def q_dyad_substring_counts(spark, sf):
    """A2 in the reference's substring mode (a prefix handle also counts longer ones)."""
    return G.dyad_substring_counts(_network_edges(spark, sf))


@query("transitivity_undirected", net_sql(
    "SELECT round(CASE WHEN t = 0 THEN 0.0 ELSE 3.0 * t / c END, 6) AS transitivity FROM "
    "(SELECT count(*) AS t FROM ue x JOIN ue y ON x.a = y.a AND x.b < y.b JOIN ue z ON z.a = x.b AND z.b = y.b) tt "
    "CROSS JOIN (SELECT sum(d * (d - 1)) / 2.0 AS c FROM (SELECT n, count(*) AS d FROM "
    "(SELECT a AS n FROM ue UNION ALL SELECT b FROM ue) w GROUP BY n) dd) cc",
    extra=[("ue", "SELECT DISTINCT least(sender, receiver) AS a, greatest(sender, receiver) AS b FROM edges "
                  "WHERE sender <> receiver")]))
def q_transitivity_undirected(spark, sf):
    """A7, canonical form: 3 x triangles / connected triples without direction."""
    return rounded(G.transitivity(_network_edges(spark, sf), directed=False))
