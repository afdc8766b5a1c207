"""Entry 1 end to end: absent account, timeline enrichment, settings."""

from conftest import SF_SMALL
from murmuration.plans.network import NetworkParams, analyse_network
from murmuration.sources import fixtures as fx


def test_absent_account_gives_empty_report(spark):
    res = analyse_network(fx.posts(spark, SF_SMALL), fx.verified_dictionary(spark, SF_SMALL),
                          NetworkParams(query="launch", given_user="nobody_here"))
    assert not res.given_present
    assert res.report().count() == 0
    assert res.percentile().count() == 0


def test_timeline_enrichment_only_adds_posts(spark):
    posts, dic = fx.posts(spark, SF_SMALL), fx.verified_dictionary(spark, SF_SMALL)
    plain = analyse_network(posts, dic, NetworkParams(query="launch", given_user="User3"))
    rich = analyse_network(posts, dic, NetworkParams(query="launch", given_user="User3",
                                                     get_user_activity=True, mentions_of_user=True))
    a = {r.post_id for r in plain.corpus.select("post_id").collect()}
    b = {r.post_id for r in rich.corpus.select("post_id").collect()}
    assert a <= b
    assert rich.corpus.count() == len(b)                  # no duplicates after the union


def test_settings_change_the_graph(spark):
    posts, dic = fx.posts(spark, SF_SMALL), fx.verified_dictionary(spark, SF_SMALL)
    multi = analyse_network(posts, dic, NetworkParams(query="", given_user="User3"))
    simple = analyse_network(posts, dic, NetworkParams(query="", given_user="User3", multi=False, selfloop=True,
                                                       hashing="none"))
    m = multi.summary().first()
    s = simple.summary().first()
    assert m.transitivity is None and s.transitivity is not None
    assert s.edges <= simple.edges.count()                # simple graph: distinct pairs
    names = {r.node for r in simple.centrality.select("node").collect()}
    assert all(len(x) < 56 for x in names)                # hashing='none' shows every handle
    hidden = {r.node for r in multi.centrality.select("node").collect() if len(r.node) >= 56}
    assert hidden                                         # 'valid' hides the non-verified


def test_mentions_are_found_once_and_stored(spark):
    import __spark_entry__ as E
    from test_plans import plan_text
    for name in ("protect_edges", "node_list"):
        text = plan_text(E.queries()[name](spark, SF_SMALL))
        assert "regexp_extract_all" not in text and "events.parquet" not in text, name
