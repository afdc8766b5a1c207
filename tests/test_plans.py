"""Physical-plan checks: built-in expressions only, no cartesian products, pruned scans."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

CHEAP = ["topic_posts", "mention_edges", "protect_edges", "edge_weights", "sentiment_summary", "top_hashtags",
         "words_and_bigrams", "hydrate_accounts", "skip_known_valid", "polarity", "document_token_frequency",
         "network_size", "enrich_with_timeline"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_udf_and_no_cartesian(spark, name):
    text = plan_text(E.queries()[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "FlatMapGroupsInPandas"):
        assert bad not in text, f"{name}: {bad}"


def test_topic_scan_reads_only_needed_columns(spark):
    text = plan_text(E.queries()["topic_posts"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in text
    assert "ts:" not in text.split("ReadSchema")[1].split("\n")[0]


def test_profile_filter_reaches_the_scan(spark):
    text = plan_text(E.queries()["hydrate_accounts"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(c_nationkey), Not(EqualTo(c_nationkey,0))" in text
