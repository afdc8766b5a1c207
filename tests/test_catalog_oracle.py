"""Registered queries against their DuckDB statements on the smallest tables.

A representative subset runs by default; MURMURATION_FULL_ORACLE=1 runs all.
"""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from murmuration.plans import catalog
from murmuration.sources.tables import TABLES

SUBSET = ["topic_posts", "resolve_full_text", "extract_mentions", "clean_for_topics", "bigrams", "pseudonymise",
          "post_polarity", "verified_status_filter", "skip_known_valid", "top_hashtags", "hashtag_substring_counts",
          "edge_weights", "network_size", "sentiment_summary", "outcome_counts", "centrality", "influence_report",
          "connected_components", "export_links", "words_and_bigrams", "suggested_topics", "compare_last_run",
          "read_id_list", "dictionary_stream", "lda_topics", "checkpoint_progress", "resumed_dictionary", "dictionary_progress",
          "influence_run", "read_verified_dictionary_object", "account_ids"]

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

NAMES = sorted(catalog.ORACLE) if os.environ.get("MURMURATION_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else repr(round(x, 6) + 0.0)
        return "NULL" if x is None else str(x)
    return sorted("|".join(v(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(ocols)
    assert canon(rows, cols) == canon(res.fetchall(), ocols)
    # identical column types in both engines
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    assert spark_types == duck_types


def test_every_query_has_an_oracle_or_is_listed():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert set(catalog.QUERIES) <= set(E.queries())


def test_entry_without_the_optional_subpackage(tmp_path):
    """The entry module still imports, with the library's own queries, when the optional folders are gone."""
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "murmuration"), tmp_path / "murmuration", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') and q[2].isdigit() for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.stdout.split() == [str(len(catalog.QUERIES)), "0"], out.stderr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["section", "node", "pct", "score"]
    assert df.count() >= 0
