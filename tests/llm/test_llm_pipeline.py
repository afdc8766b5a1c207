"""The pipeline against a brute-force version, on a small table and an empty one."""

import brute
import cases
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from murmuration.llm import quality


def tables():
    docs = [(i, cases.prose(i, 150)) for i in range(8)]
    docs += [(10 + i, cases.prose(i, 150)) for i in range(3)]                                             # exact copies
    docs += [(20 + i, cases.edited(cases.prose(0, 150), i, 0.02)) for i in range(12)]                     # near copies
    docs += [(40 + i, cases.prose(50, 60) + "\n" + cases.prose(60 + i, 90)) for i in range(6)]            # a shared line
    docs += [(60, "the\n".join(cases.prose(70, 100).split(" ")[:90]) + " " + cases.prose(98, 40)), (61, " | ".join(cases.prose(71, 90).split())),
             (62, "short"), (63, ""), (64, None), (65, cases.prose(1, 80) + " " + cases.prose(99, 30) + " " + cases.prose(2, 60))]
    return docs, [(0, cases.prose(99, 30)), (1, cases.prose(98, 40)), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items = tables()
    base = str(tmp_path_factory.mktemp("corpus"))
    df = spark.createDataFrame([(i, t, None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in docs], cases.SCHEMA).withColumn("_h", F.lit("own"))
    df.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_pipeline_equals_brute_force(spark, folder):
    docs, items = tables()
    want = brute.pipeline(docs, items, quality.RULES, quality.STOP_WORDS)
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) == len(want)
    assert all(r["n_chars"] == len(r["text"]) and r["_h"] == "own" for r in rows)
    places = [(r["mix_slot"], r["mix_row"]) for r in rows]
    assert len(set(places)) == len(places)


def test_stages_and_empty_input(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "weighted_mixing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect() == []
