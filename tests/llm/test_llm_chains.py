"""The training chains of the toxicity field."""

import cases
import numpy as np
from pyspark.sql import functions as F

from murmuration.llm import toxicity


def test_neutral_chains_are_drawn_one_by_one(spark, monkeypatch):
    """Chains without a marked feature are all alike; of 300 about 100 are wanted."""
    rows = [(i, "vilestuff " + cases.prose(i, 30), 1) for i in range(20)] + [(100 + i, cases.prose(100 + i, 40), 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "marked_features", lambda counts: ["wvilestuff"])
    monkeypatch.setattr(toxicity.Crf, "fit", lambda self, ids, on, y: seen.append(ids))
    toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), chains=100)
    toxicity.train(docs.repartition(7, F.rand(3)).select("doc_id", "text"), docs.select("doc_id", "toxic"), chains=100)
    neutral = (~seen[0].any((1, 2))).sum()
    assert 60 <= neutral <= 140 and (seen[0].any((1, 2))).sum() == 20
    assert np.array_equal(seen[0], seen[1])
