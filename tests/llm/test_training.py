import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality, toxicity, training


def test_labels_of_other_documents_use_up_no_sample(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    ids, y = training.labelled(docs, labels, "toxic", F.lit(True), lambda t: (np.arange(len(t) + 1), np.ones(len(t), np.int64)), rows=20)
    assert len(ids) == 20 and sorted(y.tolist()) == [0] * 10 + [1] * 10


def test_ids_of_the_sample_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(training, "SAMPLE_IDS", 7)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    ids, _ = training.labelled(docs, labels, "toxic", F.lit(True), lambda t: (np.arange(len(t) + 1) * 2, np.ones(2 * len(t), np.int64)))
    assert len(ids) == 3


def test_ids_of_rows_that_don_t_fit_stay_where_they_are(spark, monkeypatch):
    """What one task sorts has sizes, no ids."""
    monkeypatch.setattr(training, "SAMPLE_IDS", 30)
    kind, seen = type(spark.range(1)), []
    own = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    ids, _ = training.labelled(docs, docs.select("doc_id", F.lit(1).alias("toxic")), "toxic", F.lit(True), lambda t: (np.arange(len(t) + 1) * 10, np.ones(10 * len(t), np.int64)))
    assert len(ids) == 3
    (plan,) = seen
    sorted_rows = plan[plan.index("Window") :].split("\n")[1]  # what the window's only task gets
    assert sorted_rows.lstrip("  :+-").startswith("Project") and "octet_length(ids" in sorted_rows and ", ids#" not in sorted_rows


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_training_hands_its_memory_back(operator, monkeypatch):
    """The driver's process goes on with what a model takes, not with what finding it took."""

    def used() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) >> 10

    last = []

    def fit(*_):
        small = [np.ones(2_000) for _ in range(10_000)]  # 160 MB
        last.append(small[-1])  # what lies above them stays
        return "model"

    monkeypatch.setattr(operator, "labelled", lambda *_: ([], []))
    monkeypatch.setattr(operator, "fit", fit)
    before = used()
    assert operator.train(None, None, None) == "model"
    assert used() < before + 60
