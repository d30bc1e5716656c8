"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

toxicity            drops the documents that the factorization machine rejects (score >= 0.3)
quality             drops the documents that the support vectors reject (score < 0.3)
near_duplicates     keeps one document, the least doc_id, of each group linked by a Jaccard similarity of 0.8 of five-word shingles
decontaminate       drops the documents that hold ten words in a row, or all words, of a benchmark item
pieces              encodes what is left as SentencePiece ids and decodes them again

Each classifier is fitted on the labelled rows among its own input, a bounded sample of them. Rows without a
doc_id pass the stages like others; see the operators for nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, near_copies, pieces, quality, toxicity
from gleaner.llm.common import landed, table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.with_scores(docs, machine).filter("predicted = 0").select(docs.columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.with_scores(docs, model).filter("predicted = 1").select(docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.report(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("pieces", stage_pieces),
]

#: The classifiers are fitted outside SQL, so no SQL gives these rows; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
