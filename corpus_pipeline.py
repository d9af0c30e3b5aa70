"""The corpus pipeline: documents through five operators of tidebar.llm, one stage after the other.

Each stage's rows are written as Parquet in the shared folder and read again as the next stage's documents. Rows without an id go
through every stage under a key made of their text, behind all ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import shared_path, table, without, write_table
from tidebar.llm.decontaminate import drop_contaminated
from tidebar.llm.exact_dedup import drop_copies
from tidebar.llm.jaccard_join import similar_components
from tidebar.llm.packing import packed_documents
from tidebar.llm.toxicity import toxicity as toxicity_scores

TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC by a model of all labels."""
    labels = table(spark, sf_dir, "labels")
    return without(docs, lambda rows: toxicity_scores(rows, labels, F.lit(True)).where(F.col("score") >= TOXIC), "toxic")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return drop_copies(docs)


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 the one with the smallest id."""
    return without(docs, lambda rows: similar_components(rows, shingle=5, percent=80).where("doc_id <> component_id"), "near-copies")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("jaccard dedup", jaccard_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned scores and fingerprints can't be said in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name.replace(' ', '-')}")
        write_table(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
