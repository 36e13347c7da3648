"""The corpus pipeline: documents to packed training sequences in five stages, each over all that its predecessor kept.

Every stage but the last returns the columns of its documents. Rows are taken as they come: null ids and texts, ids that stand
with several texts, repeated rows, empty tables and columns of any further name have a defined result, stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import classify, decontaminate, exact, near_dup, packing
from logweave.plans.materialize import fresh_folder, release

#: A document of which the benchmark covers more than this share of the words goes; from others only the spans go.
MOST_COVERED = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Every row is judged by its text alone, a null one as an empty one; repeated rows all stay or go."""
    return classify.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id, one row of it; null texts are empty ones, and a null id stays only where there is no other."""
    return exact.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, its smallest doc_id; five-word shingles, similarity 0.8.

    Repeated rows leave one. Documents without an id, or with one that other texts have too, take part and count as larger
    than all others. Null and wordless texts stay, one row of each id.
    """
    return near_dup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that the benchmark has, and without the documents that it mostly covers. Row by row: ids do not matter, null texts stay."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), MOST_COVERED)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with the mixture of the sources; null texts are empty documents, a null source is a source, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

#: The first and third stage are a trained network and an iterative clustering, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again before the next."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        release(spark)
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
