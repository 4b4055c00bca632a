"""A corpus pipeline: toxicity, quality, near duplicates, decontamination and mixing, each stage on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null
and blank texts are kept by the filters (their score decides like any other's); an empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.decontaminate import decontaminated
from folioflow.llm.jaccard_join import jaccard_components
from folioflow.llm.mixing import mixture
from folioflow.llm.quality import scorer
from folioflow.llm.shared import table, written
from folioflow.llm.toxicity import grader

#: A document goes if its probability of good quality is below this.
MIN_QUALITY = 0.3
ROW_KEY = "near_duplicate_row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose expected grade is toxic."""
    graded = grader(docs, table(spark, sf_dir, "labels"))(F.col("text"))
    return docs.where(~graded["toxic"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored below MIN_QUALITY."""
    return docs.where(scorer(docs, table(spark, sf_dir, "labels"))(F.col("text")) >= MIN_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 of 5-word shingles: that with the smallest doc_id (null
    last), the first of its rows. Rows are told apart by a written key, as ids may repeat or be null; texts without words
    link with nothing and stay.
    """
    keyed = written(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()))
    groups = written(jaccard_components(keyed, id_col=ROW_KEY, k=5, percent=80).withColumnRenamed("id", ROW_KEY))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW_KEY))[ROW_KEY]
    named = groups.where("n_shingles > 0").join(keyed.select(ROW_KEY, "doc_id"), ROW_KEY)
    # a group of very many rows is pre-aggregated, and its rows look for their own key, not for their group
    kept = named.groupBy("component_id").agg(first.alias(ROW_KEY)).select(ROW_KEY)
    return keyed.join(kept.union(groups.where("n_shingles = 0").select(ROW_KEY)), ROW_KEY, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, by source targets."""
    return mixture(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
