"""A corpus run: quality, near duplicates, benchmark leaks, source mixture, shards.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the
columns of ``docs``.  Its result is written and read again as the next one's docs.

Defined cases: a null or empty text has quality 0 and goes in the first stage (so
do all rows if the labels call most documents bad); rows with a null id stay until
the mixture takes them like others; repeated rows stay together; benchmark items
without letters or digits are not searched; columns that clash with names an
operator uses pass through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequarry.llm.decontamination import drop_contaminated
from framequarry.llm.mixing import mixture
from framequarry.llm.neardup import drop_near_duplicates
from framequarry.llm.quality import drop_low_quality
from framequarry.llm.sharding import shard_documents
from framequarry.llm.workspace import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mixture takes them."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mixture."""
    return shard_documents(docs, 16)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier and the overlap with benchmark passages within an edit budget are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
