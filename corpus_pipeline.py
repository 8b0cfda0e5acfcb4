"""A corpus from raw documents: five stages, each written as Parquet and read again as the next one's documents.

Defined cases: a null or empty text is kept by the first four stages (it is not toxic, has no copies, holds no item, and its source passes once
at least); a null doc_id has no label and is sharded as the key -1; repeated rows are copies, of which one stays; columns beyond those of
documents are kept, whatever their names, but for ``shard``, which the last stage sets; an empty table of documents gives no rows, an empty
table of labels or of benchmark items removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import decontamination, mixing, ngram_join, sharding, toxicity
from emberline.session import forget, table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays."""
    return ngram_join.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; every source passes once in full, so no document is lost."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard by jump consistent hashing."""
    return sharding.sharded(docs)


STAGES = [("toxicity", toxic_out), ("ngram_join", near_copies_out), ("decontamination", benchmark_out), ("mixing", mix), ("sharding", shard)]
#: Language models, classes by links and placements are not expressible in SQL; tests hold what each stage decides against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # the table of the stage before; the input is not one
    return STAGES[-1][1](spark, docs, sf_dir)
