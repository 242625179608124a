"""From raw documents to a tokenised training mixture, in five stages.

Each stage takes the table that the one before it wrote: quality rules drop outliers, near copies go but
for one of each group, repeated passages are left in one place, sources are mixed to target
weights, and what remains is encoded. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloam.llm import bpe, minhash, mixing, quality, suffix_array
from sparkloam.llm.common import prepare, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.reject_outliers(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash.drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_array.drop_repeated_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix_sources(docs, mixing.domain_of(F.col("source")), mixing.WEIGHTS, epoch_column=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # The plan holds the codec's tables as literals, 56 MB of the driver on 0.1 GB, for as long as anyone holds the result.
    return store(bpe.encode_documents(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("passage dedup", passage_dedup),
    ("mixture", mixture),
    ("bpe", tokens),
]

#: Robust covariances, components and merges have no SQL. The tests run brute-force versions of the stages one after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
