"""A corpus from raw documents to token files, a stage at a time.

Every stage is applied to all that the stage before it kept, and all but the last return the columns of
``documents``.  Each result is written as Parquet and read again, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelloom.llm.decontamination import decontaminated
from parcelloom.llm.mixing import mixed_rows
from parcelloom.llm.ngram_join import one_of_each
from parcelloom.llm.quality_rules import keep_good
from parcelloom.llm.shared import written
from parcelloom.llm.token_output import written_and_read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shingles of five words link at a similarity of 0.8 or more."""
    return one_of_each(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones, and without benchmark passages."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is read back from the token files: ``doc_id, start, n_tokens, ids_crc32``."""
    import public_tokenizers

    return written_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token output", tokens)]

#: SQL cannot express the n-gram join's components, the mix's rounding or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
