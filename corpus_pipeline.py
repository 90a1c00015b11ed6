"""From raw documents to encoded training rows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.bpe import bpe_digests
from assayer.llm.common import small_batches, written
from assayer.llm.jaccard import one_per_group
from assayer.llm.mixing import mix
from assayer.llm.quality_cnn import classify
from assayer.llm.queries import tokenizer_path
from assayer.llm.secrets import redact_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; those it rejects go.

    Null texts count as empty and are scored like any; repeated rows go or stay together; null ids are scored; columns
    of any name pass; an empty table stays empty.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep_row=True).where("predicted = 1").select("_row.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Links of the SimHash operator come first, each checked on whole shingle sets; an exact set join finds those of more
    distant fingerprints. The row kept is that of the least id, null ids last, then of the least text digest. Rows alike in
    all columns count as one; texts without words, null ones too, are one group; columns of any name pass.
    """
    small_batches(spark)
    return one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark. Null texts stay null, clean texts as they are; repeated
    rows and null ids stay."""
    return redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three times.

    Null and empty texts have no words; a null source is a source of its own; repeated rows are units of their own;
    columns of any name pass; an empty table stays empty.
    """
    small_batches(spark)
    mixed = mix(docs, keep_row=True)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, a row for each row; null texts count as empty."""
    small_batches(spark)
    return bpe_digests(docs, tokenizer_path(), cache=(100_000, 4 << 20))  # workers of earlier stages leave less memory than the operator has alone


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicate_removal", near_duplicate_removal),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the trained classifier nor the encoding; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
