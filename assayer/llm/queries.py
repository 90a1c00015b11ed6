"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .knn import top_k
from .line_clean import quality_rules
from .mixing import mix
from .oracles import ORACLES
from .pii import scan_pii
from .quality_cnn import classify
from .secrets import secret_digests
from .simhash import near_duplicates
from .substring import substring_digests
from .suffix_dedup import suffix_digests


def tokenizer_path() -> str:
    """The public vocabulary file that the encoding contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixing(spark, sf_dir):
    """Sizes, targets and taken words of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def secrets(spark, sf_dir):
    """Counts, digest and spans of secrets in every document."""
    return secret_digests(table(spark, sf_dir, "documents"))


def knn(spark, sf_dir):
    """The 20 best candidates of every 20th vector, against all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"))


def quality(spark, sf_dir):
    """Score and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def rules(spark, sf_dir):
    """Metrics and verdict of every document."""
    return quality_rules(table(spark, sf_dir, "documents"))


def suffixes(spark, sf_dir):
    """What is left of every document without repeated 200-byte strings."""
    return suffix_digests(table(spark, sf_dir, "documents"))


def simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def substrings(spark, sf_dir):
    """What is left of every document without repeated 35-word passages."""
    return substring_digests(table(spark, sf_dir, "documents"))


def bpe(spark, sf_dir):
    """Token counts and digests of every document."""
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def pii(spark, sf_dir):
    """Counts, digest, spans and their scores of personal data in every document."""
    found = scan_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("scores", F.array_join(F.transform("scores", lambda x: F.format_number(x, 2)), ","))


def queries():
    return {
        "op1_cube_mixing": mixing,
        "op2_secret_scan": secrets,
        "op3_voronoi_topk": knn,
        "op4_quality_cnn": quality,
        "op5_line_rules": rules,
        "op6_suffix_array_dedup": suffixes,
        "op7_simhash": simhash,
        "op8_substring_dedup": substrings,
        "op9_bpe": bpe,
        "op10_pii": pii,
    }


def oracle_sql():
    return dict(ORACLES)
