"""What the corpus operators share: whole texts, word rules, and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the result contracts: what separates words, and the rest.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Spark's settings that drop the shuffle files of a query once it has ended.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")

#: Spark's setting of the bytes that reach a Python worker at once, and the most that the pipeline's stages let it be.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python workers in batches of BATCH_BYTES or less, one row at least. By default 10 000 rows go at once, which
    for texts are tens of megabytes, held several times over by the JVM and the worker of each core. The session keeps the
    setting, as lazy results are planned later; a smaller one stays. No result depends on it."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def whole_text(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, which stand for the text."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver reach: spark.checkpoint.dir. Only a local session, where all run on
    one machine, may leave it unset; a cluster without it is an error, as rows written elsewhere would be lost."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: cuts lineage and survives lost executors. Shuffle files of the
    query that made it are dropped, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in CLEANUP}
    try:
        for k in CLEANUP:
            spark.conf.set(k, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that no later result reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words in a text (null counts as empty)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
