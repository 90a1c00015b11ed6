"""Reading inputs by extension and writing results; nothing is converted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_any(spark: SparkSession, path: str, all_text: bool = False, **options) -> DataFrame:
    """CSV, JSON (multi-line), Parquet or ORC by extension. Bad CSV values become null, ragged rows lose extra tokens;
    all_text keeps every CSV column as text."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=not all_text, mode="PERMISSIVE", **options)
    if kind == "json":
        return spark.read.json(path, multiLine=True, **options)
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path, **options)
    raise ValueError(f"no reader for {path}")


def write_any(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """A directory of Parquet, CSV (with header) or JSON lines."""
    options = {"header": True} if kind == "csv" else {}
    df.write.mode(mode).format(kind).options(**options).save(path)


def require(df: DataFrame, columns) -> DataFrame:
    """df, if it has rows and the columns; else a ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.isEmpty():
        raise ValueError("the input has no rows")
    return df
