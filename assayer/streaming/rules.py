"""Row rules on streams. Conditions are those of batch operators; only the counts keep state, bounded by the watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clean import quarantine


def split_stream(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(clean rows, quarantined rows with _reasons) of a stream or a table; no state, nothing is shuffled. Null conditions
    break nothing."""
    marked = quarantine(rows, rules)
    return marked.where(F.size("_reasons") == 0).drop("_reasons"), marked.where(F.size("_reasons") > 0)


def broken_per_window(rows: DataFrame, ts: str, rules: dict[str, Column], width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(start, rule, rows) per time window of how many rows break each rule; rows later than `late` are left out, and a
    window's state goes once the watermark has passed it. Rows without a time belong to no window."""
    marked = quarantine(rows.withWatermark(ts, late), rules)
    per = marked.select(F.col(ts).alias("_ts"), F.explode("_reasons").alias("rule"))
    return per.groupBy(F.window("_ts", width).alias("w"), "rule").agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), "rule", "rows")
