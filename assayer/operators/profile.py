"""Profiling: statistics, frequencies, quality scores, issues, personal-data rates and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import iqr_bounds, long_form, order_statistics, outside, stacked

#: Patterns that tell personal data, tried in this order.
PII_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\d\s\-\(\)\+]{10,}$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "zip": r"^\d{5}(-\d{4})?$",
}


def numeric_profile(df: DataFrame, columns, multiplier: float = 1.5) -> DataFrame:
    """One row per column: counts, moments, nearest quartiles, IQR outliers. Order statistics come from bracketing scans, the
    rest from one aggregate; a column without values has null statistics."""
    q, middle = {}, {}
    found = order_statistics(df, columns, lambda n: [*[int((n - 1) * p + 0.5) for p in (0.25, 0.5, 0.75)], (n - 1) // 2, n // 2])
    for c, v in found.items():
        q[c], middle[c] = (v[:3], (float(v[3]) + float(v[4])) / 2) if v else ([None] * 3, None)
    bounds = {c: (None, None) if v[0] is None else (v[0] - multiplier * (v[2] - v[0]), v[2] + multiplier * (v[2] - v[0])) for c, v in q.items()}
    wide = []
    for c in columns:
        x = F.col(c).cast("double")
        stats = {
            "rows": F.count(F.lit(1)),
            "nulls": F.sum(F.col(c).isNull().cast("long")),
            "min": F.min(x),
            "max": F.max(x),
            "mean": F.round(F.avg(x), 4),
            "median": F.round(F.lit(middle[c]).cast("double"), 4),
            "std": F.round(F.stddev_samp(x), 4),
            "var": F.round(F.var_samp(x), 2),
            "skew": F.round(F.skewness(x), 4),
            "kurtosis": F.round(F.kurtosis(x), 4),
            "p25": F.lit(q[c][0]).cast("double"),
            "p50": F.lit(q[c][1]).cast("double"),
            "p75": F.lit(q[c][2]).cast("double"),
            "outliers": F.sum(outside(F.col(c), bounds[c]).cast("long")),
        }
        # literals go in as aggregates, so that all stays one plan
        wide += [(v if k not in ("median", "p25", "p50", "p75") else F.max(v)).alias(f"{c}__{k}") for k, v in stats.items()]
    return stacked(df.agg(*wide), columns, list(stats))


def string_profile(df: DataFrame, columns) -> DataFrame:
    """One row per column: nulls, distinct values (null is one), lengths in bytes, values with special characters."""
    wide = []
    for c in columns:
        stats = {
            "nulls": F.sum(F.col(c).isNull().cast("long")),
            "distinct_values": F.count_distinct(c) + F.max(F.col(c).isNull().cast("long")),
            "min_length": F.min(F.octet_length(c)).cast("long"),
            "max_length": F.max(F.octet_length(c)).cast("long"),
            "avg_length": F.round(F.avg(F.octet_length(c)), 4),
            "special": F.sum(F.coalesce(F.col(c).rlike(r"[^a-zA-Z0-9\s]"), F.lit(False)).cast("long")),
        }
        wide += [v.alias(f"{c}__{k}") for k, v in stats.items()]
    return stacked(df.agg(*wide), columns, list(stats))


def frequencies(df: DataFrame, columns) -> DataFrame:
    """(column, value, count), nulls as a value, all columns in one shuffle."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns, n: int = 10) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()))
    return frequencies(df, columns).withColumn("rank", rank).where(F.col("rank") <= n)


def entropy(df: DataFrame, columns) -> DataFrame:
    """Shannon entropy in nats: ln N - sum(c ln c) / N, which needs no second look at the counts."""
    c = F.col("count")
    return frequencies(df, columns).groupBy("column").agg(F.round(F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c), 4).alias("entropy"))


def quality_grade(df: DataFrame, columns, multiplier: float = 1.5) -> DataFrame:
    """completeness, validity (100 less outliers, at most 20 off), consistency, their mean, and the grade."""
    bounds = iqr_bounds(df, columns, multiplier)
    wide = []
    for c in columns:
        n = F.nullif(F.count(F.lit(1)), F.lit(0))  # an empty table has null scores and grade F
        wide += [
            (100.0 * F.count(c) / n).alias(f"{c}__completeness"),
            (100.0 - F.least(F.lit(20.0), 100.0 * F.sum(outside(F.col(c), bounds[c]).cast("long")) / n)).alias(f"{c}__validity"),
            F.when(F.count_distinct(c) + F.max(F.col(c).isNull().cast("long")) > 1, 100.0).otherwise(50.0).alias(f"{c}__consistency"),
        ]
    rows = stacked(df.agg(*wide), columns, ["completeness", "validity", "consistency"])
    quality = (F.col("completeness") + F.col("validity") + F.col("consistency")) / 3
    grade = F.when(quality >= 90, "A").when(quality >= 80, "B").when(quality >= 70, "C").when(quality >= 60, "D").otherwise("F")
    return rows.select("column", *[F.round(c, 4).alias(c) for c in ("completeness", "validity", "consistency")], F.round(quality, 4).alias("quality"), grade.alias("grade"))


def zscore_issues(df: DataFrame, id_cols, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows more than `threshold` deviations from the mean."""
    m = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    z = F.abs((F.col(column) - F.lit(m["m"])) / F.lit(m["s"])) if m["s"] else F.lit(0.0)
    return df.select(*id_cols, F.lit("distribution_anomaly").alias("issue"), F.col(column).alias("value")).where(z > threshold)


def iqr_issues(df: DataFrame, id_cols, column: str, multiplier: float = 1.5) -> DataFrame:
    bounds = iqr_bounds(df, [column], multiplier)[column]
    return df.where(outside(F.col(column), bounds)).select(*id_cols, F.lit("outlier").alias("issue"), F.col(column).alias("value"))


def pii_rates(df: DataFrame, columns) -> DataFrame:
    """Share of non-null values that match each pattern of personal data, over all rows, and the risk it brings."""
    cells = long_form(df, columns).where("value is not null")
    hits = [F.sum(F.col("value").rlike(p).cast("long")).alias(k) for k, p in PII_PATTERNS.items()]
    rates = cells.groupBy("column").agg(F.count(F.lit(1)).alias("values"), *hits)
    first = reduce(lambda acc, k: F.when(F.col(k) > 0.5 * F.col("values"), k).otherwise(acc), reversed(PII_PATTERNS), F.lit(None).cast("string"))
    return rates.withColumn("pii_type", first).withColumn("risk", F.when(F.col("pii_type").isNotNull(), 80).otherwise(0).cast("long"))


def lineage_score(df: DataFrame, required) -> DataFrame:
    """100, less 20 per missing column, less up to 15 by the share of nulls where it exceeds 5 percent."""
    have = [c for c in required if c in df.columns]
    wide = df.agg(*[(100.0 * F.sum(F.col(c).isNull().cast("long")) / F.count(F.lit(1))).alias(c) for c in have]) if have else df.sparkSession.range(1)
    off = reduce(lambda a, b: a + b, [F.when(F.col(c) > 5, F.least(F.lit(15.0), F.col(c) / 10)).otherwise(0.0) for c in have], F.lit(20.0 * (len(required) - len(have))))
    return wide.select(F.round(F.greatest(F.lit(0.0), 100.0 - off), 4).alias("score"))


def consent_issues(df: DataFrame, id_cols, column: str, allowed=("granted", "denied", "withdrawn", "pending")) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.lower(column).isin(*allowed)).select(*id_cols, F.col(column).alias("value"))


def uniqueness_coverage(df: DataFrame, columns) -> DataFrame:
    """Per column: rows whose value is not alone, all copies counted, and the score."""
    counts = frequencies(df, columns)
    share = 100.0 * F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)) / F.sum("count")
    return counts.groupBy("column").agg(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).cast("long").alias("duplicates"), F.round(100.0 - F.least(F.lit(25.0), share), 4).alias("score"))


def rule_coverage(df: DataFrame, rules: dict[str, Column], most_off: float = 20.0) -> DataFrame:
    """Per named rule (a condition that rows must meet): violations and the score, all rules in one scan. Null conditions
    break nothing; an empty table scores 100."""
    broken = {k: F.count_if(~F.coalesce(v, F.lit(True))) for k, v in rules.items()}
    wide = []
    for k, v in broken.items():
        wide += [v.alias(f"{k}__violations"), F.round(100.0 - F.least(F.lit(most_off), F.coalesce(F.try_divide(100.0 * v, F.count(F.lit(1))), F.lit(0.0))), 4).alias(f"{k}__score")]
    return stacked(df.agg(*wide), list(rules), ["violations", "score"])
