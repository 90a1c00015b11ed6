"""Drift between a baseline and a current table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FLOOR = 1e-4
#: Ranges that a global order is dealt into.
RANGES = 128


def _share(n, total):
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(FLOOR)).otherwise(n / total)


def _no_psi(spark) -> DataFrame:
    """Without values on one side there is nothing to compare: no value, no drift."""
    return spark.createDataFrame([(None, False)], "psi double, drift boolean")


def _psi(cells: DataFrame, b_total, c_total) -> DataFrame:
    b, c = _share(F.col("b"), b_total), _share(F.col("c"), c_total)
    psi = F.abs(F.sum((c - b) * F.log(c / b)))
    return cells.agg(F.round(psi, 4).alias("psi")).withColumn("drift", F.col("psi") > 0.1)


def two_sides(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(value, b, c): how often each value stands on either side; nulls left out. The shuffle moves distinct values."""
    both = baseline.select(F.col(column).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(current.select(F.col(column).alias("value"), F.lit(0).alias("b"), F.lit(1).alias("c")))
    return both.where("value is not null").groupBy("value").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))


def psi_categorical(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    cells = two_sides(baseline, current, column)
    total = cells.agg(F.sum("b").alias("b"), F.sum("c").alias("c")).first()
    if not total["b"] or not total["c"]:
        return _no_psi(baseline.sparkSession)
    return _psi(cells, total["b"], total["c"])


def _binned(df: DataFrame, column: str, edges: list[float], side: str) -> DataFrame:
    x = F.col(column)
    bins = F.aggregate(F.array(*[F.lit(e) for e in edges[1:-1]]), F.lit(0), lambda n, e: n + (x >= e).cast("int"))
    return df.where(x.between(edges[0], edges[-1])).groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias(side))


def _edges(low: float, high: float, bins: int) -> list[float]:
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    return [low + (high - low) * i / bins for i in range(bins)] + [high]


def psi_numeric(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins of the baseline; current values beyond them count in the total only."""
    m = baseline.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    n = current.agg(F.count(column)).first()[0]
    if not m["n"] or not n:
        return _no_psi(baseline.sparkSession)
    edges = _edges(float(m["lo"]), float(m["hi"]), bins)
    all_bins = baseline.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    cells = all_bins.join(_binned(baseline, column, edges, "b"), "bin", "left").join(_binned(current, column, edges, "c"), "bin", "left")
    return _psi(cells, m["n"], n)


def _ranges(cells: DataFrame, count: int = RANGES) -> DataFrame:
    """cells with _range: the place of value among at most `count` bounds, quantiles of the distinct values."""
    bounds = cells.agg(F.percentile_approx("value", [i / count for i in range(1, count)])).first()[0]
    bounds = F.array(*map(F.lit, sorted(set(bounds or [])))).cast("array<double>")
    return cells.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col("value"))))


def ecdf_distances(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein-1 distance from running sums over distinct values.

    Values are dealt into ranges; each range sums on its own and starts from the sums of the ranges before it. Windows
    without a partition see one row per range only. Null for both if a side has no values.
    """
    cells = _ranges(two_sides(baseline, current, column))
    total = cells.agg(F.sum("b").alias("b"), F.sum("c").alias("c")).first()
    if not total["b"] or not total["c"]:
        return baseline.sparkSession.createDataFrame([(None, None)], "ks double, wasserstein double")
    by_range = W.orderBy("_range")
    before = by_range.rowsBetween(W.unboundedPreceding, -1)
    starts = cells.groupBy("_range").agg(F.sum("b").alias("b"), F.sum("c").alias("c"), F.min("value").alias("least"))
    starts = starts.select("_range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.lead("least").over(by_range).alias("after"))
    order = W.partitionBy("_range").orderBy("value")
    cells = cells.join(F.broadcast(starts), "_range")  # at most RANGES rows
    gap = F.abs((F.col("b0") + F.sum("b").over(order)) / total["b"] - (F.col("c0") + F.sum("c").over(order)) / total["c"])
    width = F.coalesce(F.lead("value").over(order), F.col("after")) - F.col("value")
    seen = cells.select("value", gap.alias("gap"), (width).alias("width"))
    return seen.agg(F.round(F.max("gap"), 6).alias("ks"), F.round(F.sum(F.col("gap") * F.col("width")), 4).alias("wasserstein"))


def js_distance(baseline: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Jensen-Shannon distance over equal-width bins of both sides' range."""
    m = baseline.select(column).unionByName(current.select(column)).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    nb, nc = baseline.agg(F.count(column)).first()[0], current.agg(F.count(column)).first()[0]
    if not nb or not nc:
        return baseline.sparkSession.createDataFrame([(None,)], "js_distance double")
    edges = _edges(float(m["lo"]), float(m["hi"]), bins)
    cells = _binned(baseline, column, edges, "b").join(_binned(current, column, edges, "c"), "bin", "full")
    p, q = F.coalesce(F.col("b"), F.lit(0)) / nb, F.coalesce(F.col("c"), F.lit(0)) / nc
    part = lambda x, y: F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0)
    return cells.agg(F.round(F.sqrt(0.5 * F.sum(part(p, q) + part(q, p))), 4).alias("js_distance"))


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value of the two-sample Kolmogorov-Smirnov statistic."""
    if not n or not m:
        return 1.0
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.04:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def ks_test(baseline: DataFrame, current: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """ks, p_value and whether the sides differ at alpha; null, 1 and false if a side has no values."""
    ks = ecdf_distances(baseline, current, column).first()["ks"]
    n, m = (df.agg(F.count(column)).first()[0] for df in (baseline, current))
    p = 1.0 if ks is None else ks_p_value(ks, n, m)
    return baseline.sparkSession.createDataFrame([(ks, round(p, 6), p < alpha)], "ks double, p_value double, differs boolean")


def new_categories(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values of the current side that the baseline never had, with their counts."""
    return two_sides(baseline, current, column).where("b = 0").select("value", F.col("c").alias("count"))


def zscore_rows(baseline: DataFrame, current: DataFrame, id_col: str, column: str, threshold: float = 2.0) -> DataFrame:
    """Current rows more than `threshold` baseline deviations from the baseline's mean."""
    m = baseline.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")).first()
    if not m["s"]:  # a constant or empty baseline: nothing deviates by a known measure
        return current.select(id_col, column).limit(0)
    return current.where(F.abs((F.col(column) - m["m"]) / m["s"]) > threshold).select(id_col, column)


def schema_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Columns added, removed or of another type; from schemas alone."""
    a, b = dict(baseline.dtypes), dict(current.dtypes)
    rows = [(c, "column_removed") for c in a if c not in b] + [(c, "column_added") for c in b if c not in a] + [(c, "type_changed") for c in a if c in b and a[c] != b[c]]
    return baseline.sparkSession.createDataFrame(rows, "column string, change string")
