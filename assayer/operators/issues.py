"""Row numbers, issue tables and their summaries, ordered and seeded samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Severities, the gravest first.
SEVERITIES = ("critical", "high", "medium", "low", "info")


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """df with a running number from 0 in its present order. One count per partition reaches the driver; no sort, no
    shuffle. df must give the same rows on every run, as tables that are read do."""
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    starts, total = [], 0
    for r in counts:
        starts += [F.lit(r["p"]), F.lit(total).cast("long")]
        total += r["n"]
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long"))
    return df.withColumn("_p", part).withColumn(name, at).withColumn(name, F.col(name) + F.element_at(F.create_map(*starts), F.col("_p"))).drop("_p")


def issues(df: DataFrame, row_id: str, rules: dict[str, tuple[str, str, Column]]) -> DataFrame:
    """(row_id, column, issue, severity, value) for every rule that a row breaks; rules: issue -> (column, severity,
    condition). All rules in one pass; null conditions break nothing; an empty table has no issues."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(c).alias("column"), F.lit(k).alias("issue"), F.lit(s).alias("severity"), F.col(c).cast("string").alias("value"))) for k, (c, s, bad) in rules.items()]
    return df.select(F.col(row_id).alias("row_id"), F.inline(F.array_compact(F.array(*found))))


def issue_summary(found: DataFrame) -> DataFrame:
    """Per issue and severity: how many, on how many rows and columns. Counts are taken before any cap."""
    return found.groupBy("issue", "severity").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("row_id").alias("affected_rows"), F.count_distinct("column").alias("affected_columns"))


def severity_rank(column: Column) -> Column:
    """0 for the gravest; unknown and null severities come last."""
    return reduce(lambda rest, kv: F.when(column == kv[1], kv[0]).otherwise(rest), enumerate(SEVERITIES), F.lit(len(SEVERITIES)))


def gravest(found: DataFrame, n: int) -> DataFrame:
    """The n gravest issues, ties by row, column and issue, in order."""
    return found.orderBy(severity_rank(F.col("severity")), "row_id", "column", "issue").limit(n)


def capped(found: DataFrame, per: str, n: int) -> DataFrame:
    """At most n issues of each value of `per`, the first by row: for reports, which show no more."""
    rank = F.row_number().over(W.partitionBy(per).orderBy("row_id", "column", "issue"))
    return found.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    return df.orderBy(order_col).limit(n)


def seeded_sample(df: DataFrame, id_col: str, n: int = 100, seed: int = 42) -> DataFrame:
    """n rows by a hash of the id: the same ones on every run and however the rows are dealt."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col).limit(n)


def take_rows(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id stands in ids (one column of that name)."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def without_rows(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id does not stand in ids; rows with a null id stay."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_anti")


def any_all(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, any, all) of conditions over all rows, null counting as false; of no rows, any is false and all true."""
    wide = df.agg(*[x.alias(f"{n}{i}") for i, c in enumerate(rules.values()) for n, x in (("any", F.bool_or(F.coalesce(c, F.lit(False)))), ("all", F.bool_and(F.coalesce(c, F.lit(False)))))])
    rows = [F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(f"any{i}"), F.lit(False)).alias("any"), F.coalesce(F.col(f"all{i}"), F.lit(True)).alias("all")) for i, k in enumerate(rules)]
    return wide.select(F.inline(F.array(*rows)))


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the result's size; for reports only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
