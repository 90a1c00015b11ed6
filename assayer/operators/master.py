"""Master data: keys, contracts, lineage, golden records, survivorship, stewardship, write-back."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normalised, stacked


def key_candidates(df: DataFrame, columns) -> DataFrame:
    """Uniqueness and nulls of each column, in percent, and whether it can be a primary or an entity key."""
    n, wide = F.count(F.lit(1)), []
    for c in columns:
        wide += [(100.0 * F.count_distinct(c) / F.nullif(F.count(c), F.lit(0))).alias(f"{c}__uniqueness"), F.try_divide(100.0 * (n - F.count(c)), n).alias(f"{c}__null_pct")]
    rows = stacked(df.agg(*wide), columns, ["uniqueness", "null_pct"])
    kind = F.when((F.col("uniqueness") >= 99) & (F.col("null_pct") <= 0), "primary").when(F.col("uniqueness").between(50, 99), "entity").otherwise("none")
    return rows.select("column", F.round("uniqueness", 4).alias("uniqueness"), F.round("null_pct", 4).alias("null_pct"), kind.alias("key_kind"))


def composite_keys(df: DataFrame, columns, most: int = 3, least: float = 99.0) -> DataFrame:
    """Combinations of 2..most columns that tell rows apart; all in one aggregate."""
    combos = [c for k in range(2, most + 1) for c in combinations(columns, k)]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.struct(*c)).alias("+".join(c)) for c in combos])
    rows = F.array(*[F.struct(F.lit("+".join(c)).alias("columns"), F.round(F.try_divide(100.0 * F.col(f"`{'+'.join(c)}`"), F.col("n")), 4).alias("uniqueness")) for c in combos])
    return wide.select(F.inline(rows)).where(F.col("uniqueness") >= least)


def is_sequence(df: DataFrame, column: str) -> DataFrame:
    """Share of unit gaps among sorted distinct values: a self-join on value + 1 instead of a global window."""
    v = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    steps = v.join(v.select((F.col("v") - 1).alias("v")), "v", "left_semi").agg(F.count(F.lit(1)).alias("unit_gaps"))
    return steps.join(F.broadcast(v.agg((F.count(F.lit(1)) - 1).alias("gaps")))).select("unit_gaps", "gaps", (F.col("unit_gaps") > 0.9 * F.col("gaps")).alias("auto_increment"))


def fk_overlap(df: DataFrame, column: str, reference: DataFrame, key: str) -> DataFrame:
    """Share of distinct values that the reference holds."""
    a = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    b = reference.select(F.col(key).alias("v"), F.lit(1).alias("hit")).distinct()
    return a.join(b, "v", "left").agg(F.count(F.lit(1)).alias("distinct_values"), F.count("hit").alias("matched"), F.round(F.try_divide(100.0 * F.count("hit"), F.count(F.lit(1))), 4).alias("overlap_pct"))


def enforce(df: DataFrame, allowed: dict | None = None, ranges: dict | None = None, defaults: dict | None = None) -> DataFrame:
    """Values outside the allowed ones become the default or null; numbers are capped to their range."""
    out = {c: F.when(F.col(c).isin(*v) | F.col(c).isNull(), F.col(c)).otherwise(F.lit((defaults or {}).get(c))) for c, v in (allowed or {}).items()}
    out |= {c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))) for c, (lo, hi) in (ranges or {}).items()}
    return df.withColumns(out)


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks; null results break nothing."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return df.select(id_col, F.explode(broken).alias("rule"))


def map_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """value, standard form and confidence of each distinct value; unknown values stay as they are."""
    known = reduce(lambda acc, kv: F.when(normalised(F.col(column)) == kv[0].lower(), F.lit(kv[1])).otherwise(acc), mapping.items(), F.lit(None).cast("string"))
    rows = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    known = rows.select("value", "rows", F.col("value").alias(column)).withColumn("standard", known)
    return known.select("value", "rows", F.coalesce("standard", "value").alias("standard"), F.when(F.col("standard").isNotNull(), 0.9).otherwise(0.0).alias("confidence"))


def row_digest(columns) -> Column:
    """MD5 of the row's values as text, joined by |; null is empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def exact_digest(columns) -> Column:
    """SHA-256 of the row's values, each with its length, null apart from empty: equal for equal rows only."""
    cells = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*cells), 256)


def lineage_diff(old: DataFrame, new: DataFrame, key: str, columns) -> DataFrame:
    """Keys added, removed or changed between versions, by a digest that tells null from empty. Null keys match each other."""
    a, b = old.select(F.col(key).alias("_a"), exact_digest(columns).alias("a")), new.select(F.col(key).alias("_b"), exact_digest(columns).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full").select(F.coalesce("_a", "_b").alias(key), change.alias("change")).where("change is not null")


def column_digests(df: DataFrame, columns) -> DataFrame:
    """(column, digest) of each column, and of the table under the name null: order-free sums of row digests, so that the
    result doesn't depend on how rows are dealt. Empty columns have the digest of no rows."""
    part = lambda c: F.conv(F.substring(c, 1, 15), 16, 10).cast("decimal(38,0)")
    total = lambda c: F.sha2(F.coalesce(F.sum(part(c)), F.lit(0).cast("decimal(38,0)")).cast("string"), 256)
    wide = df.agg(*[total(exact_digest([c])).alias(f"d{i}") for i, c in enumerate(columns)], total(exact_digest(columns)).alias("whole"))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("digest")) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows, F.struct(F.lit(None).cast("string").alias("column"), F.col("whole").alias("digest")))))


def descending(df: DataFrame, column: str) -> Column:
    """A key that orders the column backwards: numbers and times negated, texts by negated code points."""
    kind = dict(df.dtypes)[column]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return -F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "string":
        return F.concat(F.transform(F.split(column, ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))
    return -F.col(column)


def survivor(column: str, rule: str, order_col: str, by: str | None = None, priority: dict | None = None, backwards: Column | None = None) -> Column:
    """The aggregate that picks a cluster's value; ties go to the first row by order_col, which is a number unless
    `backwards` says how it orders backwards (see descending). Nulls never survive a value."""
    first = -F.col(order_col) if backwards is None else backwards
    value = F.col(column)
    if rule == "most_recent":
        return F.max_by(column, F.when(value.isNotNull(), F.struct(F.col(by), first)))
    if rule == "most_complete":
        return F.max_by(column, F.when(value.isNotNull(), F.struct(F.length(value.cast("string")), first)))
    if rule == "source_priority":
        rank = reduce(lambda acc, kv: F.when(F.col(by) == kv[0], F.lit(kv[1])).otherwise(acc), priority.items(), F.lit(999))
        return F.min_by(column, F.when(value.isNotNull(), F.struct(rank, F.col(order_col))))
    if rule == "first":
        return F.min_by(column, F.when(value.isNotNull(), F.col(order_col)))
    if rule == "last":
        return F.max_by(column, F.when(value.isNotNull(), F.col(order_col)))
    if rule == "most_frequent":
        return F.mode(column, True)
    return {"min": F.min, "max": F.max}[rule](column)


def most_frequent(df: DataFrame, keys, column: str, order_col: str) -> DataFrame:
    """Two-level count, so that hot clusters are pre-aggregated; confidence min(0.95, 0.5 + 0.5 * share)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("at"))
    return counts.groupBy(*keys).agg(F.max_by(column, F.struct("n", -F.col("at"))).alias(column), F.round(F.least(F.lit(0.95), 0.5 + 0.5 * F.max("n") / F.sum("n")), 4).alias("confidence"))


def golden_records(df: DataFrame, match_keys, rules: dict[str, dict], order_col: str) -> DataFrame:
    """One row per cluster of equal normalised match keys: each column by its rule, and how many rows stand behind it."""
    keys = [F.coalesce(normalised(F.col(k)), F.lit("")).alias(f"key_{k}") for k in match_keys]
    picked = [survivor(c, order_col=order_col, backwards=descending(df, order_col), **how).alias(c) for c, how in rules.items()]
    conflicts = [F.when(F.count_distinct(c) > 1, F.lit({"most_complete": 0.8, "most_recent": 0.85, "source_priority": 0.9, "min": 0.9, "max": 0.9, "first": 0.75, "last": 0.75, "most_frequent": 0.8}[how["rule"]])).otherwise(1.0) for c, how in rules.items()]
    trust = reduce(lambda a, b: a + b, conflicts) / len(conflicts)
    return df.groupBy(*keys).agg(*picked, F.count(F.lit(1)).alias("source_count"), F.round(trust, 4).alias("trust_score"))


def steward_flags(df: DataFrame, rules: dict[str, Column], most: int = 5) -> DataFrame:
    """df with issues (the first few) and needs_review."""
    broken = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("issues", F.array_join(F.slice(broken, 1, most), "; ")).withColumn("needs_review", F.size(broken) > 0)


def write_back(df: DataFrame, columns, version: str, least_score: float | None = None, score_col: str | None = None) -> DataFrame:
    """Rows good enough, with a checksum (16 hex digits) and the version."""
    kept = df if score_col is None else df.where(F.col(score_col) >= least_score)
    return kept.withColumn("row_checksum", F.substring(row_digest(columns), 1, 16)).withColumn("version", F.lit(version))


def duplicate_key_groups(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def latest(df: DataFrame, keys, order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
