"""Cleaning: quarantine, nulls, outliers, types, duplicates, standard forms, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import iqr_bounds, linear_quantiles, nearest_quantiles, normalised, outside

#: Texts that mean null, and date layouts tried in this order.
NULL_TOKENS = ("NULL", "null", "NaN", "nan", "None", "none", "N/A", "n/a", "", " ", "?", "-", "missing", "MISSING", "undefined", "UNDEFINED")
DATE_LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MMM-yy", "dd-MMM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy")
#: Layouts of the date standard form, tried in this order.
STANDARD_LAYOUTS = ("dd-MM-yyyy", "dd-MMM-yy", "dd-MMM-yyyy", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "dd MMM yyyy", "dd MMMM yyyy")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with _reasons: the names of the rules that a row breaks. Clean rows have none; one pass, no join."""
    marks = F.filter(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("_reasons", marks)


def trimmed(column: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def null_tokens(df: DataFrame, columns, tokens=NULL_TOKENS) -> DataFrame:
    """Text columns with null where the text, white space at its ends aside, is one of tokens; letter case counts."""
    return df.withColumns({c: F.when(trimmed(F.col(c)).isin(*tokens), None).otherwise(F.col(c)) for c in columns})


def null_patterns(df: DataFrame, columns) -> DataFrame:
    """How many rows have each combination of nulls, spelled as a bit string."""
    return df.groupBy(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))


def fill(df: DataFrame, column: str, strategy: str, value=None) -> DataFrame:
    """Nulls replaced by the column's mean, median or mode (the smallest if tied), or by a constant."""
    if strategy != "constant":
        if strategy == "median":
            value = linear_quantiles(df, [column], [0.5])[column][0]
        else:
            value = df.agg({"mean": F.avg(column), "mode": F.mode(column, True)}[strategy]).first()[0]
    return df if value is None else df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def carry(df: DataFrame, column: str, group, order, backward: bool = False) -> DataFrame:
    """Forward or backward fill in order within groups; groups keep it distributed."""
    w = W.partitionBy(*group).orderBy(*order)
    filled = F.first(column, True).over(w.rowsBetween(0, W.unboundedFollowing)) if backward else F.last(column, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(column, filled)


def convert_units(column: Column, units: dict[str, tuple[str, float]], places: int = 4) -> Column:
    """The whole text replaced by "number unit" where a number stands before a unit that units (from -> to, factor)
    names, letter case aside; the first unit that fits counts. Other texts and nulls stay."""
    out = column
    for name, (to, factor) in reversed(units.items()):
        pattern = rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*\Q{name}\E(?![A-Za-z0-9_])"
        number = F.round(F.regexp_extract(column, pattern, 1).try_cast("double") * factor, places)
        out = F.when(column.rlike(pattern), F.concat_ws(" ", number.cast("string"), F.lit(to))).otherwise(out)
    return out


def bounds_of(df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5, z: float = 3.0, percentiles=(0.01, 0.99)) -> tuple:
    if method == "iqr":
        return iqr_bounds(df, [column], multiplier)[column]
    if method == "z_score":
        m = df.agg(F.avg(column), F.stddev_samp(column)).first()
        return (None, None) if m[1] is None else (m[0] - z * m[1], m[0] + z * m[1])
    return tuple(nearest_quantiles(df, [column], percentiles)[column])


def treat_outliers(df: DataFrame, column: str, method: str = "iqr", strategy: str = "remove") -> DataFrame:
    """All outliers removed, or replaced by the column's mean or median."""
    bad = outside(F.col(column), bounds_of(df, column, method))
    if strategy == "remove":
        return df.where(~bad)
    value = df.agg(F.avg(column)).first()[0] if strategy == "impute_mean" else linear_quantiles(df, [column], [0.5])[column][0]
    return df.withColumn(column, F.when(bad, F.lit(value)).otherwise(F.col(column)))


def infer_types(df: DataFrame, columns, least: float = 0.7) -> DataFrame:
    """What text columns hold, by the share of values that read as number or date."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    long = df.select(F.inline(cells)).where("value is not null")
    number, date = F.avg(F.col("value").rlike(r"^-?\d+(\.\d+)?$").cast("int")), F.avg(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}").cast("int"))
    return long.groupBy("column").agg(F.when(number > least, "numeric").when(date > least, "datetime").otherwise("string").alias("inferred"))


def parse_date(column: Column, layouts=DATE_LAYOUTS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(x)).cast("date") for x in layouts])


def standard_date(column: Column, target: str = "yyyy-MM-dd", layouts=STANDARD_LAYOUTS) -> Column:
    """A date's text in the target layout; texts that no layout reads stay as they are, empty ones become null."""
    text = trimmed(column)
    read = F.coalesce(*[F.try_to_timestamp(text, F.lit(x)) for x in layouts])
    return F.when(text != "", F.coalesce(F.date_format(read, target), text))


def likely_date(df: DataFrame, column: str, order_col: str, most: int = 50, least: float = 0.5) -> DataFrame:
    """Whether over half of the first non-empty texts, by order_col, read as dates; false without any."""
    some = df.where(trimmed(F.col(column)) != "").orderBy(order_col).limit(most)
    reads = F.coalesce(*[F.try_to_timestamp(trimmed(F.col(column)), F.lit(x)) for x in STANDARD_LAYOUTS]).isNotNull()
    return some.agg(F.count(F.lit(1)).alias("sampled"), F.count_if(reads).alias("dates")).withColumn("likely", F.coalesce(F.col("dates") > least * F.col("sampled"), F.lit(False)))


def fix_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to numeric, integer, boolean, date, datetime or string; what can't be read becomes null."""
    date = lambda c: F.coalesce(*[F.try_to_timestamp(trimmed(F.col(c).cast("string")), F.lit(x)) for x in DATE_LAYOUTS])
    how = {
        "numeric": lambda c: F.col(c).try_cast("double"),
        "integer": lambda c: F.col(c).try_cast("bigint"),
        "boolean": lambda c: F.col(c).try_cast("boolean"),
        "date": lambda c: date(c).cast("date"),
        "datetime": date,
        "string": lambda c: F.col(c).cast("string"),
    }
    return df.withColumns({c: how[t](c) for c, t in types.items()})


def duplicate_any(df: DataFrame, kinds: dict[str, tuple]) -> DataFrame:
    """df with _kinds: the names of the duplicate kinds (columns, loose) by which a row has copies, none if it has none."""
    counted = {f"_n{i}": F.count(F.lit(1)).over(W.partitionBy(*[normalised(F.col(c)) if loose else F.col(c) for c in columns])) for i, (columns, loose) in enumerate(kinds.values())}
    marks = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 1, F.lit(k)) for i, k in enumerate(kinds)]))
    return df.withColumns(counted).withColumn("_kinds", marks).drop(*counted)


def duplicate_rows(df: DataFrame, columns, loose: bool = False) -> DataFrame:
    """Every copy of rows that agree on columns, nulls equal; loose: by lower-cased, trimmed text."""
    keys = [normalised(F.col(c)) if loose else F.col(c) for c in columns]
    return df.withColumn("_copies", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("_copies > 1").drop("_copies")


def conflicting_keys(df: DataFrame, keys, others) -> DataFrame:
    """Keys whose rows differ in another column; null differs from a value."""
    kinds = [F.count_distinct(c) + F.max(F.col(c).isNull().cast("long")) > 1 for c in others]
    grouped = df.groupBy(*[normalised(F.col(k)).alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("rows"), reduce(lambda a, b: a | b, kinds).alias("_differs"))
    return grouped.where("_differs and rows > 1").drop("_differs")


def keep_first(df: DataFrame, keys, order_col: str) -> DataFrame:
    """The first row of each normalised key: a hash aggregate over whole rows, no window."""
    row = F.struct(*df.columns)
    return df.groupBy(*[normalised(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, order_col).alias("_row")).select("_row.*")


def merge_smart(df: DataFrame, keys, order_col: str) -> DataFrame:
    """One row per normalised key: of each column the first non-null value."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in df.columns]
    return df.groupBy(*[normalised(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*firsts).select(*df.columns)


def standardise(df: DataFrame, columns, case: str = "lowercase", synonyms: dict[str, str] | None = None) -> DataFrame:
    """Trim, collapse white space, fold case, then replace synonyms, whose own case stays. A value is looked up once: the
    first synonym that fits counts, and what it gives is not looked up again. Null stays null."""
    fold = {"lowercase": F.lower, "uppercase": F.upper, "titlecase": F.initcap}.get(case, lambda c: c)
    out = {}
    for c in columns:
        x = fold(F.trim(F.regexp_replace(c, r"\s+", " ")))
        out[c] = reduce(lambda rest, kv: F.when(F.lower(x) == kv[0].lower(), F.lit(kv[1])).otherwise(rest), reversed((synonyms or {}).items()), x)
    return df.withColumns(out)


def variations(df: DataFrame, column: str) -> DataFrame:
    """Normalised values written in more than one way."""
    return df.groupBy(normalised(F.col(column)).alias("normal")).agg(F.count_distinct(column).alias("spellings"), F.count(F.lit(1)).alias("rows")).where("spellings > 1")


def integrity(df: DataFrame, keys, numeric) -> DataFrame:
    """Checks before writing back: non-finite numbers, nulls, duplicate keys."""
    bad = reduce(lambda a, b: a + b, [F.sum((F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).cast("long")) for c in numeric])
    nulls = reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(bad, F.lit(0)).alias("non_finite"), nulls.alias("nulls"), (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("duplicates"))


def preview_impact(df: DataFrame, rules: dict[str, DataFrame]) -> DataFrame:
    """Each rule's result against the original: rows lost and the impact class."""
    before = df.agg(F.count(F.lit(1)).alias("before"))
    parts = [r.agg(F.count(F.lit(1)).alias("after")).join(F.broadcast(before)).select(F.lit(k).alias("rule"), "before", "after") for k, r in rules.items()]
    # an empty table changes by nothing
    pct = F.coalesce(F.try_divide(100.0 * (F.col("after") - F.col("before")), F.col("before")), F.lit(0.0))
    impact = F.when(F.abs(pct) >= 10, "high").when(F.abs(pct) >= 5, "medium").otherwise("low")
    return reduce(DataFrame.unionByName, parts).withColumn("change_pct", F.round(pct, 4)).withColumn("impact", impact)
