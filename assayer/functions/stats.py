"""Column recipes that several operators share."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


#: What a quantile sketch is asked for: its accuracy, and how far on either side of a rank a bracket reaches.
ACCURACY, REACH = 10_000, 2e-4
#: Rows of a bracket below which its values are counted one by one and reach the driver.
FEW = 20_000


def order_statistics(df: DataFrame, columns, ranks_of) -> dict[str, list]:
    """Exact values at ranks (from 0, among non-null values in order) of each column; ranks_of(n) lists those wanted of n.

    A sketch brackets every rank, one aggregate counts what lies below and inside the brackets, and wide brackets are
    sketched again, until each holds few rows; only the values inside are then counted one by one. Every pass is a scan
    with map-side sums: no task holds a column's values. Brackets are checked by their counts, so the sketch's error can
    cost a pass but not the result. Columns without values give an empty list.
    """
    names = {c: f"`{c}`" for c in columns}
    n = df.agg(*[F.count(names[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    asks = [(c, r) for i, c in enumerate(columns) if n[i] for r in ranks_of(n[i])]
    if not asks:
        return {c: [] for c in columns}
    total = {c: n[i] for i, c in enumerate(columns)}
    bracket: dict[int, tuple] = dict.fromkeys(range(len(asks)), (None, None, 0, None))  # low, high, rows below, rows inside

    def inside(i, low, high):
        x = F.col(names[asks[i][0]])
        return x.isNotNull() if low is None else x.between(F.lit(low), F.lit(high))

    open_, reach = list(bracket), dict.fromkeys(bracket, REACH)
    while open_:
        sketches = []
        for i in open_:
            c, r = asks[i]
            low, high, below, held = bracket[i]
            q = (r - below) / max(1, (total[c] if held is None else held) - 1)
            ends = [max(0.0, q - reach[i]), min(1.0, q + reach[i])]
            sketches.append(F.percentile_approx(F.when(inside(i, low, high), F.col(names[c])), ends, ACCURACY).alias(f"s{i}"))
        found = df.agg(*sketches).first()
        counts = []
        for i in open_:
            x, (low, high) = F.col(names[asks[i][0]]), found[f"s{i}"]
            counts += [F.count_if(x < F.lit(low)).alias(f"b{i}"), F.count_if(x.between(F.lit(low), F.lit(high))).alias(f"h{i}")]
        row = df.agg(*counts).first()
        still = []
        for i in open_:
            low, high = found[f"s{i}"]
            below, held = row[f"b{i}"], row[f"h{i}"]
            if below <= asks[i][1] < below + held:
                narrower = bracket[i][3] is None or held < bracket[i][3]
                bracket[i] = (low, high, below, held)
                if low != high and held > FEW and narrower:
                    still.append(i)
            elif reach[i] < 1:
                reach[i] *= 8
                still.append(i)
        open_ = still
    pick = [i for i, (low, high, _, _) in bracket.items() if low is None or low != high]
    out: dict[int, object] = {i: low for i, (low, high, _, _) in bracket.items() if i not in pick}
    by_column = {}
    for i in pick:
        by_column.setdefault(asks[i][0], []).append(i)
    for c, members in by_column.items():
        # each bracket's values with their counts, in order, up to the wanted rank
        parts = [df.where(inside(i, *bracket[i][:2])).groupBy(F.lit(i).alias("i"), F.col(names[c]).alias("x")).agg(F.count(F.lit(1)).alias("n")) for i in members]
        rows = sorted(reduce(DataFrame.unionByName, parts).orderBy("i", "x").collect(), key=lambda r: r["i"])
        at = {i: bracket[i][2] for i in members}
        for r in rows:
            if r["i"] not in out:
                at[r["i"]] += r["n"]
                if at[r["i"]] > asks[r["i"]][1]:
                    out[r["i"]] = r["x"]
    values: dict[str, list] = {c: [] for c in columns}
    for i, (c, _) in enumerate(asks):
        values[c].append(out[i])
    return values


def nearest_quantiles(df: DataFrame, columns, quantiles) -> dict[str, list]:
    """The order statistic nearest to each quantile, for all columns. None for columns without values."""
    found = order_statistics(df, columns, lambda n: [int((n - 1) * q + 0.5) for q in quantiles])
    return {c: v or [None] * len(quantiles) for c, v in found.items()}


def linear_quantiles(df: DataFrame, columns, quantiles) -> dict[str, list]:
    """Quantiles as doubles, linear between the two order statistics beside them. None for columns without values."""
    sizes: list[int] = []

    def ranks(n):
        sizes.append(n)
        return [r for q in quantiles for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))]

    found, out = order_statistics(df, columns, ranks), {}
    left = iter(sizes)
    for c in columns:
        v = found[c]
        n = next(left) if v else 0
        out[c] = [None] * len(quantiles)
        for k, q in enumerate(quantiles if v else ()):
            low, high, at = float(v[2 * k]), float(v[2 * k + 1]), q * (n - 1)
            out[c][k] = low if math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return out


def iqr_bounds(df: DataFrame, columns, multiplier: float = 1.5) -> dict[str, tuple]:
    """(low, high) fences of each column."""
    out = {}
    for c, (a, b) in nearest_quantiles(df, columns, (0.25, 0.75)).items():
        out[c] = (None, None) if a is None else (a - multiplier * (b - a), b + multiplier * (b - a))
    return out


def outside(column: Column, bounds) -> Column:
    low, high = bounds
    return F.lit(False) if low is None else F.coalesce((column < low) | (column > high), F.lit(False))


def long_form(df: DataFrame, columns) -> DataFrame:
    """(column, value) with every value as text: one row per cell, from a single scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def normalised(column: Column) -> Column:
    """Lower case without white space of any kind at the ends; null stays null."""
    return F.lower(F.regexp_replace(column.cast("string"), r"^\s+|\s+$", ""))


def stacked(wide: DataFrame, columns, fields) -> DataFrame:
    """One row per column from a single wide row whose names are column__field."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns])
    return wide.select(F.inline(rows))
