"""Contracts and business rules compiled to column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import fix_types


def business_rule(condition: dict) -> Column:
    """{column, operator, value} as a condition that is true where the rule is met: eq, ne and contains compare texts, gt and lt
    numbers. A null is the text "None" for ne and never equals, contains, exceeds or falls short; what is no number neither."""
    c, op, value = F.col(condition["column"]), condition["operator"], condition["value"]
    text, number = F.coalesce(c.cast("string"), F.lit("None")), c.cast("string").try_cast("double")
    how = {
        "eq": lambda: text == str(value),
        "ne": lambda: text != str(value),
        "gt": lambda: number > float(value),
        "lt": lambda: number < float(value),
        "contains": lambda: F.contains(text, F.lit(str(value))),
    }
    if op not in how:
        raise ValueError(f"no operator {op}")
    return F.coalesce(how[op](), F.lit(False))


def uncastable(column: Column, kind: str = "double") -> Column:
    """Whether a value that is neither null nor empty can't be read as kind."""
    text = F.trim(column.cast("string"))
    return F.coalesce((text != "") & text.try_cast(kind).isNull(), F.lit(False))


def enforce_contract(df: DataFrame, contract: dict) -> DataFrame:
    """df as the contract wants it. contract: {"rename": {old: new}, "columns": {name: {"type", "default", "required",
    "allowed", "min", "max", "pattern"}}, "drop_extra": bool}.

    In order: rename; add missing columns with their default (null without one); drop columns the contract doesn't name;
    cast, what can't be read becoming null; values not allowed become the default or null; numbers are capped to min..max;
    texts that break the pattern become null; nulls of required columns take the default. All in projections, no shuffle.
    """
    out = df.withColumnsRenamed({a: b for a, b in contract.get("rename", {}).items() if a in df.columns})
    columns = contract["columns"]
    out = out.withColumns({c: F.lit(r.get("default")) for c, r in columns.items() if c not in out.columns})
    if contract.get("drop_extra", True):
        out = out.select(*[f"`{c}`" for c in out.columns if c in columns])
    out = fix_types(out, {c: r["type"] for c, r in columns.items() if "type" in r})
    fixed = {}
    for c, r in columns.items():
        x, default = F.col(c), F.lit(r.get("default"))
        if "allowed" in r:
            x = F.when(x.isin(*r["allowed"]) | x.isNull(), x).otherwise(default)
        if "min" in r:
            x = F.when(x.isNotNull(), F.greatest(x, F.lit(r["min"])))
        if "max" in r:
            x = F.when(x.isNotNull(), F.least(x, F.lit(r["max"])))
        if "pattern" in r:
            x = F.when(x.rlike(r["pattern"]), x)
        if r.get("required") and r.get("default") is not None:
            x = F.coalesce(x, default)
        fixed[c] = x
    return out.withColumns(fixed)


def contract_report(df: DataFrame, contract: dict) -> DataFrame:
    """(column, check, rows) of what a table breaks before it is enforced: missing and extra columns count once, others the
    rows; checks that nothing breaks are left out."""
    columns = contract["columns"]
    marks = [(c, "missing", F.lit(1)) for c in columns if c not in df.columns] + [(c, "extra", F.lit(1)) for c in df.columns if c not in columns]
    read = {"numeric": "double", "integer": "bigint", "boolean": "boolean"}
    for c, r in columns.items():
        if c in df.columns:
            x = F.col(c)
            tests = {"required": x.isNull() if r.get("required") else None}
            tests["type"] = uncastable(x, read[r["type"]]) if r.get("type") in read else None
            tests["allowed"] = x.isNotNull() & ~x.isin(*r["allowed"]) if "allowed" in r else None
            tests["range"] = (x < F.lit(r.get("min", float("-inf")))) | (x > F.lit(r.get("max", float("inf")))) if "min" in r or "max" in r else None
            tests["pattern"] = ~x.rlike(r["pattern"]) if "pattern" in r else None
            marks += [(c, k, F.count_if(t)) for k, t in tests.items() if t is not None]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[m.cast("long").alias(f"m{i}") for i, (_, _, m) in enumerate(marks)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"m{i}").alias("rows")) for i, (c, k, _) in enumerate(marks)])
    return wide.select(F.inline(rows)).where("rows > 0")


def quarantine_rules(contract: dict, numeric_fences: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """The six detectors as named conditions for quarantine: missing required values, uncastable values, malformed texts,
    values not allowed, numbers beyond the fences, and texts that look like code."""
    rules: dict[str, Column] = {}
    for c, r in contract["columns"].items():
        x = F.col(c)
        if r.get("required"):
            rules[f"MISSING:{c}"] = x.isNull() | (F.trim(x.cast("string")) == "")
        if r.get("type") in ("numeric", "integer"):
            rules[f"TYPE:{c}"] = uncastable(x)
        if "pattern" in r:
            rules[f"FORMAT:{c}"] = x.isNotNull() & ~x.rlike(r["pattern"])
        if "allowed" in r:
            rules[f"VALUE:{c}"] = x.isNotNull() & ~x.isin(*r["allowed"])
        if r.get("type") == "string":
            rules[f"SUSPICIOUS:{c}"] = x.rlike(r"(?i)(<script|drop\s+table|union\s+select|javascript:)")
    for c, (low, high) in (numeric_fences or {}).items():
        rules[f"RANGE:{c}"] = ~F.col(c).between(low, high)
    return rules


def rename_drop(df: DataFrame, rename: dict[str, str] | None = None, drop=()) -> DataFrame:
    """Columns renamed and dropped; names that the table lacks don't matter."""
    return df.drop(*drop).withColumnsRenamed(rename or {})


def null_heavy(df: DataFrame, most: float = 0.5) -> list[str]:
    """Columns whose share of nulls exceeds `most`: one aggregate, one row to the driver; none of an empty table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row["n"] and 1 - row[f"c{i}"] / row["n"] > most]


def combined(rules: dict[str, Column]) -> Column:
    """Whether any rule holds."""
    return reduce(lambda a, b: a | b, rules.values(), F.lit(False))
