"""Readiness and governance from the data: deductions, consent, classification, compliance, and risk by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nearest_quantiles, numeric_columns, outside, string_columns
from .master import exact_digest
from .profile import pii_rates

#: Personal data inside texts; the first two decide scores, all three the rows.
INSIDE = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}
SCORED = ("email", "phone")
#: Parts of names that tell dates, sensitive fields, and the fields that each framework covers.
DATE_NAMES = ("date", "time", "created", "updated", "timestamp", "datetime")
SENSITIVE = ("email", "phone", "ssn", "social_security", "credit_card", "account_number", "password", "api_key", "token", "secret", "name", "address", "dob", "date_of_birth")
FRAMEWORKS = {
    "GDPR": ("email", "phone", "name", "address", "dob"),
    "CCPA": ("email", "phone", "name", "address", "ssn"),
    "HIPAA": ("email", "phone", "name", "ssn", "patient_id", "medical_record"),
}
MASKED = ("encrypted_email", "masked_phone")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _share(part: Column, whole: Column) -> Column:
    """Percent, 0 of nothing."""
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def _total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _severity(percent: Column, steps) -> Column:
    return reduce(lambda rest, s: F.when(percent > s[1], s[0]).otherwise(rest), reversed(steps), F.lit("low"))


def readiness(df: DataFrame, columns, weights=(0.3, 0.3, 0.4), order_col: str | None = None) -> DataFrame:
    """completeness, consistency, schema_health, weighted score and status, in one aggregate.

    consistency loses 20 / columns for each text column whose first value has a digit while not all values are numbers
    once all but digits, points and minus signs are taken out. schema_health loses 15 for a column without values, 8 for
    a name from `Unnamed` on, 5 for a text column where some but under 30 percent of the values are numbers. The first
    value is that of the least order_col (ties: the least value); without an order, the least value. Of an empty table
    completeness is 0 and no column has values; without columns there is nothing to be inconsistent.
    """
    texts = [c for c in columns if c in string_columns(df)]
    stats = [F.count(F.lit(1)).alias("n"), *[F.count(_col(c)).alias(f"c{i}") for i, c in enumerate(columns)]]
    for i, c in enumerate(texts):
        x = _col(c)
        number = F.regexp_replace(x, r"[^0-9.-]", "").try_cast("double")
        first = F.min(x) if order_col is None else F.min_by(x, F.when(x.isNotNull(), F.struct(_col(order_col), x)))
        stats += [(first.rlike("[0-9]") & (F.count(number) < F.count(x))).alias(f"mixed{i}")]
        like = F.count_if(x.rlike(r"^-?[0-9]+\.?[0-9]*\z"))
        stats += [((like > 0) & (like < 0.3 * F.count(x))).alias(f"few{i}")]
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("int")
    filled, empty = _total(F.col(f"c{i}") for i in range(len(columns))), _total((F.col(f"c{i}") == 0).cast("int") for i in range(len(columns)))
    mixed, few = _total(flag(f"mixed{i}") for i in range(len(texts))), _total(flag(f"few{i}") for i in range(len(texts)))
    unnamed = sum(c.startswith("Unnamed") for c in columns)
    least = F.lit(0.0)
    done = df.agg(*stats).select(
        _share(filled, F.col("n") * len(columns)).alias("completeness"),
        F.greatest(least, 100.0 - 20.0 * mixed / max(len(columns), 1)).alias("consistency"),
        F.greatest(least, 100.0 - 15.0 * empty - 8.0 * unnamed - 5.0 * few).alias("schema_health"),
    )
    score = weights[0] * F.col("completeness") + weights[1] * F.col("consistency") + weights[2] * F.col("schema_health")
    status = F.when(score >= 80, "ready").when(score >= 50, "needs_review").otherwise("not_ready")
    return done.select(*[F.round(c, 4).alias(c) for c in ("completeness", "consistency", "schema_health")], F.round(score, 4).alias("score"), status.alias("status"))


def readiness_deductions(df: DataFrame, columns, layouts=("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"), multiplier: float = 1.5) -> DataFrame:
    """(reason, column, percent, amount, severity) of what lowers trust in a table; the readiness score stays as it is.

    missing_values over 10 percent; format_inconsistency: texts that no layout reads, in columns named for dates;
    potential_outliers: over 5 percent of the values beyond the fences, where quartiles differ; duplicate_rows: rows
    equal to another in these columns, all copies counted, told apart by digest. An empty table has no deductions.
    """
    spread = {c: q for c, q in nearest_quantiles(df, [c for c in columns if c in numeric_columns(df)], (0.25, 0.75)).items() if q[0] is not None and q[1] > q[0]}
    dates = [c for c in columns if c in string_columns(df) and any(x in c.lower() for x in DATE_NAMES)]
    n, found = F.count(F.lit(1)), []
    for c in columns:
        percent = _share(n - F.count(_col(c)), n)
        found.append(("missing_values", c, percent, 10, 5, 25, (("critical", 80), ("high", 50), ("medium", 25))))
    for c in dates:
        read = F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(x)) for x in layouts])
        found.append(("format_inconsistency", c, _share(F.count(_col(c)) - F.count(read), F.count(_col(c))), 0, 10, 12, (("high", 25), ("medium", 10))))
    for c, (a, b) in spread.items():
        out = outside(_col(c), (a - multiplier * (b - a), b + multiplier * (b - a)))
        found.append(("potential_outliers", c, _share(F.count_if(out), F.count(_col(c))), 5, 20, 8, (("medium", 15),)))

    def rows(wide: DataFrame, found) -> DataFrame:
        cells = []
        for i, (reason, c, _, over, by, most, steps) in enumerate(found):
            p = F.col(f"p{i}")
            row = F.struct(F.lit(reason).alias("reason"), F.lit(c).cast("string").alias("column"), F.round(p, 4).alias("percent"), F.round(F.least(p / by, F.lit(float(most))), 2).alias("amount"), _severity(p, steps).alias("severity"))
            cells.append(F.when(p > over, row))
        return wide.select(F.inline(F.array_compact(F.array(*cells))))

    each = rows(df.agg(*[x[2].alias(f"p{i}") for i, x in enumerate(found)]), found)
    copies = df.groupBy(exact_digest(columns).alias("d")).agg(n.alias("k")).agg(_share(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)), F.sum("k")).alias("p0"))
    return each.unionByName(rows(copies, [("duplicate_rows", None, None, 0, 10, 15, (("high", 10), ("medium", 5)))]))


def _lineage(df: DataFrame, required) -> list[Column]:
    """What each required field takes off: 20 if missing, else up to 15 by its share of nulls above 5 percent."""
    parts = [F.lit(20.0 * sum(c not in df.columns for c in required))]
    for c in required:
        if c in df.columns:
            p = _share(F.count_if(_col(c).isNull()), F.count(F.lit(1)))
            parts.append(F.when(p > 5, F.least(F.lit(15.0), p / 10)).otherwise(0.0))
    return parts


def governance_scores(
    df: DataFrame, lineage=(), consent=(), classification=(), weights=(0.3, 0.4, 0.3), consent_col: str = "consent_status", class_col: str = "data_classification",
    allowed=("granted", "denied", "withdrawn", "pending"), compliant: float = 80, review: float = 60,
) -> DataFrame:
    """One row: lineage, consent, classification, overall score and compliance status, in one aggregate.

    consent loses 25 per missing field and 15 if any status is not allowed (null is); classification loses 20 per
    missing field and 20 if a row labelled public holds personal data: in each text column, of the first kind that any
    row of it holds. An empty table loses only for missing fields.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    off_consent = F.lit(25.0 * sum(c not in df.columns for c in consent))
    if consent_col in df.columns:
        off_consent += F.when(some(~_col(consent_col).isin(*allowed)), 15.0).otherwise(0.0)
    off_class = F.lit(20.0 * sum(c not in df.columns for c in classification))
    if class_col in df.columns:
        hits = [F.lit(False)]
        for c in string_columns(df):
            kinds = [(some(_col(c).rlike(INSIDE[k])), some(_col(c).rlike(INSIDE[k]) & (_col(class_col) == "public"))) for k in SCORED]
            hits.append(reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(kinds), F.lit(False)))
        off_class += F.when(reduce(lambda a, b: a | b, hits), 20.0).otherwise(0.0)
    score = lambda off: F.greatest(F.lit(0.0), 100.0 - off)
    wide = df.agg(F.count(F.lit(1)).alias("rows"), score(_total(_lineage(df, lineage))).alias("lineage"), score(off_consent).alias("consent"), score(off_class).alias("classification"))
    overall = weights[0] * F.col("lineage") + weights[1] * F.col("consent") + weights[2] * F.col("classification")
    status = F.when(overall >= compliant, "compliant").when(overall >= review, "needs_review").otherwise("non_compliant")
    return wide.select("rows", *[F.round(c, 4).alias(c) for c in ("lineage", "consent", "classification")], F.round(overall, 4).alias("overall"), status.alias("status"))


def public_pii(df: DataFrame, id_cols, class_col: str = "data_classification") -> DataFrame:
    """(id, column, pii_type) of texts with personal data in rows that are unlabelled or public. A column's type is the
    first kind that any of its rows holds, found by one aggregate of which one row of flags reaches the driver."""
    texts = string_columns(df)
    flags = [F.bool_or(_col(c).rlike(p)).alias(f"{i}_{k}") for i, c in enumerate(texts) for k, p in INSIDE.items()]
    row = df.agg(F.count(F.lit(1)).alias("n"), *flags).first()
    kind = {c: next((k for k in INSIDE if row[f"{i}_{k}"]), None) for i, c in enumerate(texts)}
    open_ = _col(class_col).isNull() | (_col(class_col) == "public")
    none = F.lit(None).cast("struct<column:string,pii_type:string>")
    cells = [F.when(_col(c).rlike(INSIDE[k]), F.struct(F.lit(c).alias("column"), F.lit(k).alias("pii_type"))) for c, k in kind.items() if k]
    return df.where(open_).select(*id_cols, F.inline(F.array_compact(F.array(none, *cells))))


def missing_required(df: DataFrame, id_cols, lineage=(), consent=(), classification=()) -> DataFrame:
    """(id, category, issue, severity, missing) of rows with a null in a required field that the table has. Of several
    categories lineage comes first, then consent; missing lists the fields, comma-joined, in the order given."""
    have = {k: [c for c in v if c in df.columns] for k, v in (("lineage", lineage), ("consent", consent), ("classification", classification))}
    fields = [c for v in have.values() for c in v]
    if not fields:
        return df.limit(0).select(*id_cols, *[F.lit("").alias(c) for c in ("category", "issue", "severity", "missing")])
    gaps = lambda names: reduce(lambda a, b: a | b, [_col(c).isNull() for c in names], F.lit(False))
    category = F.when(gaps(have["lineage"]), "lineage").when(gaps(have["consent"]), "consent").otherwise("classification")
    bad = df.where(gaps(fields)).select(*id_cols, category.alias("category"), F.concat_ws(",", *[F.when(_col(c).isNull(), F.lit(c)) for c in fields]).alias("missing"))
    grave = F.col("category") == "consent"
    return bad.select(*id_cols, "category", F.when(grave, "compliance_issue").otherwise("policy_violation").alias("issue"), F.when(grave, "critical").otherwise("warning").alias("severity"), "missing")


def field_risks(df: DataFrame, columns, high: float = 70, medium: float = 40) -> DataFrame:
    """One row per column: pii_type, sensitive by name, score, level, gap, frameworks and effort.

    80 where over half of all values (not of a sample) match a pattern; 75 where the column is called email and over 70
    percent hold an @; 60 where only the name is sensitive; else 0. Columns without values go by their names.
    """
    rates = pii_rates(df, columns).select(F.col("column").alias("_c"), "pii_type")
    at = [c for c in columns if c.lower() in ("email", "email_address")]
    mails = df.agg(F.count(F.lit(1)).alias("n"), *[(F.count_if(F.contains(_col(c).cast("string"), F.lit("@"))) > 0.7 * F.count(_col(c))).alias(f"m{i}") for i, c in enumerate(at)])
    names = []
    for c in columns:
        low = c.lower()
        sensitive = any(k in low for k in SENSITIVE)
        mail = F.col(f"m{at.index(c)}") if c in at else F.lit(False)
        under = ",".join(f for f, keys in FRAMEWORKS.items() if any(k in low for k in keys))
        names.append(F.struct(F.lit(c).alias("column"), F.lit(sensitive).alias("sensitive"), F.lit(under).alias("under"), F.lit(low in MASKED).alias("masked"), mail.alias("mail")))
    # a row per column, so bounded by the schema
    fields = mails.select(F.inline(F.array(*names)))
    both = fields.join(rates, F.col("column") == F.col("_c"), "left").drop("_c").withColumn("found", F.col("pii_type").isNotNull())
    both = both.withColumn("pii_type", F.coalesce("pii_type", F.when(F.col("mail"), F.lit("email"))))
    score = F.when(F.col("found"), 80).when(F.col("mail"), 75).when(F.col("sensitive"), 60).otherwise(0).cast("long")
    known = F.col("pii_type").isNotNull()
    return both.withColumn("score", score).select(
        "column", "pii_type", "sensitive", "score",
        F.when(F.col("score") >= high, "high").when(F.col("score") >= medium, "medium").otherwise("low").alias("level"),
        ((F.col("score") > 0) & ~F.col("masked")).alias("gap"),
        F.when(known | F.col("sensitive"), F.col("under")).otherwise("").alias("frameworks"),
        F.when(known, "high").when(F.col("sensitive"), "medium").otherwise("low").alias("effort"),
    )


def overall_risk(fields: DataFrame, high: float = 70, medium: float = 40) -> DataFrame:
    """One row over field_risks: mean score (0 without fields) and its level, fields by level, gaps, hours to mend (two a
    high field, one a medium one, one a further gap) and the frameworks concerned."""
    wide = fields.agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("m"), F.count_if(F.col("level") == "high").alias("high_fields"), F.count_if(F.col("level") == "medium").alias("medium_fields"), F.count_if("gap").alias("gaps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("frameworks", ","))))).alias("f"),
    )
    level = F.when(F.col("m") >= high, "high").when(F.col("m") >= medium, "medium").otherwise("low")
    hours = 2 * F.col("high_fields") + F.col("medium_fields") + F.greatest(F.lit(0), F.col("gaps") - F.col("high_fields") - F.col("medium_fields"))
    return wide.select(F.round("m", 2).alias("score"), level.alias("level"), "high_fields", "medium_fields", "gaps", hours.alias("hours"), F.concat_ws(",", F.filter("f", lambda x: x != "")).alias("frameworks"))
