"""Registered queries over the relational tables, each beside the SQL that must give the same rows.

The tables hold no dirt, so queries that need it make it by an expression that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze as an
from ..operators import clean as cl
from ..operators import drift as dr
from ..operators import master as ma
from ..operators import profile as pr

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
CUT = "1998-01-01"


def case(name: str, sql: str | None = None):
    def put(f):
        CASES[name] = (f, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in CASES.items() if s}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")
    return o.where(before), o.where(~before)


def dirty_orders(spark, sf_dir):
    """Every 7th price missing, every 11th order a repeated customer's number as text with spaces."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 11 == 0, F.lit(" N/A ")).otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", "o_custkey", price.alias("price"), status.alias("status"), "o_orderdate", "o_orderpriority")


#: The same dirt in SQL.
DIRTY = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
 CASE WHEN o_orderkey % 11 = 0 THEN ' N/A ' ELSE o_orderstatus END AS status, o_orderdate, o_orderpriority FROM orders"""
LINE = ("l_quantity", "l_extendedprice", "l_discount")


def _q(c: str, t: str, q: float) -> str:
    return f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL) WHERE r = floor((n - 1) * {q} + 0.5))"


def _fences(c: str, t: str) -> str:
    a, b = _q(c, t, 0.25), _q(c, t, 0.75)
    return f"(SELECT {a} - 1.5 * ({b} - {a}) AS lo, {b} + 1.5 * ({b} - {a}) AS hi)"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


# --- profiling ---
@case(
    "profile_numeric",
    _union(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 4) AS mean,
 round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) AS var,
 round(avg(pow({c} - m, 3)) / pow(any_value(s), 3), 4) AS skew, round(avg(pow({c} - m, 4)) / pow(any_value(s), 4) - 3, 4) AS kurtosis,
 any_value(p25)::DOUBLE AS p25, any_value(p50)::DOUBLE AS p50, any_value(p75)::DOUBLE AS p75,
 count(*) FILTER ({c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)) AS outliers
 FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem),
 (SELECT {_q(c, 'lineitem', .25)} AS p25, {_q(c, 'lineitem', .5)} AS p50, {_q(c, 'lineitem', .75)} AS p75)"""
        for c in LINE
    ),
)
def _(s, d):
    return pr.numeric_profile(table(s, d, "lineitem"), LINE)


PART_TEXT = ("p_name", "p_brand", "p_type")


@case(
    "profile_string",
    _union(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min(strlen({c})) AS min_length, max(strlen({c})) AS max_length,
 round(avg(strlen({c})), 4) AS avg_length, count(*) FILTER (regexp_matches({c}, '[^a-zA-Z0-9\\s]')) AS special FROM part"""
        for c in PART_TEXT
    ),
)
def _(s, d):
    return pr.string_profile(table(s, d, "part"), PART_TEXT)


FREQ = _union(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count FROM part GROUP BY {c}""" for c in PART_TEXT)


@case("profile_top_values", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value)::INTEGER AS rank FROM ({FREQ})) WHERE rank <= 10""")
def _(s, d):
    return pr.top_values(table(s, d, "part"), PART_TEXT)


@case("profile_entropy", f"""SELECT "column", round(ln(sum(count)) - sum(count * ln(count)) / sum(count), 4) AS entropy FROM ({FREQ}) GROUP BY 1""")
def _(s, d):
    return pr.entropy(table(s, d, "part"), PART_TEXT)


@case(
    "profile_quality_grade",
    "SELECT *, CASE WHEN quality >= 90 THEN 'A' WHEN quality >= 80 THEN 'B' WHEN quality >= 70 THEN 'C' WHEN quality >= 60 THEN 'D' ELSE 'F' END AS grade FROM ("
    + _union(
        f"""SELECT '{c}' AS "column", round(100.0 * count({c}) / count(*), 4) AS completeness, round(100.0 - least(20.0, 100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count(*)), 4) AS validity,
 CASE WHEN count(DISTINCT {c}) > 1 THEN 100.0::DOUBLE ELSE 50.0 END AS consistency,
 round((100.0 * count({c}) / count(*) + 100.0 - least(20.0, 100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count(*)) + CASE WHEN count(DISTINCT {c}) > 1 THEN 100 ELSE 50 END) / 3, 4) AS quality
 FROM lineitem, {_fences(c, 'lineitem')}"""
        for c in LINE
    )
    + ")",
)
def _(s, d):
    return pr.quality_grade(table(s, d, "lineitem"), LINE)


@case("profile_zscore_issues", "SELECT l_orderkey, l_linenumber, 'distribution_anomaly' AS issue, l_extendedprice AS value FROM lineitem, (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM lineitem) WHERE abs((l_extendedprice - m) / s) > 1.7")
def _(s, d):
    return pr.zscore_issues(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice", 1.7)


@case("profile_iqr_issues", f"SELECT event_id, 'outlier' AS issue, value FROM events, {_fences('value', 'events')} WHERE value < lo OR value > hi")
def _(s, d):
    return pr.iqr_issues(table(s, d, "events"), ["event_id"], "value")


@case(
    "profile_pii",
    _union(
        f"""SELECT '{c}' AS "column", count({c}) AS "values", count(*) FILTER (regexp_matches({c}, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$')) AS email,
 count(*) FILTER (regexp_matches({c}, '^[\\d\\s\\-\\(\\)\\+]{{10,}}$')) AS phone, count(*) FILTER (regexp_matches({c}, '^\\d{{3}}-\\d{{2}}-\\d{{4}}$')) AS ssn, count(*) FILTER (regexp_matches({c}, '^\\d{{4}}[\\s\\-]?\\d{{4}}[\\s\\-]?\\d{{4}}[\\s\\-]?\\d{{4}}$')) AS card, count(*) FILTER (regexp_matches({c}, '^\\d{{5}}(-\\d{{4}})?$')) AS zip,
 {"'phone'" if c == 'contact' else 'NULL'} AS pii_type, {80 if c == 'contact' else 0}::BIGINT AS risk FROM (SELECT c_name, '+1-555-' || lpad(c_custkey::VARCHAR, 7, '0') AS contact FROM customer)"""
        for c in ("c_name", "contact")
    ),
)
def _(s, d):
    c = table(s, d, "customer").select("c_name", F.concat(F.lit("+1-555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("contact"))
    return pr.pii_rates(c, ["c_name", "contact"])


@case("governance_lineage", f"SELECT round(100.0 - 20 - CASE WHEN p > 5 THEN least(15.0, p / 10) ELSE 0 END, 4) AS score FROM (SELECT 100.0 * (count(*) - count(price)) / count(*) AS p FROM ({DIRTY}))")
def _(s, d):
    return pr.lineage_score(dirty_orders(s, d), ["o_orderkey", "price", "owner"])


@case("governance_consent", "SELECT event_id, event_type AS value FROM events WHERE event_type IS NOT NULL AND lower(event_type) NOT IN ('click', 'view')")
def _(s, d):
    return pr.consent_issues(table(s, d, "events"), ["event_id"], "event_type", ("click", "view"))


COVER = ("l_orderkey", "l_extendedprice")


@case("coverage_uniqueness", _union(f"""SELECT '{c}' AS "column", coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicates, round(100.0 - least(25.0, 100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n)), 4) AS score FROM (SELECT count(*) n FROM lineitem GROUP BY {c})""" for c in COVER))
def _(s, d):
    return pr.uniqueness_coverage(table(s, d, "lineitem"), COVER)


@case(
    "coverage_rules",
    _union(f"""SELECT '{k}' AS "column", count(*) FILTER (NOT ({w})) AS violations, round(100.0 - least(20.0, 100.0 * count(*) FILTER (NOT ({w})) / count(*)), 4) AS score FROM lineitem""" for k, w in {"range": "l_quantity BETWEEN 1 AND 45", "flag": "l_returnflag IN ('A', 'R')"}.items()),
)
def _(s, d):
    return pr.rule_coverage(table(s, d, "lineitem"), {"range": F.col("l_quantity").between(1, 45), "flag": F.col("l_returnflag").isin("A", "R")})


# --- drift ---
B, C = f"(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}')", f"(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}')"


@case(
    "drift_psi_categorical",
    f"""WITH t AS (SELECT coalesce(b.v, c.v) v, coalesce(b.n, 0) b, coalesce(c.n, 0) c FROM (SELECT o_orderpriority v, count(*) n FROM {B} GROUP BY 1) b FULL JOIN (SELECT o_orderpriority v, count(*) n FROM {C} GROUP BY 1) c ON b.v = c.v),
 u AS (SELECT CASE WHEN b = 0 THEN 1e-4 ELSE b / (SELECT sum(b) FROM t) END x, CASE WHEN c = 0 THEN 1e-4 ELSE c / (SELECT sum(c) FROM t) END y FROM t)
 SELECT round(abs(sum((y - x) * ln(y / x))), 4) AS psi, round(abs(sum((y - x) * ln(y / x))), 4) > 0.1 AS drift FROM u""",
)
def _(s, d):
    return dr.psi_categorical(*halves(s, d), "o_orderpriority")


def _bins(src: str, lo: str, hi: str) -> str:
    return f"(SELECT least(9, floor((o_totalprice - {lo}) / (({hi} - {lo}) / 10)))::INTEGER bin, count(*) n FROM {src}, r WHERE o_totalprice BETWEEN {lo} AND {hi} GROUP BY 1)"


@case(
    "drift_psi_numeric",
    f"""WITH r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, count(*) nb, (SELECT count(*) FROM {C}) nc FROM {B}), b AS {_bins(B, 'lo', 'hi')}, c AS {_bins(C, 'lo', 'hi')},
 u AS (SELECT CASE WHEN coalesce(b.n, 0) = 0 THEN 1e-4 ELSE b.n / nb END x, CASE WHEN coalesce(c.n, 0) = 0 THEN 1e-4 ELSE c.n / nc END y FROM range(10) k(bin) LEFT JOIN b ON b.bin = k.bin LEFT JOIN c ON c.bin = k.bin, r)
 SELECT round(abs(sum((y - x) * ln(y / x))), 4) AS psi, round(abs(sum((y - x) * ln(y / x))), 4) > 0.1 AS drift FROM u""",
)
def _(s, d):
    return dr.psi_numeric(*halves(s, d), "o_totalprice")


@case(
    "drift_js",
    f"""WITH r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, count(*) FILTER (o_orderdate < TIMESTAMP '{CUT}') nb, count(*) FILTER (o_orderdate >= TIMESTAMP '{CUT}') nc FROM orders), b AS {_bins(B, 'lo', 'hi')}, c AS {_bins(C, 'lo', 'hi')},
 u AS (SELECT coalesce(b.n, 0) / nb x, coalesce(c.n, 0) / nc y FROM b FULL JOIN c ON b.bin = c.bin, r)
 SELECT round(sqrt(0.5 * sum(CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0 END)), 4) AS js_distance FROM u""",
)
def _(s, d):
    return dr.js_distance(*halves(s, d), "o_totalprice")


@case(
    "drift_ks_wasserstein",
    f"""WITH t AS (SELECT o_totalprice v, count(*) FILTER (o_orderdate < TIMESTAMP '{CUT}') b, count(*) FILTER (o_orderdate >= TIMESTAMP '{CUT}') c FROM orders GROUP BY 1),
 u AS (SELECT v, abs(sum(b) OVER (ORDER BY v) / (SELECT sum(b) FROM t) - sum(c) OVER (ORDER BY v) / (SELECT sum(c) FROM t)) g, lead(v) OVER (ORDER BY v) - v w FROM t)
 SELECT round(max(g), 6) AS ks, round(sum(g * w), 4) AS wasserstein FROM u""",
)
def _(s, d):
    return dr.ecdf_distances(*halves(s, d), "o_totalprice")


@case("drift_new_categories", f"SELECT o_custkey AS value, count(*) AS count FROM {C} WHERE o_custkey NOT IN (SELECT o_custkey FROM {B}) GROUP BY 1")
def _(s, d):
    return dr.new_categories(*halves(s, d), "o_custkey")


@case("drift_zscore_rows", f"SELECT o_orderkey, o_totalprice FROM {C}, (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM {B}) WHERE abs((o_totalprice - m) / s) > 1.7")
def _(s, d):
    return dr.zscore_rows(*halves(s, d), "o_orderkey", "o_totalprice", 1.7)


@case("drift_schema", """SELECT * FROM (VALUES ('o_totalprice', 'column_removed'), ('o_orderstatus', 'column_removed'), ('price', 'column_added'), ('status', 'column_added')) t("column", change)""")
def _(s, d):
    return dr.schema_changes(table(s, d, "orders"), dirty_orders(s, d))


# --- cleaning ---
QUAR = {"missing_price": "price IS NULL", "bad_status": "trim(status) NOT IN ('O', 'F', 'P')", "late": "o_orderdate > TIMESTAMP '2001-01-01'"}


def quarantined(s, d):
    return cl.quarantine(dirty_orders(s, d), {k: F.expr(v.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")) for k, v in QUAR.items()})


WHY = "concat_ws(';', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in QUAR.items()) + ")"


@case("quarantine_reasons", f"SELECT o_orderkey, {WHY} AS reasons FROM ({DIRTY}) WHERE {WHY} <> ''")
def _(s, d):
    return quarantined(s, d).where(F.size("_reasons") > 0).select("o_orderkey", F.array_join("_reasons", ";").alias("reasons"))


@case("quarantine_clean", f"SELECT o_orderkey, price, status FROM ({DIRTY}) WHERE {WHY} = ''")
def _(s, d):
    return quarantined(s, d).where(F.size("_reasons") == 0).select("o_orderkey", "price", "status")


@case("quarantine_suspicious", "SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)(<script|drop\\s+table|union\\s+select|javascript:)')")
def _(s, d):
    return cl.quarantine(table(s, d, "pages"), {"script": F.col("html").rlike(r"(?i)(<script|drop\s+table|union\s+select|javascript:)")}).where(F.size("_reasons") > 0).select("page_id")


@case("null_tokens", f"SELECT o_orderkey, CASE WHEN trim(status) IN ('NULL', 'null', 'NaN', 'nan', 'None', 'none', 'N/A', 'n/a', '', ' ', '?', '-', 'missing', 'MISSING', 'undefined', 'UNDEFINED') THEN NULL ELSE status END AS status FROM ({DIRTY})")
def _(s, d):
    return cl.null_tokens(dirty_orders(s, d), ["status"]).select("o_orderkey", "status")


@case("null_patterns", f"SELECT (price IS NULL)::INTEGER::VARCHAR || (o_custkey IS NULL)::INTEGER::VARCHAR AS pattern, count(*) AS rows FROM ({DIRTY}) GROUP BY 1")
def _(s, d):
    return cl.null_patterns(dirty_orders(s, d), ["price", "o_custkey"])


for _how, _sql in {"mean": "avg(price)", "median": "median(price)"}.items():

    @case(f"null_fill_{_how}", f"SELECT o_orderkey, round(coalesce(price, (SELECT {_sql} FROM ({DIRTY}))), 4) AS price FROM ({DIRTY})")
    def _(s, d, how=_how):
        return cl.fill(dirty_orders(s, d), "price", how).select("o_orderkey", F.round("price", 4).alias("price"))


@case("null_fill_mode", f"SELECT o_orderkey, coalesce(status, (SELECT status FROM (SELECT nullif(status, ' N/A ') status FROM ({DIRTY})) WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM (SELECT o_orderkey, nullif(status, ' N/A ') status FROM ({DIRTY}))")
def _(s, d):
    return cl.fill(cl.null_tokens(dirty_orders(s, d), ["status"]), "status", "mode").select("o_orderkey", "status")


for _name, _back in {"ffill": False, "bfill": True}.items():
    _frame = "first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" if _back else "last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    @case(f"null_{_name}", f"SELECT event_id, {_frame} AS v FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)")
    def _(s, d, back=_back):
        e = table(s, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("value")))
        return cl.carry(e, "v", ["user_id"], ["ts", "event_id"], back).select("event_id", "v")


@case("null_drop_rows", f"SELECT o_orderkey, price FROM ({DIRTY}) WHERE price IS NOT NULL")
def _(s, d):
    return dirty_orders(s, d).dropna(subset=["price"]).select("o_orderkey", "price")


@case("outlier_iqr_remove", f"SELECT event_id, value FROM events, {_fences('value', 'events')} WHERE NOT (value < lo OR value > hi)")
def _(s, d):
    return cl.treat_outliers(table(s, d, "events"), "value").select("event_id", "value")


@case("outlier_zscore", "SELECT event_id, value FROM events, (SELECT avg(value) m, stddev_samp(value) s FROM events) WHERE NOT (value < m - 3 * s OR value > m + 3 * s)")
def _(s, d):
    return cl.treat_outliers(table(s, d, "events"), "value", "z_score").select("event_id", "value")


@case("outlier_percentile", f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, (SELECT {_q('l_extendedprice', 'lineitem', .01)} lo, {_q('l_extendedprice', 'lineitem', .99)} hi) WHERE l_extendedprice BETWEEN lo AND hi")
def _(s, d):
    return cl.treat_outliers(table(s, d, "lineitem"), "l_extendedprice", "percentile").select("l_orderkey", "l_linenumber", "l_extendedprice")


@case("outlier_impute_median", f"SELECT event_id, CASE WHEN value < lo OR value > hi THEN (SELECT median(value) FROM events) ELSE value END AS value FROM events, {_fences('value', 'events')}")
def _(s, d):
    return cl.treat_outliers(table(s, d, "events"), "value", "iqr", "impute_median").select("event_id", "value")


@case("type_infer", """SELECT * FROM (VALUES ('k', 'numeric'), ('d', 'datetime'), ('p', 'string')) t("column", inferred)""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderdate").cast("string").alias("d"), F.col("o_orderpriority").alias("p"))
    return cl.infer_types(o, ["k", "d", "p"])


@case("type_fix_dates", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def _(s, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(s, d, "orders").select("o_orderkey", cl.parse_date(text).alias("day"))


@case("dup_exact", "SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_name, p_brand, p_type) n FROM part) WHERE n > 1")
def _(s, d):
    return cl.duplicate_rows(table(s, d, "part"), ["p_name", "p_brand", "p_type"]).select("p_partkey")


SPELLED = "SELECT *, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS label FROM part"


def spelled(s, d):
    return table(s, d, "part").withColumn("label", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")))


@case("dup_case", f"SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY lower(trim(label)), lower(trim(p_brand))) n FROM ({SPELLED})) WHERE n > 1")
def _(s, d):
    return cl.duplicate_rows(spelled(s, d), ["label", "p_brand"], loose=True).select("p_partkey")


@case("dup_conflicting", "SELECT lower(trim(p_name)) AS p_name, lower(trim(p_brand)) AS p_brand, count(*) AS rows FROM part GROUP BY 1, 2 HAVING count(*) > 1 AND (count(DISTINCT p_type) > 1 OR count(DISTINCT p_size) > 1)")
def _(s, d):
    return cl.conflicting_keys(table(s, d, "part"), ["p_name", "p_brand"], ["p_type", "p_size"])


@case("dedupe_keep_first", f"SELECT min(p_partkey) AS p_partkey FROM ({SPELLED}) GROUP BY lower(trim(label)), lower(trim(p_brand))")
def _(s, d):
    return cl.keep_first(spelled(s, d), ["label", "p_brand"], "p_partkey").select("p_partkey")


@case("dedupe_merge_smart", f"SELECT min(o_orderkey) AS o_orderkey, o_custkey, arg_min(price, o_orderkey) FILTER (price IS NOT NULL) AS price FROM ({DIRTY}) GROUP BY o_custkey")
def _(s, d):
    return cl.merge_smart(dirty_orders(s, d), ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", "price")


@case("standardize_case_space", f"SELECT p_partkey, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS label FROM ({SPELLED})")
def _(s, d):
    return cl.standardise(spelled(s, d), ["label"]).select("p_partkey", "label")


@case("standardize_synonyms", "SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Home' ELSE lower(c_mktsegment) END AS segment FROM customer")
def _(s, d):
    return cl.standardise(table(s, d, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], synonyms={"household": "Home"}).select("c_custkey", "segment")


@case("standardize_variations", f"SELECT lower(trim(label)) AS normal, count(DISTINCT label) AS spellings, count(*) AS rows FROM ({SPELLED}) GROUP BY 1 HAVING count(DISTINCT label) > 1")
def _(s, d):
    return cl.variations(spelled(s, d), "label")


@case("verify_integrity", f"SELECT count(*) AS rows, 0::BIGINT AS non_finite, count(*) - count(price) AS nulls, count(*) - count(DISTINCT o_orderkey) AS duplicates FROM ({DIRTY})")
def _(s, d):
    return cl.integrity(dirty_orders(s, d), ["o_orderkey"], ["price"])


@case(
    "preview_impact",
    f"""SELECT *, round(100.0 * (after - before) / before, 4) AS change_pct, CASE WHEN abs(100.0 * (after - before) / before) >= 10 THEN 'high' WHEN abs(100.0 * (after - before) / before) >= 5 THEN 'medium' ELSE 'low' END AS impact FROM (
 SELECT 'drop_nulls' AS rule, count(*) AS before, count(price) AS after FROM ({DIRTY}) UNION ALL SELECT 'drop_duplicates', count(*), count(DISTINCT o_custkey) FROM orders)""",
)
def _(s, d):
    o = dirty_orders(s, d)
    return cl.preview_impact(o, {"drop_nulls": o.dropna(subset=["price"]), "drop_duplicates": cl.keep_first(o, ["o_custkey"], "o_orderkey")})


# --- master data ---
KEYS = ("o_orderkey", "o_custkey", "o_orderdate")


@case("key_candidates", f"""SELECT "column", round(u, 4) AS uniqueness, round(z, 4) AS null_pct, CASE WHEN u >= 99 AND z <= 0 THEN 'primary' WHEN u BETWEEN 50 AND 99 THEN 'entity' ELSE 'none' END AS key_kind FROM ({_union(f"SELECT '{c}' AS 'column', 100.0 * count(DISTINCT {c}) / count({c}) u, 100.0 * (count(*) - count({c})) / count(*) z FROM orders" for c in KEYS).replace("AS 'column'", 'AS "column"')})""")
def _(s, d):
    return ma.key_candidates(table(s, d, "orders"), KEYS)


COMBO = ("l_orderkey", "l_linenumber", "l_partkey")


@case("key_composite", "SELECT * FROM (" + _union(f"SELECT '{'+'.join(c)}' AS columns, round(100.0 * count(DISTINCT ({', '.join(c)})) / count(*), 4) AS uniqueness FROM lineitem" for c in (COMBO[:2], (COMBO[0], COMBO[2]), COMBO[1:], COMBO)) + ") WHERE uniqueness >= 90")
def _(s, d):
    return ma.composite_keys(table(s, d, "lineitem"), COMBO, least=90.0)


@case("key_sequence", "SELECT count(*) FILTER (g = 1) AS unit_gaps, count(g) AS gaps, count(*) FILTER (g = 1) > 0.9 * count(g) AS auto_increment FROM (SELECT k - lag(k) OVER (ORDER BY k) AS g FROM (SELECT DISTINCT o_custkey k FROM orders))")
def _(s, d):
    return ma.is_sequence(table(s, d, "orders"), "o_custkey")


@case("key_fk_overlap", "SELECT count(*) AS distinct_values, count(hit) AS matched, round(100.0 * count(hit) / count(*), 4) AS overlap_pct FROM (SELECT DISTINCT l_orderkey v FROM lineitem) LEFT JOIN (SELECT o_orderkey v, 1 hit FROM orders WHERE o_orderstatus <> 'P') USING (v)")
def _(s, d):
    return ma.fk_overlap(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@case("contract_enforce", f"SELECT o_orderkey, CASE WHEN status IN ('O', 'F') THEN status ELSE 'U' END AS status, greatest(1000.0, least(300000.0, price)) + price * 0 AS price FROM ({DIRTY})")
def _(s, d):
    return ma.enforce(dirty_orders(s, d), {"status": ["O", "F"]}, {"price": (1000.0, 300000.0)}, {"status": "U"}).select("o_orderkey", "status", "price")


@case("contract_violations", f"SELECT o_orderkey, 'status' AS rule FROM ({DIRTY}) WHERE NOT regexp_matches(status, '^[A-Z]$') UNION ALL SELECT o_orderkey, 'price' FROM ({DIRTY}) WHERE price > 300000")
def _(s, d):
    return ma.violations(dirty_orders(s, d), "o_orderkey", {"status": F.col("status").rlike("^[A-Z]$"), "price": F.col("price") <= 300000})


@case("contract_unique", "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return ma.duplicate_key_groups(table(s, d, "orders"), ["o_custkey"])


@case("semantic_values", "SELECT c_mktsegment AS value, count(*) AS rows, CASE c_mktsegment WHEN 'MACHINERY' THEN 'industry' WHEN 'HOUSEHOLD' THEN 'home' ELSE c_mktsegment END AS standard, CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN 0.9::DOUBLE ELSE 0.0 END AS confidence FROM customer GROUP BY 1")
def _(s, d):
    return ma.map_values(table(s, d, "customer"), "c_mktsegment", {"machinery": "industry", "household": "home"})


@case("lineage_row_md5", "SELECT n_nationkey, md5(n_nationkey::VARCHAR || '|' || n_name || '|' || n_regionkey::VARCHAR) AS digest FROM nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", ma.row_digest(["n_nationkey", "n_name", "n_regionkey"]).alias("digest"))


@case("lineage_diff", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0")
def _(s, d):
    old = table(s, d, "customer")
    new = old.where("c_custkey % 10 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    return ma.lineage_diff(old, new, "c_custkey", ["c_name", "c_nationkey"])


@case(
    "golden_exact",
    """SELECT lower(trim(p_name)) AS key_p_name, lower(trim(p_brand)) AS key_p_brand, min(p_size) AS p_size, arg_min(p_type, (-length(p_type), p_partkey)) AS p_type, count(*) AS source_count,
 round((CASE WHEN count(DISTINCT p_size) > 1 THEN 0.9 ELSE 1 END + CASE WHEN count(DISTINCT p_type) > 1 THEN 0.8 ELSE 1 END) / 2.0, 4)::DOUBLE AS trust_score FROM part GROUP BY 1, 2""",
)
def _(s, d):
    return ma.golden_records(table(s, d, "part"), ["p_name", "p_brand"], {"p_size": {"rule": "min"}, "p_type": {"rule": "most_complete"}}, "p_partkey")


@case("survive_freshness", "SELECT o_custkey, arg_min(o_totalprice, (-epoch(o_orderdate), o_orderkey)) AS price FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(ma.survivor("o_totalprice", "most_recent", "o_orderkey", by="o_orderdate").alias("price"))


@case("survive_source_priority", "SELECT o_custkey, arg_min(o_totalprice, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 999 END, o_orderkey)) AS price FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(ma.survivor("o_totalprice", "source_priority", "o_orderkey", by="o_orderstatus", priority={"F": 1, "O": 2}).alias("price"))


@case("survive_min_max", "SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, arg_min(o_totalprice, o_orderkey) AS first, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(*[ma.survivor("o_totalprice", r, "o_orderkey").alias(n) for r, n in {"min": "low", "max": "high", "first": "first", "last": "last"}.items()])


@case("survive_frequency", "SELECT o_custkey, arg_min(o_orderpriority, (-n, pos)) AS o_orderpriority, round(least(0.95, 0.5 + 0.5 * max(n) / sum(n)), 4)::DOUBLE AS confidence FROM (SELECT o_custkey, o_orderpriority, count(*) n, min(o_orderkey) pos FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return ma.most_frequent(table(s, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@case("steward_flags", f"SELECT o_orderkey, concat_ws('; ', CASE WHEN price IS NULL THEN 'MISSING:price' END, CASE WHEN trim(status) = 'N/A' THEN 'FORMAT:status' END) AS issues, price IS NULL OR trim(status) = 'N/A' AS needs_review FROM ({DIRTY})")
def _(s, d):
    return ma.steward_flags(dirty_orders(s, d), {"MISSING:price": F.col("price").isNull(), "FORMAT:status": F.trim("status") == "N/A"}).select("o_orderkey", "issues", "needs_review")


@case("writeback_checksum", "SELECT s_suppkey, left(md5(s_suppkey::VARCHAR || '|' || s_name), 16) AS row_checksum, 'v1' AS version FROM supplier WHERE s_acctbal >= 0")
def _(s, d):
    return ma.write_back(table(s, d, "supplier"), ["s_suppkey", "s_name"], "v1", 0.0, "s_acctbal").select("s_suppkey", "row_checksum", "version")


# --- marketing ---
AS_OF = "2001-08-02"
RFM_BASE = f"SELECT o_custkey AS customer_id, date_diff('day', max(o_orderdate::DATE), DATE '{AS_OF}') AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1"




RFM = f"""WITH b AS ({RFM_BASE}), e AS (SELECT quantile_cont(recency, [0.2,0.4,0.6,0.8]) r, quantile_cont(frequency, [0.2,0.4,0.6,0.8]) f, quantile_cont(monetary, [0.2,0.4,0.6,0.8]) m FROM b),
 s AS (SELECT b.*, 6 - least(5, 1 + len(list_filter(list_distinct(e.r), lambda x: x < recency))) AS r, least(5, 1 + len(list_filter(list_distinct(e.f), lambda x: x < frequency))) AS f, least(5, 1 + len(list_filter(list_distinct(e.m), lambda x: x < monetary))) AS m FROM b, e),
 t AS (SELECT *, round(((33 * r + 33 * f + 34 * m) / 100.0 - 1) / 4 * 100, 4) AS rfm FROM s)"""


def rfm(s, d):
    return an.rfm_scores(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", AS_OF)


@case("rfm_scores", RFM + " SELECT * FROM t")
def _(s, d):
    return rfm(s, d)


@case("rfm_summary", RFM + ", g AS (SELECT quantile_cont(rfm, [0.2,0.4,0.6,0.8]) q FROM t) SELECT 6 - least(5, 1 + len(list_filter(list_distinct(q), lambda x: x < rfm))) AS segment_id, count(*) AS customers, round(sum(monetary), 2) AS value, round(100 * sum(monetary) / (SELECT sum(monetary) FROM t), 4) AS value_share FROM t, g GROUP BY 1")
def _(s, d):
    return an.segment_summary(rfm(s, d), "rfm", "monetary", 5)


@case(
    "basket_rules",
    """WITH i AS (SELECT DISTINCT l_orderkey b, p_type x FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT b) n FROM i), s AS (SELECT x, count(*) c FROM i GROUP BY 1),
 p AS (SELECT i.x a, j.x b, count(*) c FROM i JOIN i j ON i.b = j.b AND i.x <> j.x GROUP BY 1, 2)
 SELECT a AS antecedent, p.b AS consequent, p.c AS together, round(p.c / n, 6) AS support, round(p.c / sa.c, 6) AS confidence, round(p.c * n / (sa.c * sb.c), 6) AS lift
 FROM p JOIN s sa ON sa.x = a JOIN s sb ON sb.x = p.b, n WHERE p.c >= 0.02 * n AND sa.c >= 0.02 * n AND sb.c >= 0.02 * n AND p.c / sa.c >= 0.3""",
)
def _(s, d):
    items = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return an.basket_rules(items, "l_orderkey", "p_type", 0.02, 0.3, 0.0)


@case(
    "basket_triple_rules",
    """WITH i AS (SELECT DISTINCT l_orderkey b, p_brand x FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT b) n FROM i), s AS (SELECT x, count(*) c FROM i GROUP BY 1),
 f AS (SELECT i.* FROM i SEMI JOIN (SELECT x FROM s, n WHERE c >= 0.001 * n) k ON i.x = k.x), p AS (SELECT i.x a, j.x b, count(*) c FROM f i JOIN f j ON i.b = j.b AND i.x < j.x GROUP BY 1, 2),
 t AS (SELECT i.x a, j.x b, k.x c, count(*) m FROM f i JOIN f j ON i.b = j.b AND i.x < j.x JOIN f k ON k.b = i.b AND k.x <> i.x AND k.x <> j.x GROUP BY 1, 2, 3)
 SELECT a, b, t.c AS consequent, m AS together, round(m / n, 6) AS support, round(m / p.c, 6) AS confidence FROM t JOIN p USING (a, b), n WHERE m >= 0.001 * n AND m / p.c >= 0.1""",
)
def _(s, d):
    items = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return an.basket_triple_rules(items, "l_orderkey", "p_brand", 0.001, 0.1)


@case("standardize_units", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN round(p_size * 2.5, 4)::VARCHAR || ' cm' WHEN p_partkey % 3 = 1 THEN round(p_size * 0.5, 4)::VARCHAR || ' kg' ELSE p_size::VARCHAR || ' pieces' END AS label FROM part")
def _(s, d):
    unit = F.element_at(F.array(F.lit("Inch"), F.lit("lb"), F.lit("pieces")), (F.col("p_partkey") % 3 + 1).cast("int"))
    label = F.concat_ws(" ", F.col("p_size").cast("string"), unit)
    return table(s, d, "part").select("p_partkey", cl.convert_units(label, {"inch": ("cm", 2.5), "lb": ("kg", 0.5)}).alias("label"))


STEPS = "SELECT o_orderpriority AS previous, lead(o_orderpriority) OVER w AS following, date_diff('day', o_orderdate, lead(o_orderdate) OVER w) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@case("sequence_rules", f"SELECT previous, following, count(*) AS n, round(avg(gap), 4) AS avg_gap, round(count(*) / sum(count(*)) OVER (PARTITION BY previous), 6) AS confidence FROM ({STEPS}) WHERE gap <= 90 GROUP BY 1, 2")
def _(s, d):
    return an.sequence_rules(an.sequence_steps(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", 90))


@case("did_lift", f"SELECT round(t0, 4) t0, round(t1, 4) t1, round(c0, 4) c0, round(c1, 4) c1, round((t1 - t0) - (c1 - c0), 4) AS did FROM (SELECT avg(o_totalprice) FILTER (p AND NOT a) t0, avg(o_totalprice) FILTER (p AND a) t1, avg(o_totalprice) FILTER (NOT p AND NOT a) c0, avg(o_totalprice) FILTER (NOT p AND a) c1 FROM (SELECT *, o_orderpriority = '1-URGENT' p, o_orderdate >= TIMESTAMP '{CUT}' a FROM orders))")
def _(s, d):
    return an.did_lift(table(s, d, "orders"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") >= F.lit(CUT).cast("timestamp_ntz"), "o_totalprice")


@case(
    "holdout_plan",
    """WITH s AS (SELECT c_mktsegment, 0.1::DOUBLE AS rate, 0.2::DOUBLE AS lift, count(*)::DOUBLE AS traffic FROM customer GROUP BY 1),
 n AS (SELECT *, greatest(30, ceil(7.848879734349086 * (rate * (1 - rate) + rate * (1 + lift) * (1 - rate * (1 + lift))) / pow(rate * lift, 2)))::BIGINT AS n_per_arm FROM s),
 t AS (SELECT *, 2 * n_per_arm * (1 / 0.1::DOUBLE + 1 / 0.9::DOUBLE) / 4 AS x FROM n)
 SELECT c_mktsegment, rate, lift, traffic, n_per_arm, round(x, 4) AS total, round(x * 0.1::DOUBLE, 4) AS holdout, round(x / traffic, 4) AS days, x * 0.1 < n_per_arm AS underpowered FROM t""",
)
def _(s, d):
    seg = table(s, d, "customer").groupBy("c_mktsegment").agg(F.lit(0.1).alias("rate"), F.lit(0.2).alias("lift"), F.count(F.lit(1)).cast("double").alias("traffic"))
    return an.holdout_plan(seg, "rate", "lift", "traffic")


from . import catalogue_more, catalogue_names, catalogue_trust  # noqa: E402, F401  register their cases
