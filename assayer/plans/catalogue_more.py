"""Further registered queries: issue tables, contracts, samples, matching, synthetic control, dates and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio_col, jaro_winkler_col
from ..operators import analyze as an
from ..operators import clean as cl
from ..operators import contract as co
from ..operators import control as ct
from ..operators import drift as dr
from ..operators import issues as iss
from ..operators import master as ma
from ..operators import match as mt
from .catalogue import DIRTY, case, dirty_orders, halves, table

ISSUES = f"""SELECT o_orderkey AS row_id, 'price' AS "column", 'null' AS issue, 'high' AS severity, NULL::VARCHAR AS value FROM ({DIRTY}) WHERE price IS NULL
 UNION ALL SELECT o_orderkey, 'status', 'blank', 'medium', status FROM ({DIRTY}) WHERE trim(status) = 'N/A'
 UNION ALL SELECT o_orderkey, 'o_custkey', 'range', 'low', o_custkey::VARCHAR FROM ({DIRTY}) WHERE o_custkey < 20"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def order_issues(s, d):
    rules = {
        "null": ("price", "high", F.col("price").isNull()),
        "blank": ("status", "medium", F.trim("status") == "N/A"),
        "range": ("o_custkey", "low", F.col("o_custkey") < 20),
    }
    return iss.issues(dirty_orders(s, d), "o_orderkey", rules)


@case("issue_rows", ISSUES)
def _(s, d):
    return order_issues(s, d)


@case("issue_summary", f'SELECT issue, severity, count(*) AS issues, count(DISTINCT row_id) AS affected_rows, count(DISTINCT "column") AS affected_columns FROM ({ISSUES}) GROUP BY 1, 2')
def _(s, d):
    return iss.issue_summary(order_issues(s, d))


@case("issue_gravest", f'SELECT * FROM ({ISSUES}) ORDER BY {RANK}, row_id, "column", issue LIMIT 100')
def _(s, d):
    return iss.gravest(order_issues(s, d), 100)


@case("issue_capped", f"""SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_id, "column", issue) n FROM ({ISSUES})) WHERE n <= 50""")
def _(s, d):
    return iss.capped(order_issues(s, d), "column", 50)


@case("row_ids", "SELECT count(*) AS rows, count(*) AS distinct_ids, 0::BIGINT AS least, count(*) - 1 AS greatest FROM lineitem")
def _(s, d):
    x = iss.with_row_id(table(s, d, "lineitem"))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_row_id").alias("distinct_ids"), F.min("_row_id").alias("least"), F.max("_row_id").alias("greatest"))


@case("sample_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def _(s, d):
    return iss.first_rows(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)


@case("sample_seeded", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def _(s, d):
    return iss.seeded_sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


@case("rows_taken", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(s, d):
    ids = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return iss.take_rows(table(s, d, "orders"), "o_custkey", ids).select("o_orderkey", "o_totalprice")


@case("rows_excluded", f"SELECT o_orderkey, price, status FROM ({DIRTY}) WHERE o_orderkey NOT IN (SELECT row_id FROM ({ISSUES}))")
def _(s, d):
    flagged = order_issues(s, d).select(F.col("row_id").alias("o_orderkey"))
    return iss.without_rows(dirty_orders(s, d), "o_orderkey", flagged).select("o_orderkey", "price", "status")


@case("rule_any_all", f"""SELECT 'null' AS rule, bool_or(price IS NULL) AS "any", bool_and(price IS NULL) AS "all" FROM ({DIRTY})
 UNION ALL SELECT 'positive', bool_or(coalesce(price > 0, false)), bool_and(coalesce(price > 0, false)) FROM ({DIRTY}) UNION ALL SELECT 'keyed', bool_or(o_orderkey IS NOT NULL), bool_and(o_orderkey IS NOT NULL) FROM ({DIRTY})""")
def _(s, d):
    return iss.any_all(dirty_orders(s, d), {"null": F.col("price").isNull(), "positive": F.col("price") > 0, "keyed": F.col("o_orderkey").isNotNull()})


RULES = {"eq": "F", "ne": "O", "contains": "N"}


@case("business_rules", f"""SELECT o_orderkey, status = 'F' AS eq, coalesce(status, 'None') <> 'O' AS ne, contains(status, 'N') AS has, coalesce(price > 1000, false) AS gt, coalesce(price < 1000, false) AS lt FROM ({DIRTY})""")
def _(s, d):
    rule = lambda c, op, v: co.business_rule({"column": c, "operator": op, "value": v})
    return dirty_orders(s, d).select("o_orderkey", rule("status", "eq", "F").alias("eq"), rule("status", "ne", "O").alias("ne"), rule("status", "contains", "N").alias("has"), rule("price", "gt", 1000).alias("gt"), rule("price", "lt", "1000").alias("lt"))


CONTRACT = {
    "rename": {"o_orderkey": "id", "o_custkey": "customer"},
    "columns": {
        "id": {"type": "integer", "required": True},
        "customer": {"type": "string", "pattern": r"^\d*[02468]$"},
        "price": {"type": "numeric", "required": True, "default": 0.0, "min": 1000.0, "max": 200000.0},
        "status": {"type": "string", "allowed": ["O", "F"], "default": "U"},
        "channel": {"type": "string", "default": "web"},
    },
}


@case("contract_whole", f"""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR END AS customer, coalesce(greatest(1000.0, least(200000.0, CASE WHEN price IS NOT NULL THEN price END)) * CASE WHEN price IS NULL THEN NULL ELSE 1 END, 0.0) AS price,
 CASE WHEN status IN ('O', 'F') THEN status ELSE 'U' END AS status, 'web' AS channel FROM ({DIRTY})""")
def _(s, d):
    return co.enforce_contract(dirty_orders(s, d), CONTRACT)


@case("contract_report", f"""SELECT * FROM (VALUES ('channel', 'missing', 1::BIGINT), ('o_orderdate', 'extra', 1), ('o_orderpriority', 'extra', 1)) t("column", "check", rows)
 UNION ALL SELECT 'price', 'required', count(*) FILTER (price IS NULL) FROM ({DIRTY}) UNION ALL SELECT 'price', 'range', count(*) FILTER (price < 1000 OR price > 200000) FROM ({DIRTY}) HAVING count(*) FILTER (price < 1000 OR price > 200000) > 0
 UNION ALL SELECT 'status', 'allowed', count(*) FILTER (status NOT IN ('O', 'F')) FROM ({DIRTY}) UNION ALL SELECT 'customer', 'pattern', count(*) FILTER (o_custkey % 2 = 1) FROM ({DIRTY})""")
def _(s, d):
    return co.contract_report(co.rename_drop(dirty_orders(s, d), CONTRACT["rename"]), CONTRACT)


@case("quarantine_detectors", f"""SELECT * FROM (SELECT o_orderkey AS id, concat_ws(',', CASE WHEN price IS NULL THEN 'MISSING:price' END, CASE WHEN o_custkey % 2 = 1 THEN 'FORMAT:customer' END,
 CASE WHEN status NOT IN ('O', 'F') THEN 'VALUE:status' END, CASE WHEN NOT price BETWEEN 2000 AND 150000 THEN 'RANGE:price' END) AS reasons FROM ({DIRTY})) WHERE reasons <> ''""")
def _(s, d):
    x = co.rename_drop(dirty_orders(s, d), CONTRACT["rename"], ["o_orderdate"])
    rules = co.quarantine_rules({"columns": {k: v for k, v in CONTRACT["columns"].items() if k != "channel"}}, {"price": (2000, 150000)})
    rules = {k: rules[k] for k in sorted(rules, key=lambda k: ["MISSING:price", "FORMAT:customer", "VALUE:status", "RANGE:price"].index(k) if k in ("MISSING:price", "FORMAT:customer", "VALUE:status", "RANGE:price") else 9)}
    return cl.quarantine(x, rules).where(F.size("_reasons") > 0).select("id", F.array_join("_reasons", ",").alias("reasons"))


@case("columns_null_heavy", f"SELECT count(*) AS rows, 'o_orderkey,half' AS kept FROM ({DIRTY})")
def _(s, d):
    x = dirty_orders(s, d).select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 1).alias("half"), F.when(F.col("o_orderkey") % 5 == 0, 1).alias("sparse"))
    x = x.drop(*co.null_heavy(x, 0.6))
    return x.agg(F.count(F.lit(1)).alias("rows")).withColumn("kept", F.lit(",".join(x.columns)))


WRITTEN = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 3 THEN strftime(o_orderdate, '%d %b %Y') ELSE 'no day' END"


def written_days(s, d):
    layouts = ["yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd", "dd MMM yyyy"]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 5 == i, F.date_format("o_orderdate", x)) for i, x in enumerate(layouts)], F.lit("no day"))
    return table(s, d, "orders").select("o_orderkey", "o_totalprice", text.alias("day"))


@case("standardize_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'no day' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(s, d):
    return written_days(s, d).select("o_orderkey", cl.standard_date(F.col("day")).alias("day"))


@case("likely_dates", "SELECT count(*) AS sampled, count(*) FILTER (o_orderkey % 5 <> 4) AS dates, count(*) FILTER (o_orderkey % 5 <> 4) > 0.5 * count(*) AS likely FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50)")
def _(s, d):
    return cl.likely_date(written_days(s, d), "day", "o_orderkey")


@case("type_fix", f"SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS price, o_custkey::BIGINT AS customer, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN o_orderdate::DATE END AS day FROM orders")
def _(s, d):
    x = written_days(s, d).join(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer")), "o_orderkey")
    x = x.withColumn("price", F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_totalprice").cast("string")))
    return cl.fix_types(x, {"price": "numeric", "customer": "integer", "day": "date"}).select("o_orderkey", "price", "customer", "day")


@case("uncastable_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def _(s, d):
    x = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "x1").when(F.col("o_orderkey") % 4 == 1, "").otherwise("1e3").alias("v"))
    return x.where(co.uncastable(F.col("v"))).select("o_orderkey")


@case("dup_any_kind", """SELECT p_partkey, concat_ws(',', CASE WHEN a > 1 THEN 'name' END, CASE WHEN b > 1 THEN 'brand_type' END) AS kinds FROM
 (SELECT p_partkey, count(*) OVER (PARTITION BY lower(trim(p_name))) a, count(*) OVER (PARTITION BY p_brand, p_type, p_size) b FROM part) WHERE a > 1 OR b > 1""")
def _(s, d):
    x = cl.duplicate_any(table(s, d, "part"), {"name": (("p_name",), True), "brand_type": (("p_brand", "p_type", "p_size"), False)})
    return x.where(F.size("_kinds") > 0).select("p_partkey", F.array_join("_kinds", ",").alias("kinds"))


NAMES = "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"


@case("similar_names", f"SELECT a, b, round(jaro_winkler_similarity(x, y), 6) AS similarity FROM ({NAMES})")
def _(s, d):
    return mt.pair_similarity(table(s, d, "part"), "p_partkey", "p_name", ["p_brand", "p_size"], lambda x, y: F.round(jaro_winkler_col(x, y), 6))


@case("golden_fuzzy")
def _(s, d):
    p = table(s, d, "part").withColumn("spelled", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.col("p_name"), F.lit("."))))
    found = mt.fuzzy_golden_records(p, {"spelled": 80, "p_type": 20}, 90.0, {"spelled": {"rule": "first"}, "p_retailprice": {"rule": "max"}}, "p_partkey", ["p_brand"])
    return found.withColumnRenamed("key__cluster", "cluster")


FEATURES = """f AS (SELECT o_custkey AS customer_id, sum(o_totalprice) AS total_value, count(*) AS transaction_count, avg(o_totalprice) AS avg_value FROM orders
 WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY 1),
z AS (SELECT customer_id, customer_id % 50 = 1 AS treated, (total_value - avg(total_value) OVER ()) / stddev_pop(total_value) OVER () AS a,
 (transaction_count - avg(transaction_count) OVER ()) / stddev_pop(transaction_count) OVER () AS b, (avg_value - avg(avg_value) OVER ()) / stddev_pop(avg_value) OVER () AS c FROM f)"""


def order_features(s, d):
    f = ct.features(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "1995-01-01", "1997-12-31")
    return ct.z_scored(f.where("customer_id % 50 = 1"), f.where("customer_id % 50 <> 1"))


@case("control_features", "SELECT o_custkey AS customer_id, round(sum(o_totalprice), 2) AS total_value, count(*) AS transaction_count, round(avg(o_totalprice), 6) AS avg_value, date_diff('day', max(o_orderdate::DATE), DATE '1997-12-31')::DOUBLE AS recency_days FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' GROUP BY 1")
def _(s, d):
    f = ct.features(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice", "1995-01-01", "1997-12-31")
    return f.select("customer_id", F.round("total_value", 2).alias("total_value"), "transaction_count", F.round("avg_value", 6).alias("avg_value"), "recency_days")


@case("control_z_scores", f"WITH {FEATURES} SELECT customer_id, treated, round(a, 5) AS total_value, round(b, 5) AS transaction_count, round(c, 5) AS avg_value FROM z")
def _(s, d):
    return order_features(s, d).select("customer_id", "treated", *[F.round(c, 5).alias(c) for c in ct.FEATURES])


@case("control_nearest", f"""WITH {FEATURES}, p AS (SELECT t.customer_id AS treated_id, c.customer_id AS control_id, sqrt((t.a - c.a) ** 2 + (t.b - c.b) ** 2 + (t.c - c.c) ** 2) AS d FROM z t JOIN z c ON t.treated AND NOT c.treated)
SELECT treated_id, control_id, round(d, 5) AS distance, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY treated_id ORDER BY d, control_id) AS r FROM p) WHERE r <= 3""")
def _(s, d):
    return ct.nearest(order_features(s, d), 3).select("treated_id", "control_id", F.round("distance", 5).alias("distance"), "rank")


@case("control_matched")
def _(s, d):
    return ct.match_controls(order_features(s, d)).select("treated_id", "control_id", F.round("distance", 6).alias("distance"))


@case("segment_labels", """SELECT c_custkey, label FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 3 WHEN c_acctbal < 5000 THEN 2 ELSE 1 END AS segment_id FROM customer) LEFT JOIN (VALUES (1, 'best'), (2, 'middle')) t(segment_id, label) USING (segment_id)""")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, 3).when(F.col("c_acctbal") < 5000, 2).otherwise(1).alias("segment_id"))
    return an.with_labels(c, "segment_id", {1: "best", 2: "middle"}).select("c_custkey", "label")


@case("top_customers", "SELECT o_custkey AS customer_id, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500")
def _(s, d):
    x = table(s, d, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("monetary"))
    return x.orderBy(F.col("monetary").desc(), "customer_id").limit(500)


@case("window_orders", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-06-30' - 365 AND DATE '1997-06-30'")
def _(s, d):
    return an.in_window(table(s, d, "orders"), "o_orderdate", "1997-06-30", "last_365").select("o_orderkey")


@case("window_year", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def _(s, d):
    return an.in_window(table(s, d, "orders"), "o_orderdate", "1997-06-30", "year_to_date").select("o_orderkey")


@case("daily_customers", "SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(s, d):
    return an.daily(table(s, d, "orders"), "o_orderdate", "o_totalprice", "o_custkey")


@case("rules_top", """WITH i AS (SELECT DISTINCT o_custkey AS b, p_brand AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), n AS (SELECT count(DISTINCT b) AS n FROM i),
u AS (SELECT x, count(*) AS c FROM i GROUP BY 1 HAVING c >= 0.05 * (SELECT n FROM n)), q AS (SELECT a.x AS antecedent, c.x AS consequent, count(*) AS together FROM i a JOIN i c ON a.b = c.b AND a.x <> c.x GROUP BY 1, 2)
SELECT antecedent, consequent, together, round(together / n, 6) AS support, round(together / ua.c, 6) AS confidence, round(together * n / (ua.c * uc.c), 6) AS lift FROM q, n, u ua, u uc
WHERE ua.x = antecedent AND uc.x = consequent AND together >= 0.05 * n AND together / ua.c >= 0.1 AND together * n / (ua.c * uc.c) >= 0.5 ORDER BY round(together * n / (ua.c * uc.c), 6) DESC, round(together / ua.c, 6) DESC, round(together / n, 6) DESC, antecedent, consequent LIMIT 50""")
def _(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return an.top_rules(an.basket_rules(x, "o_custkey", "p_brand", 0.05, 0.1, 0.5), 50)


@case("drift_ks_test")
def _(s, d):
    b, c = halves(s, d)
    return dr.ks_test(b, c, "o_totalprice")


@case("lineage_columns")
def _(s, d):
    return ma.column_digests(table(s, d, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@case("name_ratios")
def _(s, d):
    p = table(s, d, "supplier")
    return p.select("s_suppkey", F.round(indel_ratio_col("s_name", F.lower("s_name")), 4).alias("ratio"))


@case("itemsets_frequent", """WITH i AS (SELECT DISTINCT o_custkey AS b, l_shipmode AS x FROM (SELECT o_custkey, o_orderpriority AS l_shipmode FROM orders)), n AS (SELECT count(DISTINCT b) AS n FROM i),
s AS (SELECT [x] AS items, count(*) AS together FROM i GROUP BY 1 UNION ALL SELECT [a.x, c.x], count(*) FROM i a JOIN i c ON a.b = c.b AND a.x < c.x GROUP BY 1
 UNION ALL SELECT [a.x, c.x, e.x], count(*) FROM i a JOIN i c ON a.b = c.b AND a.x < c.x JOIN i e ON e.b = a.b AND c.x < e.x GROUP BY 1
 UNION ALL SELECT [a.x, c.x, e.x, g.x], count(*) FROM i a JOIN i c ON a.b = c.b AND a.x < c.x JOIN i e ON e.b = a.b AND c.x < e.x JOIN i g ON g.b = a.b AND e.x < g.x GROUP BY 1)
SELECT items, together, round(together / n, 6) AS support FROM s, n WHERE together >= 0.3 * n""")
def _(s, d):
    return an.frequent_sets(table(s, d, "orders"), "o_custkey", "o_orderpriority", 0.3)
