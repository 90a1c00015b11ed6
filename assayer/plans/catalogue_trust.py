"""Registered queries on readiness, governance and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as go
from .catalogue import DIRTY, _q, _union, case, dirty_orders, table

TRUST = ("o_orderkey", "price", "status", "amount", "Unnamed: 4", "blank", "ship_date", "odd")
TRUST_SQL = f"""SELECT o_orderkey, price, status, CASE WHEN o_orderkey % 4 = 0 THEN 'see 1-2' ELSE o_custkey::VARCHAR END AS amount,
 CASE WHEN o_orderkey % 5 = 0 THEN '7' ELSE 'word' END AS "Unnamed: 4", NULL::VARCHAR AS blank,
 CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ship_date, CASE WHEN o_orderkey % 12 = 0 THEN 1000000000 ELSE o_custkey END::BIGINT AS odd FROM ({DIRTY})"""
TEXTS = ("status", "amount", "Unnamed: 4", "blank", "ship_date")


def trust_orders(s, d):
    k = F.col("o_orderkey")
    return dirty_orders(s, d).select(
        "o_orderkey", "price", "status", F.when(k % 4 == 0, "see 1-2").otherwise(F.col("o_custkey").cast("string")).alias("amount"), F.when(k % 5 == 0, "7").otherwise("word").alias("Unnamed: 4"),
        F.lit(None).cast("string").alias("blank"), F.when(k % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ship_date"), F.when(k % 12 == 0, 1000000000).otherwise(F.col("o_custkey")).alias("odd"),
    )


def _mixed(c: str) -> str:
    return f"""coalesce(regexp_matches(arg_min("{c}", o_orderkey) FILTER ("{c}" IS NOT NULL), '[0-9]') AND count(TRY_CAST(regexp_replace("{c}", '[^0-9.-]', '', 'g') AS DOUBLE)) < count("{c}"), false)::INT"""


def _few(c: str) -> str:
    n = f"""count(*) FILTER (regexp_matches("{c}", '^-?[0-9]+\\.?[0-9]*$'))"""
    return f"""({n} > 0 AND {n} < 0.3 * count("{c}"))::INT"""


@case(
    "readiness_scores",
    f"""SELECT round(a, 4) AS completeness, round(b, 4) AS consistency, round(h, 4) AS schema_health, round(s, 4) AS score,
 CASE WHEN s >= 80 THEN 'ready' WHEN s >= 50 THEN 'needs_review' ELSE 'not_ready' END AS status FROM (SELECT *, 0.3::DOUBLE * a + 0.3::DOUBLE * b + 0.4::DOUBLE * h AS s FROM (
 SELECT 100.0::DOUBLE * ({" + ".join(f'count("{c}")' for c in TRUST)}) / ({len(TRUST)} * count(*)) AS a, 100.0::DOUBLE - 20.0::DOUBLE * ({" + ".join(map(_mixed, TEXTS))}) / {len(TRUST)} AS b,
 100.0::DOUBLE - 15 * ({" + ".join(f'(count("{c}") = 0)::INT' for c in TRUST)}) - 8 - 5 * ({" + ".join(map(_few, TEXTS))}) AS h FROM ({TRUST_SQL})))""",
)
def _(s, d):
    return go.readiness(trust_orders(s, d), TRUST, order_col="o_orderkey")


COPIED = f"(SELECT * FROM ({TRUST_SQL}) UNION ALL SELECT * FROM ({TRUST_SQL}) WHERE o_orderkey % 6 = 0)"


def _deducted(reason: str, column: str, percent: str, source: str, over: int, by: int, most: int, steps: str) -> str:
    return f"""SELECT '{reason}' AS reason, {column} AS "column", round(p, 4) AS percent, round(least(p / {by}, {most}), 2) AS amount, CASE {steps} ELSE 'low' END AS severity FROM (SELECT {percent} AS p FROM {source}) WHERE p > {over}"""


def _beyond(c: str) -> str:
    a, b = _q(c, COPIED, 0.25), _q(c, COPIED, 0.75)
    return f"(SELECT {c}, lo - 1.5 * (hi - lo) AS low, hi + 1.5 * (hi - lo) AS high FROM {COPIED}, (SELECT {a} AS lo, {b} AS hi) WHERE hi > lo)"


@case(
    "readiness_deductions",
    _union(
        [
            *[_deducted("missing_values", f"'{c}'", f'100.0::DOUBLE * (count(*) - count("{c}")) / count(*)', COPIED, 10, 5, 25, "WHEN p > 80 THEN 'critical' WHEN p > 50 THEN 'high' WHEN p > 25 THEN 'medium'") for c in TRUST],
            _deducted("format_inconsistency", "'ship_date'", "100.0::DOUBLE * (count(ship_date) - count(try_strptime(ship_date, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']))) / count(ship_date)", COPIED, 0, 10, 12, "WHEN p > 25 THEN 'high' WHEN p > 10 THEN 'medium'"),
            *[_deducted("potential_outliers", f"'{c}'", f"100.0::DOUBLE * count(*) FILTER ({c} < low OR {c} > high) / count({c})", _beyond(c), 5, 20, 8, "WHEN p > 15 THEN 'medium'") for c in ("o_orderkey", "price", "odd")],
            _deducted("duplicate_rows", "NULL", "100.0::DOUBLE * coalesce(sum(n) FILTER (n > 1), 0) / sum(n)", f"(SELECT count(*) n FROM {COPIED} GROUP BY ALL)".replace("SELECT count(*) n", f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in TRUST)}, count(*) n"), 0, 10, 15, "WHEN p > 10 THEN 'high' WHEN p > 5 THEN 'medium'"),
        ]
    ),
)
def _(s, d):
    x = trust_orders(s, d)
    return go.readiness_deductions(x.unionByName(x.where("o_orderkey % 6 = 0")), TRUST)


LABELLED = f"""SELECT o_orderkey, price, CASE o_orderkey % 3 WHEN 0 THEN 'granted' WHEN 1 THEN 'denied' ELSE 'unknown' END AS consent_status,
 CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN NULL ELSE 'internal' END AS data_classification,
 CASE WHEN o_orderkey % 5 = 0 THEN 'mail a' || o_custkey || '@shop.example' ELSE 'call 555-123-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS contact,
 CASE WHEN o_orderkey % 8 = 4 THEN 'no 123-45-6789' ELSE 'none' END AS note FROM ({DIRTY})"""


def labelled_orders(s, d):
    k, who = F.col("o_orderkey"), F.col("o_custkey")
    return dirty_orders(s, d).select(
        "o_orderkey", "price", F.when(k % 3 == 0, "granted").when(k % 3 == 1, "denied").otherwise("unknown").alias("consent_status"), F.when(k % 4 == 0, "public").when(k % 4 != 1, "internal").alias("data_classification"),
        F.when(k % 5 == 0, F.concat(F.lit("mail a"), who.cast("string"), F.lit("@shop.example"))).otherwise(F.concat(F.lit("call 555-123-"), F.lpad((who % 10000).cast("string"), 4, "0"))).alias("contact"),
        F.when(k % 8 == 4, "no 123-45-6789").otherwise("none").alias("note"),
    )


LABELLED_TEXTS = ("consent_status", "data_classification", "contact", "note")


def _held(c: str, kinds) -> str:
    return "CASE " + " ".join(f"WHEN bool_or(regexp_matches({c}, '{go.INSIDE[k]}')) THEN coalesce(bool_or(regexp_matches({c}, '{go.INSIDE[k]}') AND data_classification = 'public'), false)" for k in kinds) + " ELSE false END"


@case(
    "governance_scores",
    f"""SELECT rows, round(l, 4) AS lineage, round(c, 4) AS consent, round(k, 4) AS classification, round(o, 4) AS overall, CASE WHEN o >= 80 THEN 'compliant' WHEN o >= 60 THEN 'needs_review' ELSE 'non_compliant' END AS status
 FROM (SELECT *, 0.3::DOUBLE * l + 0.4::DOUBLE * c + 0.3::DOUBLE * k AS o FROM (SELECT count(*) AS rows, 80.0::DOUBLE - CASE WHEN 100.0::DOUBLE * (count(*) - count(price)) / count(*) > 5 THEN least(15.0::DOUBLE, 10.0::DOUBLE * (count(*) - count(price)) / count(*)) ELSE 0 END AS l,
 75.0::DOUBLE - CASE WHEN bool_or(consent_status NOT IN ('granted', 'denied', 'withdrawn', 'pending')) THEN 15 ELSE 0 END AS c,
 100.0::DOUBLE - CASE WHEN {" OR ".join(_held(c, go.SCORED) for c in LABELLED_TEXTS)} THEN 20 ELSE 0 END AS k FROM ({LABELLED})))""",
)
def _(s, d):
    return go.governance_scores(labelled_orders(s, d), ["o_orderkey", "price", "owner"], ["consent_status", "consent_date"], ["data_classification"])


def _typed(c: str) -> str:
    kind = "CASE " + " ".join(f"WHEN bool_or(regexp_matches({c}, '{p}')) THEN '{k}'" for k, p in go.INSIDE.items()) + " END"
    hit = "CASE t " + " ".join(f"WHEN '{k}' THEN regexp_matches({c}, '{p}')" for k, p in go.INSIDE.items()) + " END"
    return f"""SELECT o_orderkey, '{c}' AS "column", t AS pii_type FROM ({LABELLED}), (SELECT {kind} AS t FROM ({LABELLED})) WHERE {hit} AND (data_classification IS NULL OR data_classification = 'public')"""


@case("governance_public_pii", _union(map(_typed, LABELLED_TEXTS)))
def _(s, d):
    return go.public_pii(labelled_orders(s, d), ["o_orderkey"])


@case(
    "governance_missing",
    f"""SELECT o_orderkey, CASE WHEN price IS NULL THEN 'lineage' ELSE 'classification' END AS category, 'policy_violation' AS issue, 'warning' AS severity,
 concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN data_classification IS NULL THEN 'data_classification' END) AS missing FROM ({LABELLED}) WHERE price IS NULL OR data_classification IS NULL""",
)
def _(s, d):
    return go.missing_required(labelled_orders(s, d), ["o_orderkey"], ["price", "owner"], ["consent_status"], ["data_classification"])


FIELDS = ("c_name", "contact", "email", "c_mktsegment", "masked_phone", "c_acctbal")
PEOPLE = "SELECT c_name, '+1-555-' || lpad(c_custkey::VARCHAR, 7, '0') AS contact, c_custkey || '@host' AS email, c_mktsegment, '+1-555-' || lpad(c_custkey::VARCHAR, 7, '0') AS masked_phone, c_acctbal FROM customer"
#: The patterns as they stand in the queries' own words: the first that over half of the values match.
KINDS = {"email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "phone": r"^[\d\s\-\(\)\+]{10,}$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "card": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$", "zip": r"^\d{5}(-\d{4})?$"}


def people(s, d):
    phone = F.concat(F.lit("+1-555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return table(s, d, "customer").select("c_name", phone.alias("contact"), F.concat(F.col("c_custkey").cast("string"), F.lit("@host")).alias("email"), "c_mktsegment", phone.alias("masked_phone"), "c_acctbal")


def _field(c: str) -> str:
    found = "CASE " + " ".join(f"WHEN count(*) FILTER (regexp_matches({c}::VARCHAR, '{p}')) > 0.5 * count({c}) THEN '{k}'" for k, p in KINDS.items()) + " END"
    mail = f"count(*) FILTER (contains({c}::VARCHAR, '@')) > 0.7 * count({c})" if c in ("email", "email_address") else "false"
    sensitive = any(k in c for k in go.SENSITIVE)
    under = ",".join(f for f, keys in go.FRAMEWORKS.items() if any(k in c for k in keys))
    return f"""SELECT '{c}' AS "column", coalesce(f, CASE WHEN m THEN 'email' END) AS pii_type, {sensitive} AS sensitive, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level,
 score > 0 AND '{c}' NOT IN ('encrypted_email', 'masked_phone') AS gap, CASE WHEN f IS NOT NULL OR m OR {sensitive} THEN '{under}' ELSE '' END AS frameworks, CASE WHEN f IS NOT NULL OR m THEN 'high' WHEN {sensitive} THEN 'medium' ELSE 'low' END AS effort
 FROM (SELECT *, CASE WHEN f IS NOT NULL THEN 80 WHEN m THEN 75 WHEN {sensitive} THEN 60 ELSE 0 END::BIGINT AS score FROM (SELECT {found} AS f, {mail} AS m FROM ({PEOPLE})))"""


RISKS = _union(map(_field, FIELDS))


@case("risk_field_levels", RISKS)
def _(s, d):
    return go.field_risks(people(s, d), FIELDS)


@case(
    "risk_overall",
    f"""SELECT round(m, 2) AS score, CASE WHEN m >= 70 THEN 'high' WHEN m >= 40 THEN 'medium' ELSE 'low' END AS level, high_fields, medium_fields, gaps, (2 * high_fields + medium_fields + greatest(0, gaps - high_fields - medium_fields))::BIGINT AS hours,
 (SELECT coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') FROM (SELECT unnest(string_split(frameworks, ',')) AS f FROM ({RISKS})) WHERE f <> '') AS frameworks
 FROM (SELECT avg(score) AS m, count(*) FILTER (level = 'high') AS high_fields, count(*) FILTER (level = 'medium') AS medium_fields, count(*) FILTER (gap) AS gaps FROM ({RISKS}))""",
)
def _(s, d):
    return go.overall_risk(go.field_risks(people(s, d), FIELDS))
