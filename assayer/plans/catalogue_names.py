"""Registered queries on the meaning of column names."""

from __future__ import annotations

from ..operators import semantics as se
from .catalogue import case, table

NAMED = [
    ("c_custkey", "cust_id"), ("c_name", "First Name"), ("c_nationkey", "c_nationkey"), ("c_name", "c_address"), ("c_custkey", "tel"),
    ("c_acctbal", "Amount"), ("c_acctbal", "unit_price"), ("c_mktsegment", "Segment"), ("c_mktsegment", "last_update"), ("c_nationkey", "order_total"),
]
NAMED_SQL = "SELECT " + ", ".join(f'{a} AS "{b}"' for a, b in NAMED) + " FROM customer"


def named_customers(s, d):
    return table(s, d, "customer").selectExpr(*[f"{a} AS `{b}`" for a, b in NAMED])


def _spelled() -> str:
    return ", ".join(f"({n}, '{s}', '{x}')" for n, (s, xs) in enumerate(se.SPELLINGS.items()) for x in xs)


@case(
    "column_semantics",
    f"""WITH c AS (SELECT column_name AS o, lower(trim(column_name)) AS l FROM (DESCRIBE {NAMED_SQL})),
 v(n, s, x) AS (VALUES {_spelled()}), p(n, r, s, sure) AS (VALUES {", ".join(f"({n}, '{r}', '{s}', {sure}::DOUBLE)" for n, (r, s, sure) in enumerate(se.HINTS))}),
 a AS (SELECT o, arg_min(s, n) AS s FROM c JOIN v ON l = x OR trim(regexp_replace(l, '[^a-z0-9]', '_', 'g'), '_') = regexp_replace(x, '[^a-z0-9]', '', 'g') GROUP BY o),
 b AS (SELECT o, arg_min(s, n) AS s, arg_min(sure, n) AS sure FROM c JOIN p ON regexp_matches(l, r) GROUP BY o)
 SELECT c.o AS original_name, coalesce(a.s, b.s, c.o) AS standard_name, CASE WHEN a.s IS NOT NULL OR b.sure >= 0.8 THEN 'mapped' WHEN b.s IS NOT NULL THEN 'low_confidence' ELSE 'unmapped' END AS status,
 CASE WHEN a.s IS NOT NULL THEN 0.95::DOUBLE ELSE coalesce(b.sure, 0.0::DOUBLE) END AS confidence, CASE WHEN a.s IS NOT NULL THEN 'standard_variant' WHEN b.s IS NOT NULL THEN 'pattern_detection' END AS mapping_source
 FROM c LEFT JOIN a ON a.o = c.o LEFT JOIN b ON b.o = c.o""",
)
def column_semantics(s, d):
    return se.column_semantics(named_customers(s, d), threshold=0.8)


@case("standard_names", 'SELECT c_custkey AS customer_id, c_name AS "FirstName", c_nationkey AS country, c_name AS address, c_custkey AS "Phone", c_acctbal AS price, c_acctbal AS unit_price, c_mktsegment AS "Segment", c_mktsegment AS last_update, c_nationkey AS order_total FROM customer')
def standard_names(s, d):
    return se.standard_names(named_customers(s, d), threshold=0.8)
