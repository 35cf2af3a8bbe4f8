"""DuckDB-dialect SQL building blocks for the oracle strings.

The ``customers``/``enriched`` CTEs mirror ``sources.fixtures.customers`` and
``operators.enrich.enrich`` expression for expression, so the Spark results
can be compared bit-for-bit.
"""

from __future__ import annotations


def R(expr: str, n: int) -> str:
    """Half away from zero, as ``functions.scalars.r``."""
    s = float(10 ** n)
    return f"(round(({expr}) * {s!r}::DOUBLE) / {s!r}::DOUBLE)"


def D(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


CUSTOMERS_CTE = f"""
cutoff AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS t FROM orders),
hist AS (
  SELECT o.o_custkey,
    count(*) FILTER (WHERE o.o_orderdate <= c.t) AS n_pre,
    min(o.o_orderdate) FILTER (WHERE o.o_orderdate <= c.t) AS first_pre,
    max(o.o_orderdate) FILTER (WHERE o.o_orderdate <= c.t) AS last_pre,
    sum(CAST(o.o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o.o_orderdate <= c.t) AS spend_pre,
    count(*) FILTER (WHERE o.o_orderdate <= c.t AND o.o_orderstatus = 'P') AS n_pending,
    count(*) FILTER (WHERE o.o_orderdate <= c.t AND o.o_orderstatus = 'F') AS n_failed,
    arg_max(o.o_orderpriority, struct_pack(d := CAST(o.o_orderdate AS DATE), k := o.o_orderkey))
        FILTER (WHERE o.o_orderdate <= c.t) AS last_priority,
    count(*) FILTER (WHERE o.o_orderdate > c.t) AS n_post,
    any_value(c.t) AS t
  FROM orders o CROSS JOIN cutoff c
  GROUP BY o.o_custkey),
cust_base AS (
  SELECT c.c_custkey, r.r_name, n.n_name, c.c_mktsegment, h.*,
         CAST(floor(date_diff('day', h.first_pre, h.t) / 30.0) AS BIGINT) AS tenure
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN hist h ON c.c_custkey = h.o_custkey),
customers AS (
  SELECT c_custkey AS customer_id, r_name AS region, n_name AS state, c_mktsegment AS customer_segment,
    CASE WHEN n_pre > 0 THEN CASE last_priority WHEN '1-URGENT' THEN 'Premium' WHEN '2-HIGH' THEN 'Family'
         WHEN '3-MEDIUM' THEN 'Standard' ELSE 'Basic' END END AS plantype,
    CASE WHEN n_pre > 0 THEN CASE WHEN n_pre >= 10 THEN 'Two year' WHEN n_pre >= 6 THEN 'One year'
         ELSE 'Month-to-month' END END AS contract_type,
    CASE WHEN n_pre > 0 THEN tenure END AS tenuremonths,
    CASE WHEN n_pre > 0 THEN {R("CAST(spend_pre AS DOUBLE) / CAST(greatest(tenure, 1) AS DOUBLE)", 2)} END AS monthlycharges,
    CASE WHEN n_pre > 0 THEN CAST(floor(date_diff('day', last_pre, t) / 10.0) AS BIGINT) END AS paymentdelaydays,
    CASE WHEN n_pre > 0 THEN n_pending END AS supporttickets,
    CASE WHEN n_pre > 0 THEN n_failed END AS payment_failures_12m,
    CASE WHEN coalesce(n_post, 0) > 0 THEN 0 ELSE 1 END AS churned
  FROM cust_base)"""

_MC = "coalesce(CAST(monthlycharges AS DOUBLE), 0.0::DOUBLE)"
_TM = "coalesce(CAST(tenuremonths AS DOUBLE), 12.0::DOUBLE)"
_PD = "coalesce(CAST(paymentdelaydays AS DOUBLE), 0.0::DOUBLE)"
_ST = "coalesce(CAST(supporttickets AS DOUBLE), 0.0::DOUBLE)"
_Z = f"(0.05::DOUBLE * {_PD} + 0.1::DOUBLE * {_ST} + -2.0::DOUBLE)"
_SIG = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(-20.0::DOUBLE, least(20.0::DOUBLE, {_Z})))))"

ENRICHED_CTE = CUSTOMERS_CTE + f""",
enriched0 AS (
  SELECT *,
    {R(f"{_MC} * {_TM}", 2)} AS estimated_clv,
    {R(_SIG, 4)} AS churn_risk_score,
    {R(f"10.0::DOUBLE - least(greatest({_PD} / 10.0::DOUBLE, 0.0::DOUBLE), 9.0::DOUBLE)", 1)} AS satisfaction_score,
    CASE WHEN lower(plantype) = 'standard' THEN 0.75::DOUBLE ELSE 0.3::DOUBLE END AS upsell_probability,
    CAST(trunc({_ST}) AS BIGINT) AS complaints_90d
  FROM customers),
enriched AS (
  SELECT *, {R("estimated_clv * 0.1::DOUBLE", 2)} AS retention_offer_cost FROM enriched0)"""


def with_enriched(*more_ctes: str) -> str:
    """``WITH <customers + enriched>[, more...]`` prefix."""
    parts = [ENRICHED_CTE.strip()] + [c.strip() for c in more_ctes if c.strip()]
    return "WITH " + ",\n".join(parts) + "\n"


def DSUM(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,10))) AS DOUBLE)"


def DAVG(x: str) -> str:
    return f"({DSUM(x)} / CAST(count({x}) AS DOUBLE))"


def RATIO(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST(greatest({den}, 1) AS DOUBLE))"
