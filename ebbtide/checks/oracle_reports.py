"""Oracle SQL (DuckDB dialect) for the report tables."""

from ebbtide.checks import oracle_kpis as OK
from ebbtide.checks.oracle_ops import PRIO_CTES, _trunc, top_ctes
from ebbtide.checks.sqlbase import R, with_enriched

SQL = {}

_PRE = (OK.THR_RISK, OK.THR_CLV, OK.CONC_CTE)
_E_BODY = OK.SQL["enhanced_kpis"][len(with_enriched(*_PRE)):]
E_CTE = f"e AS ({_E_BODY})"


def _rows(rows):
    return "\nUNION ALL\n".join(
        f"SELECT {o} AS ord, '{m}' AS metric, CAST({v} AS DOUBLE) AS value, '{b}' AS benchmark, {s} AS status FROM e"
        for o, m, v, b, s in rows)


SQL["report_scorecard"] = with_enriched(*_PRE, E_CTE) + _rows([
    (1, "Total Customers", "total_customers", "—", "'✓'"),
    (2, "Churn Rate", "churn_rate_pct", "< 15%", "CASE WHEN churn_rate_pct >= 15 THEN '⚠' ELSE '✓' END"),
    (3, "Average CLV", "avg_clv", "—", "'✓'"),
    (4, "Revenue at Risk (Churned)", "revenue_at_risk", "< 5% ARR", "'⚠'"),
    (5, "Top-Quartile Risk Revenue", "biz_revenue_at_risk", "< 10%", "'⚠'"),
    (6, "Avg Churn Risk Score", "avg_churn_risk_score", "< 0.30",
     "CASE WHEN avg_churn_risk_score > 0.3 THEN '⚠' ELSE '✓' END"),
    (7, "Avg Satisfaction Score", "avg_satisfaction_score", "≥ 7.0",
     "CASE WHEN avg_satisfaction_score < 7 THEN '⚠' ELSE '✓' END"),
    (8, "High-Value Customers", "high_value_customers", "—", "'✓'"),
    (9, "High-Value Share (%)", "high_value_pct", "—", "'✓'"),
])


def _group(canonical: str, col: str, extra: str) -> str:
    return with_enriched(OK.breakdown_cte(canonical, col, "b")) + f"""
SELECT CAST(row_number() OVER (ORDER BY churn_rate_pct DESC, {canonical} ASC) AS INTEGER) AS ord, {canonical},
  {R('churn_rate_pct', 1)} AS churn_rate_pct_1dp, upper({OK._RL.format(x='churn_rate_pct')}) AS risk_level,
  CAST(floor(CAST((SELECT count(*) FROM enriched) AS DOUBLE) * (churn_rate_pct / 100.0::DOUBLE)
       * (1.0::DOUBLE / CAST(count(*) OVER () AS DOUBLE))) AS BIGINT) AS est_churned,
  {extra}
FROM b"""


SQL["report_segment_table"] = _group(
    "customer_segment", "customer_segment",
    "CASE WHEN churn_rate_pct > 25 THEN 'Premium Retention Offer' WHEN churn_rate_pct > 15 "
    "THEN 'Proactive Outreach' ELSE 'Monitor' END AS action")
SQL["report_region_table"] = _group(
    "region", "region",
    "CASE WHEN churn_rate_pct > 22 THEN 'P1 — Launch Now' WHEN churn_rate_pct > 15 "
    "THEN 'P2 — Next Cycle' ELSE 'P3 — Monitor' END AS campaign_priority")

_FIN = [
    (1, "Total Customer Base Value", "avg_clv * total_customers"),
    (2, "Revenue Lost (Churned Customers)", "-revenue_at_risk"),
    (3, "At-Risk Cohort Exposure", "-biz_revenue_at_risk"),
    (4, "Net Protected Revenue", "avg_clv * total_customers - revenue_at_risk - biz_revenue_at_risk"),
    (5, "Total Revenue Exposure", "revenue_at_risk + biz_revenue_at_risk"),
    (6, "Conservative Recovery (20%)", "revenue_at_risk * 0.2::DOUBLE"),
    (7, "Base Case Recovery (28%)", "revenue_at_risk * 0.28::DOUBLE"),
    (8, "Optimistic Recovery (35%)", "revenue_at_risk * 0.35::DOUBLE"),
]
SQL["report_financials"] = with_enriched(*_PRE, E_CTE) + "\nUNION ALL\n".join(
    f"SELECT {o} AS ord, '{n}' AS item, {R(f'CAST({v} AS DOUBLE)', 2)} AS value FROM e" for o, n, v in _FIN)

REPORT_REGION = "europe"
_EF = f"ef AS (SELECT * FROM enriched WHERE lower(trim(CAST(region AS VARCHAR))) = '{REPORT_REGION}')"
SQL["report_priority_table"] = with_enriched(
    _EF, *[c.replace("FROM enriched", "FROM ef") for c in PRIO_CTES], *top_ctes(10)) + f"""
SELECT CAST(row_number() OVER (ORDER BY priority_score DESC, customer_id ASC) AS INTEGER) AS ord, customer_id, customer_segment,
  plan_type, region, estimated_clv, churn_risk_score, priority_class, {_trunc('recommended_action', 30)} AS action
FROM plx"""
