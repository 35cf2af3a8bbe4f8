"""Oracle SQL (DuckDB dialect) for the KPI queries."""

from ebbtide.checks.sqlbase import DAVG, DSUM, R, RATIO, with_enriched

RISK0 = "coalesce(churn_risk_score, 0.0::DOUBLE)"
CLV0 = "coalesce(estimated_clv, 0.0::DOUBLE)"
THR_RISK = f"thr_risk AS (SELECT quantile_cont({RISK0}, 0.75) AS t FROM enriched)"
THR_CLV = f"thr_clv AS (SELECT quantile_cont({CLV0}, 0.75) AS t FROM enriched)"

KPI_COLS = f"""count(*) AS total_customers,
  {R(RATIO("count(*) FILTER (WHERE churned = 1)", "count(*)") + " * 100.0::DOUBLE", 2)} AS churn_rate_pct,
  {R(f"coalesce({DAVG('estimated_clv')}, 0.0::DOUBLE)", 4)} AS avg_clv,
  {R(f"coalesce({DSUM('CASE WHEN churned = 1 THEN estimated_clv END')}, 0.0::DOUBLE)", 4)} AS revenue_at_risk,
  {R(f"coalesce({DAVG('churn_risk_score')}, 0.0::DOUBLE)", 4)} AS avg_churn_risk_score,
  {R(f"coalesce({DAVG('satisfaction_score')}, 0.0::DOUBLE)", 4)} AS avg_satisfaction_score"""

KPI_CTE = f"kpi AS (SELECT {KPI_COLS} FROM enriched)"


def breakdown_cte(canonical: str, col: str, name: str | None = None) -> str:
    return (f"{name or 'b_' + canonical} AS (SELECT CAST({col} AS VARCHAR) AS {canonical}, "
            f"{R('avg(CAST(churned AS DOUBLE)) * 100.0::DOUBLE', 2)} AS churn_rate_pct, count(*) AS customers "
            f"FROM enriched WHERE {col} IS NOT NULL GROUP BY {col})")


DIM_COL = {"region": "region", "customer_segment": "customer_segment", "plan_type": "plantype"}

CONC_CTE = f"""per AS (SELECT CAST(region AS VARCHAR) AS g, count(*) FILTER (WHERE churned = 1) AS cnt
                FROM enriched GROUP BY region),
best AS (SELECT g, cnt FROM per WHERE g IS NOT NULL AND cnt > 0 ORDER BY cnt DESC, g ASC LIMIT 1),
conc AS (SELECT coalesce((SELECT g FROM best), 'Unknown') AS top_region,
                CAST(coalesce((SELECT cnt FROM best), 0) AS BIGINT) AS customer_count,
                CASE WHEN (SELECT cnt FROM best) IS NULL THEN 0.0::DOUBLE
                     ELSE {R(RATIO('(SELECT cnt FROM best)', '(SELECT sum(cnt) FROM per)') + ' * 100.0::DOUBLE', 2)}
                END AS pct_of_total)"""

SQL = {}

SQL["kpi_summary"] = with_enriched() + f"SELECT {KPI_COLS} FROM enriched"

for _canon, _col in DIM_COL.items():
    _key = {"region": "churn_by_region", "customer_segment": "churn_by_segment", "plan_type": "churn_by_plan"}[_canon]
    SQL[_key] = with_enriched(breakdown_cte(_canon, _col, "b")) + "SELECT * FROM b"

SQL["churn_by_region_sorted"] = with_enriched(breakdown_cte("region", "region", "b")) + \
    f"SELECT region, {R('churn_rate_pct', 1)} AS churn_rate_pct_1dp FROM b"

SQL["clv_risk_quantiles"] = with_enriched() + "SELECT " + ", ".join(
    [f"{R(f'quantile_cont({CLV0}, {p / 100})', 6)} AS clv_p{p}" for p in (25, 50, 75)] +
    [f"{R(f'quantile_cont({RISK0}, {p / 100})', 6)} AS risk_p{p}" for p in (25, 50, 75)]) + " FROM enriched"

SQL["revenue_at_risk_top_quartile"] = with_enriched(THR_RISK) + f"""
SELECT {R('any_value(thr_risk.t)', 6)} AS risk_p75,
  {R(f"coalesce({DSUM(f'CASE WHEN {RISK0} >= thr_risk.t THEN {CLV0} END')}, 0.0::DOUBLE)", 4)} AS revenue_at_risk,
  count(*) FILTER (WHERE {RISK0} >= thr_risk.t) AS high_risk_customers
FROM enriched, thr_risk"""

SQL["high_value_customers"] = with_enriched(THR_CLV) + f"""
SELECT {R('any_value(thr_clv.t)', 6)} AS clv_p75,
  count(*) FILTER (WHERE {CLV0} > thr_clv.t) AS high_value_customers,
  {R(RATIO(f"count(*) FILTER (WHERE {CLV0} > thr_clv.t)", "count(*)") + " * 100.0::DOUBLE", 2)} AS high_value_pct
FROM enriched, thr_clv"""

SQL["churn_concentration"] = with_enriched(CONC_CTE) + "SELECT * FROM conc"

SQL["risk_concentration"] = with_enriched(THR_RISK, CONC_CTE.replace(
    "count(*) FILTER (WHERE churned = 1)", f"count(*) FILTER (WHERE {RISK0} >= (SELECT t FROM thr_risk))")) + \
    "SELECT * FROM conc"

SEG_SELECT = f"""SELECT CAST(region AS VARCHAR) AS region, CAST(customer_segment AS VARCHAR) AS customer_segment,
  CAST(plantype AS VARCHAR) AS plan_type, count(*) AS customer_count,
  {R(DAVG(RISK0), 4)} AS avg_churn_risk_score,
  {R('coalesce(avg(CAST(churned AS DOUBLE)), 0.0::DOUBLE) * 100.0::DOUBLE', 2)} AS churn_rate,
  {R(DSUM(CLV0), 4)} AS total_clv,
  {R(f"coalesce({DSUM(f'CASE WHEN {RISK0} >= thr_risk.t THEN {CLV0} END')}, 0.0::DOUBLE)", 4)} AS revenue_at_risk
FROM enriched, thr_risk
WHERE region IS NOT NULL AND customer_segment IS NOT NULL AND plantype IS NOT NULL
GROUP BY region, customer_segment, plantype"""

SQL["risk_segments"] = with_enriched(THR_RISK) + SEG_SELECT
SQL["risk_segments_top20"] = with_enriched(THR_RISK) + SEG_SELECT + \
    "\nORDER BY revenue_at_risk DESC, region, customer_segment, plan_type LIMIT 20"

SQL["enhanced_kpis"] = with_enriched(THR_RISK, THR_CLV, CONC_CTE) + f"""
SELECT {KPI_COLS},
  {R(f"coalesce({DSUM(f'CASE WHEN {RISK0} >= (SELECT t FROM thr_risk) THEN {CLV0} END')}, 0.0::DOUBLE)", 4)} AS biz_revenue_at_risk,
  count(*) FILTER (WHERE {CLV0} > (SELECT t FROM thr_clv)) AS high_value_customers,
  {R(RATIO(f"count(*) FILTER (WHERE {CLV0} > (SELECT t FROM thr_clv))", "count(*)") + " * 100.0::DOUBLE", 2)} AS high_value_pct,
  (SELECT top_region FROM conc) AS top_region,
  (SELECT customer_count FROM conc) AS top_region_count,
  (SELECT pct_of_total FROM conc) AS pct_of_total_churned,
  {R('(SELECT t FROM thr_risk)', 6)} AS risk_p75
FROM enriched"""

_ENH = SQL["enhanced_kpis"][len(with_enriched(THR_RISK, THR_CLV, CONC_CTE)):]
SQL["enhanced_kpi_segments"] = with_enriched(THR_RISK, THR_CLV, CONC_CTE, f"enh AS ({_ENH})", f"seg AS ({SEG_SELECT})") + """
SELECT seg.*, """ + ", ".join(f"enh.{c} AS portfolio_{c}" for c in (
    "total_customers", "churn_rate_pct", "biz_revenue_at_risk", "high_value_customers", "top_region")) + """
FROM seg, enh ORDER BY revenue_at_risk DESC, region, customer_segment, plan_type LIMIT 20"""

_RL = ("CASE WHEN {x} >= 25 THEN 'Critical' WHEN {x} >= 20 THEN 'High' WHEN {x} >= 15 THEN 'Elevated' "
       "ELSE 'Moderate' END")

SQL["recovery_projection"] = with_enriched(KPI_CTE) + f"""
SELECT total_customers, churn_rate_pct, revenue_at_risk,
  {_RL.format(x='churn_rate_pct')} AS risk_level,
  CASE WHEN churn_rate_pct >= 25 THEN 30 WHEN churn_rate_pct >= 20 THEN 25 ELSE 20 END AS recovery_pct,
  {R("revenue_at_risk * CASE WHEN churn_rate_pct >= 25 THEN 30 WHEN churn_rate_pct >= 20 THEN 25 ELSE 20 END / 100.0::DOUBLE", 2)} AS expected_recovery,
  {R("greatest(churn_rate_pct * 0.75::DOUBLE, 8.0::DOUBLE)", 2)} AS target_churn_pct,
  {R("avg_clv * total_customers / 100.0::DOUBLE", 2)} AS value_per_churn_point,
  CAST(floor(total_customers * churn_rate_pct / 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS churned_customers,
  CAST(floor(floor(total_customers * churn_rate_pct / 100.0::DOUBLE + 0.5::DOUBLE) * 0.3::DOUBLE) AS BIGINT) AS outreach_size,
  {R("revenue_at_risk * 0.35::DOUBLE", 2)} AS revenue_target
FROM kpi"""

SQL["churn_counts"] = with_enriched(KPI_CTE) + f"""
SELECT total_customers, churn_rate_pct,
  CAST(floor(total_customers * churn_rate_pct / 100.0::DOUBLE) AS BIGINT) AS churned,
  total_customers - CAST(floor(total_customers * churn_rate_pct / 100.0::DOUBLE) AS BIGINT) AS retained,
  {R("100.0::DOUBLE - churn_rate_pct", 2)} AS retention_rate_pct,
  {_RL.format(x='churn_rate_pct')} AS risk_level
FROM kpi"""

SQL["combined_exposure"] = with_enriched(THR_RISK) + f"""
SELECT {R(f"coalesce({DSUM('CASE WHEN churned = 1 THEN estimated_clv END')}, 0.0::DOUBLE)", 4)} AS churned_clv,
  {R(f"coalesce({DSUM(f'CASE WHEN {RISK0} >= (SELECT t FROM thr_risk) THEN {CLV0} END')}, 0.0::DOUBLE)", 4)} AS top_quartile_clv,
  {R(R(f"coalesce({DSUM('CASE WHEN churned = 1 THEN estimated_clv END')}, 0.0::DOUBLE)", 4) + " + " +
     R(f"coalesce({DSUM(f'CASE WHEN {RISK0} >= (SELECT t FROM thr_risk) THEN {CLV0} END')}, 0.0::DOUBLE)", 4), 4)} AS combined_exposure
FROM enriched"""

for _canon, _short in (("region", "region"), ("customer_segment", "segment")):
    _col = DIM_COL[_canon]
    SQL[f"{_short}_spread"] = with_enriched(breakdown_cte(_canon, _col, "b")) + f"""
SELECT arg_min({_canon}, (-churn_rate_pct, {_canon})) AS worst, max(churn_rate_pct) AS worst_rate,
  arg_min({_canon}, (churn_rate_pct, {_canon})) AS best, min(churn_rate_pct) AS best_rate,
  {R("max(churn_rate_pct) - min(churn_rate_pct)", 2)} AS spread_pp, count(*) AS groups
FROM b"""
    SQL[f"{_short}_ranking"] = with_enriched(breakdown_cte(_canon, _col, "b"), KPI_CTE) + f"""
SELECT * FROM (
  SELECT CAST(row_number() OVER (ORDER BY churn_rate_pct DESC, {_canon} ASC) AS INTEGER) AS rank, {_canon}, churn_rate_pct,
    {R("churn_rate_pct - (SELECT churn_rate_pct FROM kpi)", 2)} AS diff_pp,
    CASE WHEN churn_rate_pct - (SELECT churn_rate_pct FROM kpi) > 2.0 THEN 'above'
         WHEN churn_rate_pct - (SELECT churn_rate_pct FROM kpi) < -2.0 THEN 'below' ELSE '' END AS flag
  FROM b)"""
    SQL[f"{_short}_estimates"] = with_enriched(breakdown_cte(_canon, _col, "b"), KPI_CTE) + f"""
SELECT CAST(row_number() OVER (ORDER BY b.churn_rate_pct DESC, b.{_canon} ASC) AS INTEGER) AS rank, b.{_canon}, b.churn_rate_pct,
  count(*) OVER () AS groups,
  {R("b.churn_rate_pct - kpi.churn_rate_pct", 2)} AS deviation_pp,
  CAST(floor(kpi.total_customers * b.churn_rate_pct / 100.0::DOUBLE / greatest(count(*) OVER (), 1)) AS BIGINT) AS est_customers,
  {R("kpi.revenue_at_risk * b.churn_rate_pct / greatest(kpi.churn_rate_pct, 0.001::DOUBLE) / greatest(count(*) OVER (), 1)", 2)} AS est_revenue,
  CASE WHEN b.churn_rate_pct >= 25 THEN 'Critical' WHEN b.churn_rate_pct >= 20 THEN 'High' ELSE 'Moderate' END AS risk_level
FROM b, kpi"""

_MANY = "(state || '-' || customer_id * 7 % 499)"
for _key in ("ranking", "estimates"):
    SQL[f"many_group_{_key}"] = SQL[f"region_{_key}"].replace(breakdown_cte("region", DIM_COL["region"], "b"), breakdown_cte("region", _MANY, "b"))

_PCT = "CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0::DOUBLE"
SQL["churn_drivers"] = with_enriched(
    KPI_CTE, breakdown_cte("customer_segment", "customer_segment", "bs"), breakdown_cte("region", "region", "br"),
    f"""m AS (SELECT {R(_PCT.format(c='CAST(tenuremonths AS DOUBLE) < 6.0'), 2)} AS pct_new,
         {R(DAVG('CAST(supporttickets AS DOUBLE)'), 4)} AS avg_comp,
         {R(_PCT.format(c='CAST(paymentdelaydays AS DOUBLE) > 0.0'), 2)} AS pct_pay,
         (SELECT avg_satisfaction_score FROM kpi) AS avg_sat, (SELECT churn_rate_pct FROM kpi) AS churn_pct,
         (SELECT arg_min(customer_segment, (-churn_rate_pct, customer_segment)) FROM bs) AS seg_k,
         (SELECT max(churn_rate_pct) FROM bs) AS seg_v,
         (SELECT arg_min(region, (-churn_rate_pct, region)) FROM br) AS reg_k,
         (SELECT max(churn_rate_pct) FROM br) AS reg_v
       FROM enriched)""",
    f"""d AS (
  SELECT 1 AS ord, 'early_lifecycle' AS driver, 'tenuremonths' AS subject, pct_new AS value, 20.0::DOUBLE AS threshold,
         coalesce(pct_new > 20.0, false) AS fired FROM m
  UNION ALL SELECT 2, 'service_quality', 'supporttickets', avg_comp, 1.5::DOUBLE, coalesce(avg_comp > 1.5, false) FROM m
  UNION ALL SELECT 3, 'payment_friction', 'paymentdelaydays', pct_pay, 10.0::DOUBLE, coalesce(pct_pay > 10.0, false) FROM m
  UNION ALL SELECT 4, 'low_satisfaction', 'satisfaction', avg_sat, 6.0::DOUBLE, avg_sat > 0.0 AND avg_sat < 6.0 FROM m
  UNION ALL SELECT 5, 'segment_concentration', seg_k, seg_v,
         {R("(seg_v - churn_pct) / greatest(churn_pct, 0.01::DOUBLE) * 100.0::DOUBLE", 2)}, seg_k IS NOT NULL FROM m
  UNION ALL SELECT 6, 'geographic_concentration', reg_k, reg_v, churn_pct, reg_k IS NOT NULL FROM m)""") + """
SELECT *, fired AND coalesce(sum(CAST(fired AS INTEGER)) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS kept
FROM d"""

# --- F25: ad-hoc insights ---------------------------------------------------
_PORT = f"""port AS (SELECT {R('avg(CAST(churned AS DOUBLE)) * 100.0::DOUBLE', 2)} AS churn_pct,
  CAST(sum(CAST(churned AS DOUBLE)) AS DOUBLE) AS churned_total,
  {R(f"coalesce({DSUM('CASE WHEN CAST(churned AS DOUBLE) = 1.0 THEN estimated_clv END')}, 0.0::DOUBLE)", 2)} AS churned_clv
  FROM enriched)"""


def _adhoc_dim(dim: str, col: str) -> str:
    return f"""SELECT '{dim}' AS dimension, '{col}' AS "column", rank, grp, churn_pct, n, groups FROM (
  SELECT grp, churn_pct, n, CAST(row_number() OVER (ORDER BY churn_pct DESC, grp ASC) AS INTEGER) AS rank, count(*) OVER () AS groups
  FROM (SELECT CAST({col} AS VARCHAR) AS grp, {R('avg(CAST(churned AS DOUBLE)) * 100.0::DOUBLE', 2)} AS churn_pct,
        count(*) AS n FROM enriched WHERE {col} IS NOT NULL GROUP BY {col}))"""


SQL["adhoc_insights"] = with_enriched(_PORT) + f"""
SELECT d.*, p.churn_pct AS portfolio_churn_pct, p.churned_total, p.churned_clv
FROM ({_adhoc_dim('region', 'region')} UNION ALL {_adhoc_dim('segment', 'customer_segment')}) d, port p"""

SQL["adhoc_numeric_fallback"] = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", {R(f'avg(CAST({c} AS DOUBLE))', 4)} AS mean, {R(f'stddev_samp(CAST({c} AS DOUBLE))', 4)} AS std,
  min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max FROM lineitem"""
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
