"""Oracle SQL (DuckDB dialect) for cohorts, NBA rules, priority list and what-if."""

from ebbtide.checks.oracle_kpis import CLV0, KPI_CTE, RISK0, THR_CLV, THR_RISK, breakdown_cte
from ebbtide.checks.sqlbase import _PD, DAVG, DSUM, R, RATIO, with_enriched

SQL = {}

# --- cohorts ----------------------------------------------------------------
FILTERS = {"region": " asia ", "customer_segment": "Building", "contract_type": "one year", "city_tier": "1"}
_FILTER_WHERE = ("lower(trim(CAST(region AS VARCHAR))) = 'asia' AND lower(trim(CAST(customer_segment AS VARCHAR))) = "
                 "'building' AND lower(trim(CAST(contract_type AS VARCHAR))) = 'one year'")
ENRICHED_COLS = ("customer_id, region, state, customer_segment, plantype, contract_type, tenuremonths, monthlycharges, "
                 "paymentdelaydays, supporttickets, payment_failures_12m, churned, estimated_clv, churn_risk_score, "
                 "satisfaction_score, upsell_probability, retention_offer_cost, complaints_90d")
SQL["filter_dimensions"] = with_enriched() + f"""
SELECT {ENRICHED_COLS} FROM enriched WHERE {_FILTER_WHERE} ORDER BY customer_id LIMIT 100"""
SQL["filter_total_matches"] = with_enriched() + f"""
SELECT count(*) AS total_matches, least(count(*), 100) AS returned_rows,
  'contract_type=one year,customer_segment=Building,region= asia ' AS filters_applied
FROM enriched WHERE {_FILTER_WHERE}"""

_COH = f"customer_id, {RISK0} AS churn_risk_score, {CLV0} AS estimated_clv"
SQL["high_risk_cohort"] = with_enriched(THR_RISK) + \
    f"SELECT {_COH} FROM enriched WHERE {RISK0} >= (SELECT t FROM thr_risk)"
SQL["high_value_cohort"] = with_enriched(THR_CLV) + \
    f"SELECT {_COH} FROM enriched WHERE {CLV0} > (SELECT t FROM thr_clv)"
SQL["churned_cohort"] = with_enriched() + f"SELECT {_COH} FROM enriched WHERE churned = 1"


def seg_pred(target: str) -> str:
    v = target.strip().lower()
    if v in ("all", ""):
        return "true"
    return " OR ".join(f"coalesce(contains(lower(CAST({c} AS VARCHAR)), '{v}'), false)"
                       for c in ("region", "customer_segment", "plantype"))


SQL["segment_contains"] = with_enriched() + f"SELECT {_COH} FROM enriched WHERE {seg_pred('asia')}"


def eff_sql(t: float) -> str:
    return (f"(SELECT CASE WHEN count(*) = 0 THEN {float(t)!r}::DOUBLE WHEN max({RISK0}) >= {float(t)!r}::DOUBLE "
            f"THEN {float(t)!r}::DOUBLE ELSE quantile_cont({RISK0}, 0.75) END FROM enriched)")


AUTO_THRESHOLDS = [0.6, 0.9, 1.0]
SQL["at_risk_auto_threshold"] = with_enriched() + "\nUNION ALL\n".join(
    f"""SELECT {float(t)!r}::DOUBLE AS input_threshold, {R(eff_sql(t), 6)} AS effective_threshold,
  {eff_sql(t)} <> {float(t)!r}::DOUBLE AS adjusted,
  count(*) FILTER (WHERE {RISK0} >= {eff_sql(t)}) AS cohort_size FROM enriched""" for t in AUTO_THRESHOLDS)

SQL["row_text_search"] = with_enriched() + f"""
SELECT customer_id, region, customer_segment, plantype, estimated_clv, churn_risk_score FROM enriched
WHERE contains(lower(concat_ws(chr(1), {", ".join(f"CAST({c.strip()} AS VARCHAR)" for c in ENRICHED_COLS.split(","))})), 'machinery')"""

SQL["risk_band_counts"] = with_enriched() + f"""
SELECT CASE WHEN {RISK0} >= 0.65 THEN 'High' WHEN {RISK0} >= 0.35 THEN 'Medium' ELSE 'Low' END AS risk_band,
  count(*) AS customers FROM enriched GROUP BY 1"""

# --- NBA --------------------------------------------------------------------
from ebbtide.operators.nba import ACTIONS as _NBA_ACTIONS  # noqa: E402

ACTIONS = [(a, p, c, sr) for a, p, c, sr, _reason in _NBA_ACTIONS]
_RATE = "CASE recommendation " + " ".join(f"WHEN '{a}' THEN {s!r}::DOUBLE" for a, _, _, s in ACTIONS) + \
    " ELSE 0.05::DOUBLE END"
NBA_CTES = [
    f"thr_nba AS (SELECT coalesce(quantile_cont(CAST(estimated_clv AS DOUBLE), 0.75), 5000.0::DOUBLE) AS t FROM enriched)",
    """inp AS (SELECT customer_id,
    coalesce(CAST(churn_risk_score AS DOUBLE), 0.0::DOUBLE) AS churn_risk_score,
    coalesce(CAST(estimated_clv AS DOUBLE), 0.0::DOUBLE) AS estimated_clv,
    coalesce(CAST(upsell_probability AS DOUBLE), 0.0::DOUBLE) AS upsell_probability,
    coalesce(CAST(retention_offer_cost AS DOUBLE), 0.0::DOUBLE) AS retention_offer_cost,
    CAST(trunc(coalesce(CAST(complaints_90d AS DOUBLE), 0.0::DOUBLE)) AS BIGINT) AS complaints_90d,
    CAST(trunc(coalesce(CAST(payment_failures_12m AS DOUBLE), 0.0::DOUBLE)) AS BIGINT) AS payment_failures_12m,
    coalesce(CAST(satisfaction_score AS DOUBLE), 5.0::DOUBLE) AS satisfaction_score
  FROM enriched)""",
    """rec0 AS (SELECT inp.*, CASE
    WHEN churn_risk_score >= 0.65 AND estimated_clv >= thr_nba.t THEN 'Premium Retention Offer'
    WHEN churn_risk_score >= 0.65 AND complaints_90d >= 3 THEN 'Service Recovery Call'
    WHEN churn_risk_score >= 0.65 AND payment_failures_12m >= 2 THEN 'Payment Support Plan'
    WHEN churn_risk_score < 0.35 AND upsell_probability >= 0.65 THEN 'Upsell Premium Plan'
    WHEN satisfaction_score <= 4.0 THEN 'CX Intervention'
    ELSE 'Monitor' END AS recommendation FROM inp, thr_nba)""",
    f"rec AS (SELECT *, {R(f'estimated_clv * churn_risk_score * {_RATE}', 2)} AS expected_revenue_protected FROM rec0)",
]
SQL["nba_recommendations"] = with_enriched(*NBA_CTES) + "SELECT * FROM rec"

def _dim_values():
    from ebbtide.operators.nba import ACTIONS as FULL
    return "dim(recommendation, priority, confidence, reason) AS (VALUES " + ", ".join(
        f"('{a}', '{p}', {c!r}::DOUBLE, '{t}')" for a, p, c, _, t in FULL) + ")"


SQL["nba_dimension_join"] = with_enriched(*NBA_CTES, _dim_values()) + """
SELECT rec.customer_id, rec.recommendation, dim.priority, dim.confidence, rec.expected_revenue_protected, dim.reason
FROM rec LEFT JOIN dim ON rec.recommendation = dim.recommendation"""
SQL["strategy_summary"] = with_enriched(*NBA_CTES) + f"""
SELECT recommendation AS strategy, count(*) AS customer_count,
  {R(RATIO('count(*)', 'sum(count(*)) OVER ()') + ' * 100.0::DOUBLE', 2)} AS pct_of_total,
  {R(f"coalesce({DSUM('expected_revenue_protected')}, 0.0::DOUBLE)", 2)} AS total_revenue_protected
FROM rec GROUP BY recommendation"""
SQL["nba_batch_totals"] = with_enriched(*NBA_CTES) + f"""
SELECT count(*) AS total_customers,
  {R(f"coalesce({DSUM('expected_revenue_protected')}, 0.0::DOUBLE)", 2)} AS total_revenue_protected FROM rec"""
BAD_CTE = """bad AS (SELECT customer_id,
    CASE WHEN customer_id % 7 = 0 THEN 1.5::DOUBLE ELSE churn_risk_score END AS churn_risk_score,
    CASE WHEN customer_id % 11 = 0 THEN NULL ELSE estimated_clv END AS estimated_clv,
    CASE WHEN customer_id % 13 = 0 THEN 1.5::DOUBLE ELSE upsell_probability END AS upsell_probability,
    CASE WHEN customer_id % 17 = 0 THEN -3.0::DOUBLE ELSE retention_offer_cost END AS retention_offer_cost,
    CASE WHEN customer_id % 19 = 0 THEN -1 ELSE complaints_90d END AS complaints_90d,
    payment_failures_12m,
    CASE WHEN customer_id % 23 = 0 THEN 10.5::DOUBLE ELSE satisfaction_score END AS satisfaction_score FROM enriched)"""


def _reasons(src: str) -> str:
    parts = []
    for c, hi in (("churn_risk_score", 1), ("estimated_clv", None), ("upsell_probability", 1), ("retention_offer_cost", None),
                  ("complaints_90d", None), ("payment_failures_12m", None), ("satisfaction_score", 10)):
        out = f"{c} < 0" + (f" OR {c} > {hi}" if hi else "")
        parts.append(f"CASE WHEN {c} IS NULL THEN '{c} missing' WHEN {out} THEN '{c} out of range' END")
    return f"SELECT customer_id, concat_ws('; ', {', '.join(parts)}) AS reasons FROM {src}"


SQL["nba_input_validation"] = with_enriched(f"v AS ({_reasons('enriched')})") + """
SELECT count(*) AS total, count(*) FILTER (WHERE reasons = '') AS valid, count(*) FILTER (WHERE reasons <> '') AS rejected
FROM v"""
SQL["nba_rejected_rows"] = with_enriched(BAD_CTE, f"v AS ({_reasons('bad')})") + "SELECT * FROM v WHERE reasons <> ''"
_N = {a: f"count(*) FILTER (WHERE recommendation = '{a}')" for a, *_ in ACTIONS}
SQL["nba_portfolio_triage"] = with_enriched(*NBA_CTES) + f"""
, t AS (SELECT count(*) AS total_customers, coalesce({DSUM('expected_revenue_protected')}, 0.0::DOUBLE) AS protected, {", ".join(f"{_N[a]} AS n{i}" for i, (a, *_x) in enumerate(ACTIONS))} FROM rec)
SELECT total_customers,
  CASE {" ".join(f"WHEN n{i} = greatest({', '.join(f'n{j}' for j in range(6))}) THEN '{a}'" for i, (a, *_x) in enumerate(ACTIONS))} END AS dominant_action,
  n0 + n1 AS critical_customers, n3 AS growth_customers,
  CASE WHEN {RATIO('n0 + n1', 'total_customers')} > 0.25 THEN 'Critical'
       WHEN {RATIO('n0 + n1', 'total_customers')} > 0.15 THEN 'High' ELSE 'Elevated' END AS risk_level,
  CASE WHEN total_customers >= 500 THEN 'High' ELSE 'Medium' END AS confidence,
  {R('protected', 2)} AS revenue_protected, {R('protected * 0.3::DOUBLE', 2)} AS projected_recovery,
  {R('protected * 0.15::DOUBLE', 2)} AS upsell_opportunity, {R('protected * 0.08::DOUBLE', 2)} AS projected_upsell
FROM t"""

# --- priority ---------------------------------------------------------------
COMP0 = "coalesce(CAST(complaints_90d AS DOUBLE), 0.0::DOUBLE)"
_NC = (f"CASE WHEN mm.hi_c > mm.lo_c THEN least(greatest(({CLV0} - mm.lo_c) / (mm.hi_c - mm.lo_c), 0.0::DOUBLE), "
       f"1.0::DOUBLE) ELSE 0.0::DOUBLE END")
_NK = (f"CASE WHEN mm.hi_k > mm.lo_k THEN least(greatest(({COMP0} - mm.lo_k) / (mm.hi_k - mm.lo_k), 0.0::DOUBLE), "
       f"1.0::DOUBLE) ELSE 0.0::DOUBLE END")
PRIO_CTES = [
    f"mm AS (SELECT min({CLV0}) AS lo_c, max({CLV0}) AS hi_c, min({COMP0}) AS lo_k, max({COMP0}) AS hi_k FROM enriched)",
    f"""sc AS (SELECT customer_id, coalesce(CAST(region AS VARCHAR), 'Unknown') AS region,
    coalesce(CAST(customer_segment AS VARCHAR), 'Unknown') AS customer_segment,
    coalesce(CAST(plantype AS VARCHAR), 'Unknown') AS plan_type,
    {CLV0} AS estimated_clv, {RISK0} AS churn_risk_score, CAST(trunc({COMP0}) AS BIGINT) AS complaints_90d,
    {R(_NC, 4)} AS norm_clv, {R(_NK, 4)} AS norm_complaints,
    {R(f"least(greatest({RISK0} * 0.5::DOUBLE + ({_NC}) * 0.3::DOUBLE + ({_NK}) * 0.2::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)", 4)} AS priority_score
  FROM enriched, mm)""",
]
SQL["minmax_normalize"] = with_enriched(*PRIO_CTES) + "SELECT customer_id, norm_clv, norm_complaints FROM sc"
SQL["priority_score"] = with_enriched(*PRIO_CTES) + "SELECT customer_id, priority_score FROM sc"

from ebbtide.operators.priority import PRIORITY_ACTION as PRIORITY_TEXT  # noqa: E402


def top_ctes(n: int, name: str = "pl", where: str = "true") -> list[str]:
    return [
        f"top_{name} AS (SELECT * FROM sc WHERE {where} ORDER BY priority_score DESC, customer_id ASC LIMIT {n})",
        f"""q_{name} AS (SELECT quantile_cont(priority_score, 0.8) AS hi,
                 quantile_cont(priority_score, 0.35) AS med FROM top_{name})""",
        f"""{name} AS (SELECT customer_id, region, customer_segment, plan_type, estimated_clv, churn_risk_score,
    complaints_90d, priority_score,
    CASE WHEN priority_score >= hi THEN 'High Priority' WHEN priority_score >= med THEN 'Medium Priority'
         ELSE 'Low Priority' END AS priority_class
  FROM top_{name}, q_{name})""",
        f"""{name}x AS (SELECT *, CASE priority_class {" ".join(f"WHEN '{c}' THEN '{a}'" for c, a, _ in PRIORITY_TEXT)} END AS recommended_action,
    CASE priority_class {" ".join(f"WHEN '{c}' THEN '{t}'" for c, _, t in PRIORITY_TEXT)} END AS rationale FROM {name})""",
    ]


SQL["priority_list"] = with_enriched(*PRIO_CTES, *top_ctes(500)) + "SELECT * FROM plx"
SQL["priority_class_counts"] = with_enriched(*PRIO_CTES, *top_ctes(500)) + \
    "SELECT priority_class, count(*) AS customers FROM pl GROUP BY priority_class"
SQL["priority_list_filtered"] = with_enriched(*PRIO_CTES, *top_ctes(20, where="contains(lower(customer_segment), 'auto')")) + \
    "SELECT * FROM plx"
SQL["top_high_risk"] = with_enriched() + f"""
SELECT customer_id, CAST(region AS VARCHAR) AS region, {RISK0} AS churn_risk_score, {CLV0} AS estimated_clv
FROM enriched WHERE contains(lower(region), 'europe') ORDER BY churn_risk_score DESC, customer_id LIMIT 10"""
SQL["sorted_page"] = with_enriched() + """
SELECT customer_id, region, customer_segment, plantype, estimated_clv, churn_risk_score, satisfaction_score,
  complaints_90d FROM enriched ORDER BY estimated_clv DESC NULLS LAST, customer_id LIMIT 100"""
SQL["risk_clv_scatter"] = with_enriched() + f"""
SELECT customer_id, {R('CAST(estimated_clv AS DOUBLE)', 0)} AS clv, {R('CAST(churn_risk_score AS DOUBLE)', 3)} AS risk
FROM enriched WHERE estimated_clv IS NOT NULL AND churn_risk_score IS NOT NULL"""
SQL["segment_strategy"] = with_enriched(
    KPI_CTE, breakdown_cte("customer_segment", "customer_segment", "b"), *PRIO_CTES, *top_ctes(50)) + f"""
, q AS (SELECT customer_segment, count(*) AS queue_members FROM pl GROUP BY customer_segment)
SELECT b.customer_segment, b.churn_rate_pct, {R('b.churn_rate_pct - (SELECT churn_rate_pct FROM kpi)', 2)} AS vs_average_pp,
  coalesce(q.queue_members, 0) AS queue_members
FROM b LEFT JOIN q ON b.customer_segment = q.customer_segment"""


def _trunc(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '…' ELSE {x} END"


SQL["action_truncate"] = with_enriched(*PRIO_CTES, *top_ctes(10)) + \
    f"SELECT customer_id, {_trunc('recommended_action', 30)} AS action, {_trunc('rationale', 40)} AS rationale_short FROM plx"


# --- what-if ----------------------------------------------------------------
def finish_ctes(ids: str, has_fee: bool = True) -> list[str]:
    g1 = """g1 AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE fee_sum / CAST(n AS DOUBLE) END AS avg_fee,
      CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE risk_sum / CAST(n AS DOUBLE) END AS avg_risk FROM g)"""
    g2 = """g2 AS (SELECT *, CASE WHEN avg_fee * offer_discount_pct / 100.0::DOUBLE <= 0 THEN 500.0::DOUBLE
      ELSE avg_fee * offer_discount_pct / 100.0::DOUBLE END AS offer FROM g1)"""
    g3 = """g3 AS (SELECT *, CAST(CASE WHEN n = 0 THEN 0 ELSE least(floor(retention_budget / offer), n) END AS BIGINT) AS reach FROM g2)"""
    g4 = """g4 AS (SELECT *, CAST(floor(reach * expected_success_rate) AS BIGINT) AS saved FROM g3)"""
    g5 = """g5 AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE rev / CAST(greatest(n, 1) AS DOUBLE) * saved END AS rev_saved FROM g4)"""
    g6 = f"""g6 AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {R('rev_saved / greatest(retention_budget, 1.0::DOUBLE)', 2)} END AS roi FROM g5)"""
    conf = ("CASE WHEN n >= 200 AND " + ("true" if has_fee else "false") +
            " THEN 'High' WHEN n >= 50 THEN 'Medium' ELSE 'Low' END")
    roi_lbl = ("CASE WHEN roi >= 50 THEN 'Excellent' WHEN roi >= 20 THEN 'Strong' WHEN roi >= 5 THEN 'Good' "
               "WHEN roi >= 1 THEN 'Marginal' ELSE 'Negative' END")
    final = f"""grid AS (SELECT {ids}, target_segment, risk_threshold, {R('effective_threshold', 6)} AS effective_threshold,
  effective_threshold <> risk_threshold AS threshold_adjusted, retention_budget, offer_discount_pct,
  expected_success_rate, n AS affected_customers, {R('rev', 2)} AS current_revenue_at_risk,
  {R('avg_fee', 2)} AS avg_monthly_fee, {R('avg_risk', 4)} AS avg_churn_risk_score,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {R('offer', 2)} END AS avg_offer_cost,
  reach AS customers_reachable, saved AS expected_customers_saved, {R('rev_saved', 2)} AS expected_revenue_saved,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {R('reach * offer', 2)} END AS total_spend, roi AS estimated_roi,
  CASE WHEN n = 0 THEN 'N/A' ELSE {roi_lbl} END AS roi_label,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE {R('reach / CAST(greatest(n, 1) AS DOUBLE) * 100.0::DOUBLE', 2)} END AS coverage_pct,
  CASE WHEN n = 0 THEN 'Low' ELSE {conf} END AS confidence_level FROM g6)"""
    return [g1, g2, g3, g4, g5, g6, final]


def grid_sql(scenarios, has_fee: bool = True) -> str:
    FEE0 = "coalesce(CAST(monthlycharges AS DOUBLE), 0.0::DOUBLE)"
    parts = []
    for i, s in enumerate(scenarios):
        eff = eff_sql(s.risk_threshold)
        hit = f"({RISK0} >= {eff}) AND ({seg_pred(s.target_segment)})"
        parts.append(f"""SELECT {i} AS scenario_id, '{s.target_segment}' AS target_segment,
  {float(s.risk_threshold)!r}::DOUBLE AS risk_threshold, {eff} AS effective_threshold,
  {float(s.retention_budget)!r}::DOUBLE AS retention_budget, {float(s.offer_discount_pct)!r}::DOUBLE AS offer_discount_pct,
  {float(s.expected_success_rate)!r}::DOUBLE AS expected_success_rate,
  count(*) FILTER (WHERE {hit}) AS n,
  coalesce({DSUM(f'CASE WHEN {hit} THEN {CLV0} END')}, 0.0::DOUBLE) AS rev,
  coalesce({DSUM(f'CASE WHEN {hit} THEN {FEE0} END')}, 0.0::DOUBLE) AS fee_sum,
  coalesce({DSUM(f'CASE WHEN {hit} THEN {RISK0} END')}, 0.0::DOUBLE) AS risk_sum
FROM enriched""")
    return with_enriched("g AS (" + "\nUNION ALL\n".join(parts) + ")", *finish_ctes("scenario_id", has_fee))


def _register_whatif():
    from ebbtide.operators.whatif import Scenario, default_grid
    SQL["campaign_whatif"] = grid_sql([Scenario()]) + "SELECT * FROM grid"
    from ebbtide.checks.oracle_tagging import WHATIF_SELECT
    ask = ("'What if we offer ' || customer_id % 37 || '% discount to customers with risk > 0.' || lpad(CAST(customer_id * 131 % 1000 AS VARCHAR), 3, '0') "
           "|| ', budget $' || 50 + customer_id % 900 || 'k and ' || 5 + customer_id % 60 || '% success?'")
    SQL["whatif_messages"] = with_enriched(
        f"msgs AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT -customer_id, 0, {ask} FROM enriched)",
        f"asked AS ({WHATIF_SELECT})",
        f"""cut AS (SELECT max({RISK0}) AS top, quantile_cont({RISK0}, 0.75) AS p75 FROM enriched)""",
        """eff AS (SELECT *, CASE WHEN top IS NULL OR top >= risk_threshold THEN risk_threshold ELSE p75 END AS effective_threshold FROM asked, cut)""",
        f"""sums AS (SELECT t, count(customer_id) AS n, coalesce({DSUM(CLV0)}, 0.0) AS rev,
            coalesce({DSUM('coalesce(CAST(monthlycharges AS DOUBLE), 0.0::DOUBLE)')}, 0.0) AS fee_sum, coalesce({DSUM(RISK0)}, 0.0) AS risk_sum
            FROM (SELECT DISTINCT effective_threshold AS t FROM eff) JOIN enriched ON {RISK0} >= t GROUP BY t)""",
        """g AS (SELECT conv_id, turn, 'All' AS target_segment, risk_threshold, effective_threshold, retention_budget, offer_discount_pct,
            expected_success_rate, coalesce(n, 0) AS n, coalesce(rev, 0.0) AS rev, coalesce(fee_sum, 0.0) AS fee_sum,
            coalesce(risk_sum, 0.0) AS risk_sum FROM eff LEFT JOIN sums ON effective_threshold = t)""",
        *finish_ctes("conv_id, turn")) + "SELECT * FROM grid"
    SQL["campaign_grid"] = grid_sql(default_grid()) + "SELECT * FROM grid"
    SQL["campaign_verdict"] = grid_sql(default_grid()) + """
SELECT scenario_id,
  CASE WHEN affected_customers = 0 THEN 'adjust_filters' WHEN estimated_roi >= 20 THEN 'proceed'
       WHEN estimated_roi >= 5 THEN 'strong' WHEN estimated_roi >= 1 THEN 'marginal' ELSE 'negative' END AS roi_tier,
  CASE WHEN affected_customers = 0 THEN 'none' WHEN coverage_pct < 50 THEN 'partial'
       WHEN coverage_pct < 80 THEN 'adequate' ELSE 'full' END AS coverage_tier
FROM grid"""
    SQL["budget_projection"] = with_enriched(KPI_CTE) + "\nUNION ALL\n".join(
        f"""SELECT {b!r}::DOUBLE AS budget,
  CAST(floor({b!r}::DOUBLE / greatest(avg_clv * 0.1::DOUBLE, 1.0::DOUBLE)) AS BIGINT) AS customers_reachable,
  CAST(floor(floor({b!r}::DOUBLE / greatest(avg_clv * 0.1::DOUBLE, 1.0::DOUBLE)) * 0.18::DOUBLE) AS BIGINT) AS expected_retained,
  {R(f'floor({b!r}::DOUBLE / greatest(avg_clv * 0.1::DOUBLE, 1.0::DOUBLE)) * 0.18::DOUBLE * avg_clv', 2)} AS revenue_protected,
  {R(f'floor({b!r}::DOUBLE / greatest(avg_clv * 0.1::DOUBLE, 1.0::DOUBLE)) * 0.18::DOUBLE * avg_clv / {b!r}::DOUBLE', 4)} AS estimated_roi
FROM kpi""" for b in (250000.0, 500000.0))


_register_whatif()

# --- scored batches, enrichment, bands, formats -------------------------------
_P = "coalesce(CAST(churn_risk_score AS DOUBLE), 0.0::DOUBLE)"
_V = "CAST(estimated_clv AS DOUBLE)"
_CODE = (f"CASE WHEN {_P} >= 0.65 AND coalesce({_V}, 0.0::DOUBLE) >= 50000.0 THEN 'account_manager' "
         f"WHEN {_P} >= 0.65 THEN 'automated_sequence' WHEN {_P} >= 0.35 THEN 'monitor' ELSE 'upsell' END")
SQL["customer_playbook"] = with_enriched() + f"""
SELECT customer_id, {_P} AS churn_probability,
  CASE WHEN {_P} >= 0.75 THEN 'Critical' WHEN {_P} >= 0.55 THEN 'High' WHEN {_P} >= 0.35 THEN 'Elevated' ELSE 'Moderate' END AS risk_level,
  {_CODE} AS playbook,
  CASE {_CODE} WHEN 'account_manager' THEN 'Assign dedicated account manager'
    WHEN 'automated_sequence' THEN 'Enrol in automated retention sequence'
    WHEN 'monitor' THEN 'Monitor weekly via risk dashboard' ELSE 'Focus on upsell and expansion' END AS first_action,
  {_P} >= 0.55 AS immediate_action, {_P} >= 0.65 AS above_intervention_threshold
FROM enriched"""
SQL["batch_risk_triage"] = with_enriched() + f"""
SELECT count(*) AS total_scored, count(*) FILTER (WHERE {_P} >= 0.65) AS high_risk_count,
  count(*) FILTER (WHERE {_P} >= 0.35 AND {_P} < 0.65) AS medium_risk_count,
  count(*) FILTER (WHERE {_P} < 0.35) AS low_risk_count FROM enriched"""
_AVG = f"(coalesce({DSUM(_P)} / CAST(count(*) AS DOUBLE), 0.0::DOUBLE) * 100.0::DOUBLE)"
_CLV = f"coalesce({DSUM(f'CASE WHEN {_P} >= 0.65 THEN coalesce({_V}, 0.0::DOUBLE) END')}, 0.0::DOUBLE)"
SQL["batch_insight"] = with_enriched() + f"""
SELECT count(*) AS total, count(*) FILTER (WHERE {_P} >= 0.65) AS n_high,
  count(*) FILTER (WHERE {_P} >= 0.35 AND {_P} < 0.65) AS n_medium,
  {R(RATIO(f"count(*) FILTER (WHERE {_P} >= 0.65)", "count(*)") + " * 100.0::DOUBLE", 2)} AS high_pct,
  {R(RATIO(f"count(*) FILTER (WHERE {_P} >= 0.35 AND {_P} < 0.65)", "count(*)") + " * 100.0::DOUBLE", 2)} AS medium_pct,
  {R(_AVG, 2)} AS avg_probability_pct,
  CASE WHEN {_AVG} >= 25 THEN 'Critical' WHEN {_AVG} >= 20 THEN 'High' WHEN {_AVG} >= 15 THEN 'Elevated' ELSE 'Moderate' END AS risk_level,
  {R(_CLV, 2)} AS clv_at_risk, {R(f"{_CLV} * 0.28::DOUBLE", 2)} AS projected_recovery,
  CASE WHEN count(*) >= 100 THEN 'High' ELSE 'Medium' END AS confidence
FROM enriched"""
SQL["enrich_customers"] = with_enriched() + f"SELECT {ENRICHED_COLS} FROM enriched"
SQL["satisfaction_bands"] = with_enriched() + """
SELECT CASE WHEN s >= 8 THEN 'Excellent' WHEN s >= 7 THEN 'Good' WHEN s >= 6 THEN 'Fair' WHEN s >= 5 THEN 'Poor'
  ELSE 'Critical' END AS satisfaction_band, count(*) AS customers
FROM (SELECT coalesce(CAST(satisfaction_score AS DOUBLE), 0.0::DOUBLE) AS s FROM enriched) GROUP BY 1"""
SQL["risk_level_by_region"] = with_enriched(breakdown_cte("region", "region", "b")) + """
SELECT region, churn_rate_pct, CASE WHEN churn_rate_pct >= 25 THEN 'Critical' WHEN churn_rate_pct >= 20 THEN 'High'
  WHEN churn_rate_pct >= 15 THEN 'Elevated' ELSE 'Moderate' END AS risk_level FROM b"""

def _fmt1(x: str, suffix: str, prefix: str) -> str:
    return f"'{prefix}' || format('{{:.1f}}', {R(x, 1)}) || '{suffix}'"


_T = "total_clv"
_USD = (f"CASE WHEN {_T} >= 1e9 THEN {_fmt1(f'{_T} / 1e9', 'B', '$')} WHEN {_T} >= 1e6 THEN {_fmt1(f'{_T} / 1e6', 'M', '$')} "
        f"WHEN {_T} >= 1e3 THEN '$' || format('{{:.0f}}', {R(f'{_T} / 1e3', 0)}) || 'K' "
        f"ELSE '$' || format('{{:,}}', CAST({R(_T, 0)} AS BIGINT)) END")
_INR = (f"CASE WHEN {_T} >= 1e7 THEN {_fmt1(f'{_T} / 1e7', ' Cr', '₹')} WHEN {_T} >= 1e5 THEN {_fmt1(f'{_T} / 1e5', ' Lakh', '₹')} "
        f"ELSE '₹' || format('{{:,}}', CAST({R(_T, 0)} AS BIGINT)) END")
SQL["format_money"] = with_enriched() + f"""
SELECT region, total_clv, {_USD} AS usd, {_INR} AS inr FROM (
  SELECT CAST(region AS VARCHAR) AS region,
    {R(f"coalesce({DSUM('CAST(estimated_clv AS DOUBLE)')}, 0.0::DOUBLE)", 2)} AS total_clv
  FROM enriched WHERE region IS NOT NULL GROUP BY region)"""
def _inr(x: str, places: int, lakh: str) -> str:
    big = lambda d, sfx: f"'₹' || format('{{:.{places}f}}', {R(f'{x} / {d}', places)}) || ' {sfx}'"
    return (f"CASE WHEN {x} >= 1e7 THEN {big('1e7', 'Cr')} WHEN {x} >= 1e5 THEN {big('1e5', lakh)} "
            f"ELSE '₹' || format('{{:,}}', CAST({R(x, 0)} AS BIGINT)) END")


SQL["display_formats"] = with_enriched() + f"""
SELECT region, {_USD.replace(_T, 'avg_clv')} AS usd, {_inr('avg_clv', 2, 'Lakh')} AS inr_exact, {_inr('avg_clv', 1, 'L')} AS inr_report,
  format('{{:.1f}}', {R('churn_rate_pct', 1)}) || '%' AS churn, format('{{:,}}', n) AS customers,
  '2026-01-02 03:04:05' AS generated_at
FROM (SELECT CAST(region AS VARCHAR) AS region, {R(f"coalesce({DAVG('CAST(estimated_clv AS DOUBLE)')}, 0.0::DOUBLE)", 2)} AS avg_clv,
        {R('avg(CAST(churned AS DOUBLE)) * 100.0::DOUBLE', 2)} AS churn_rate_pct, count(*) AS n
      FROM enriched WHERE region IS NOT NULL GROUP BY region)"""
_F = ("(CAST(coalesce(CAST(paymentdelaydays AS DOUBLE), 0) > 30 AS INTEGER) + CAST(coalesce(CAST(supporttickets AS DOUBLE), 0) >= 2 AS INTEGER)"
      " + CAST(coalesce(CAST(tenuremonths AS DOUBLE), 12) < 6 AS INTEGER) + CAST(coalesce(CAST(satisfaction_score AS DOUBLE), 10) < 6 AS INTEGER))")


def _actions_sql() -> str:
    from ebbtide.operators.scoring import PLAYBOOK_ACTIONS
    money = f"CASE WHEN coalesce(v, 0) <> 0 THEN {_USD.replace(_T, 'v')} ELSE 'unknown' END"
    rows = []
    for code, texts in PLAYBOOK_ACTIONS.items():
        for k, t in enumerate(texts):
            rows.append(f"""SELECT customer_id, playbook, CASE WHEN f >= 3 THEN 'High' ELSE 'Medium' END AS confidence,
  CASE WHEN f >= 4 THEN 'High' WHEN f >= 2 THEN 'Medium' ELSE 'Low' END AS signal_confidence, CAST({k} AS INTEGER) AS position,
  replace(replace('{t}', '{{id}}', CAST(customer_id AS VARCHAR)), '{{clv}}', {money}) AS action
FROM pb WHERE playbook = '{code}'""")
    return with_enriched(f"pb AS (SELECT customer_id, {_CODE} AS playbook, {_V} AS v, {_F} AS f FROM enriched)") + "\nUNION ALL\n".join(rows)


SQL["customer_actions"] = _actions_sql()
SQL["enrich_derived_dims"] = with_enriched() + f"""
SELECT customer_id, state AS region, plantype AS customer_segment, CAST(({_PD}) > 30 AS BIGINT) AS payment_failures_12m,
  estimated_clv, churn_risk_score, satisfaction_score, complaints_90d FROM enriched"""
SQL["breakdown_map"] = with_enriched(breakdown_cte("region", "region", "b")) + \
    "SELECT CAST(to_json(map_from_entries(list(struct_pack(k := region, v := churn_rate_pct) ORDER BY region))) AS VARCHAR) AS churn_by_region FROM b"
