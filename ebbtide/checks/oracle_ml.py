"""Oracle SQL (DuckDB dialect) for the SQL-checkable parts of the ML pipeline."""

from ebbtide.checks.sqlbase import R, with_enriched

SQL = {}

ML_NUM = ["estimated_clv", "churn_risk_score", "upsell_probability", "satisfaction_score", "complaints_90d",
          "payment_failures_12m", "retention_offer_cost", "tenuremonths", "monthlycharges", "paymentdelaydays",
          "supporttickets"]
ML_CAT_PREFERRED = ["region", "state", "customer_segment", "contract_type"]
ML_CAT_OTHER = ["plantype"]

_rows = [f"SELECT {i} AS position, '{c}' AS feature, 'numeric' AS kind" for i, c in enumerate(ML_NUM)]
_rows += [f"SELECT {len(ML_NUM) + i} AS position, '{c}' AS feature, 'categorical' AS kind"
          for i, c in enumerate(ML_CAT_PREFERRED)]
_other = " UNION ALL ".join(
    f"SELECT {len(ML_NUM) + len(ML_CAT_PREFERRED) + i} AS position, '{c}' AS feature, 'categorical' AS kind "
    f"FROM enriched HAVING count(DISTINCT {c}) <= 30" for i, c in enumerate(ML_CAT_OTHER))
SQL["ml_feature_selection"] = with_enriched() + " UNION ALL ".join(_rows) + " UNION ALL " + _other

_U = "md5('42:' || CAST(customer_id AS VARCHAR))"
SPLIT_CTE = f"""sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, customer_id) <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY label) + 0.5) AS is_test
  FROM (SELECT *, CAST(CAST(churned AS DOUBLE) AS INTEGER) AS label, {_U} AS u FROM enriched))"""
SQL["stratified_split"] = with_enriched(SPLIT_CTE) + \
    "SELECT label, is_test, count(*) AS rows FROM sp GROUP BY label, is_test"
SQL["class_weights"] = with_enriched(SPLIT_CTE) + f"""
SELECT label, count(*) AS n_class,
  {R("CAST((SELECT count(*) FROM sp WHERE NOT is_test) AS DOUBLE) / (2.0::DOUBLE * CAST(count(*) AS DOUBLE))", 6)} AS weight
FROM sp WHERE NOT is_test GROUP BY label"""

SQL["median_impute"] = with_enriched() + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, {R(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 6)} AS median,
  count(*) FILTER (WHERE {c} IS NULL) AS nulls_filled FROM enriched""" for c in ML_NUM)

SQL["mode_impute"] = with_enriched() + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature,
  (SELECT arg_min(v, struct_pack(nf := -f, v := v)) FROM
     (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS f FROM enriched WHERE {c} IS NOT NULL GROUP BY 1)) AS mode,
  count(*) FILTER (WHERE {c} IS NULL) AS nulls_filled FROM enriched""" for c in ML_CAT_PREFERRED + ML_CAT_OTHER)

_AUC = f"""per AS (SELECT CAST(churn_risk_score AS DOUBLE) AS s,
    count(*) FILTER (WHERE CAST(churned AS DOUBLE) = 1.0) AS pos, count(*) FILTER (WHERE NOT (CAST(churned AS DOUBLE) = 1.0)) AS neg
  FROM enriched GROUP BY 1),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM per),
auc AS (SELECT CAST(sum(pos * neg_below + pos * neg * 0.5::DOUBLE) AS DOUBLE)
          / CAST(sum(pos) * sum(neg) AS DOUBLE) AS auc FROM cum)"""
SQL["roc_auc_rank"] = with_enriched(_AUC) + f"SELECT {R('auc', 6)} AS roc_auc FROM auc"

_Y = "(CAST(churned AS DOUBLE) = 1.0)"
_P = "(churn_risk_score >= 0.5::DOUBLE)"
SQL["classification_metrics"] = with_enriched(_AUC, f"""m AS (SELECT
  count(*) FILTER (WHERE {_Y} AND {_P}) AS tp, count(*) FILTER (WHERE NOT {_Y} AND {_P}) AS fp,
  count(*) FILTER (WHERE {_Y} AND NOT {_P}) AS fn, count(*) FILTER (WHERE NOT {_Y} AND NOT {_P}) AS tn FROM enriched)""") + f"""
SELECT {R('CAST(tp + tn AS DOUBLE) / CAST(tp + tn + fp + fn AS DOUBLE)', 4)} AS accuracy,
  {R('CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0 END', 4)} AS precision,
  {R('CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0 END', 4)} AS recall,
  {R('CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END', 4)} AS f1_score,
  {R('(SELECT auc FROM auc)', 4)} AS roc_auc
FROM m"""
