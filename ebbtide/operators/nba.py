"""Next-best-action rule engine (K1-K5) and its aggregates.

The first-match rule list is one ``CASE WHEN`` column; the CLV threshold is a
scalar subquery; per-action attributes come from a 6-row dimension table
that is broadcast (its size is fixed by construction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.functions.aggs import count_if, dsum, ratio
from ebbtide.functions.columns import (CLV_ALIASES, ID_ALIASES, RISK_ALIASES, SAT_ALIASES, find_col)
from ebbtide.functions.scalars import r, safe_numeric
from ebbtide.functions.value_counts import column_quantile

# ---------------------------------------------------------------------------
# Rule thresholds, action attributes and texts.
# ---------------------------------------------------------------------------
HIGH_CHURN, LOW_CHURN, HIGH_UPSELL = 0.65, 0.35, 0.65
MANY_COMPLAINTS, MANY_PAYMENT_FAILURES, LOW_SATISFACTION = 3, 2, 4.0
CLV_PERCENTILE, CLV_FALLBACK = 0.75, 5000.0
# shares of the protected revenue: recovered, upsell opportunity, upsell income
RECOVERY_SHARE, UPSELL_OPPORTUNITY, UPSELL_ARR = 0.30, 0.15, 0.08
ACTIONS = [
    # (action, priority, confidence, success rate, reason)
    ("Premium Retention Offer", "Critical", 0.90, 0.65,
     "Customer has a high churn probability combined with high lifetime value. "
     "Proactive premium retention offer can protect significant revenue."),
    ("Service Recovery Call", "High", 0.85, 0.55,
     "Customer is at high churn risk and has logged multiple complaints in the last 90 days. "
     "A direct service recovery call is the highest-impact intervention."),
    ("Payment Support Plan", "High", 0.82, 0.50,
     "Elevated churn risk driven by repeated payment failures. "
     "Flexible payment arrangement can reduce financial friction and improve retention."),
    ("Upsell Premium Plan", "Medium", 0.78, 0.20,
     "Customer has a low churn risk but a high upsell probability. "
     "Now is the right moment to propose a premium plan upgrade."),
    ("CX Intervention", "Medium", 0.75, 0.40,
     "Customer satisfaction score is below the acceptable threshold. "
     "A targeted CX intervention can prevent future churn."),
    ("Monitor", "Low", 0.60, 0.05,
     "Customer profile does not trigger any high-priority intervention rule. "
     "Routine monitoring and next scheduled contact are sufficient."),
]
# Row defaults in the full-table run.
DEFAULTS = {"risk": 0.0, "clv": 0.0, "upsell": 0.0, "complaints": 0, "failures": 0, "sat": 5.0}


def action_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, a, p, c, s, t) for i, (a, p, c, s, t) in enumerate(ACTIONS)],
        "rule_order int, recommendation string, priority string, confidence double, "
        "success_rate double, reason string")


def nba_inputs(df: DataFrame) -> DataFrame:
    """The seven rule inputs with the full-table defaults (K5)."""
    def num(aliases, default):
        c = find_col(df, aliases)
        return safe_numeric(F.col(c), default) if c else F.lit(float(default))

    def cnt(name, default):
        c = find_col(df, [name])
        return F.coalesce(safe_numeric(F.col(c)), F.lit(float(default))).cast("bigint") if c else F.lit(default).cast("bigint")

    cid = find_col(df, ID_ALIASES)
    return df.select(
        (F.col(cid) if cid else F.monotonically_increasing_id()).alias("customer_id"),
        num(RISK_ALIASES, DEFAULTS["risk"]).alias("churn_risk_score"),
        num(CLV_ALIASES, DEFAULTS["clv"]).alias("estimated_clv"),
        num(["upsell_probability"], DEFAULTS["upsell"]).alias("upsell_probability"),
        num(["retention_offer_cost"], 0.0).alias("retention_offer_cost"),
        cnt("complaints_90d", DEFAULTS["complaints"]).alias("complaints_90d"),
        cnt("payment_failures_12m", DEFAULTS["failures"]).alias("payment_failures_12m"),
        num(SAT_ALIASES, DEFAULTS["sat"]).alias("satisfaction_score"))


def clv_threshold(df: DataFrame) -> Column:
    """Scalar subquery: p75 of the CLV column with nulls dropped (5000 if absent)."""
    q = column_quantile(df, CLV_ALIASES, CLV_PERCENTILE)
    return F.lit(CLV_FALLBACK) if q is None else F.coalesce(q, F.lit(CLV_FALLBACK))


def rule_column(clv_thr: Column) -> Column:
    risk, clv = F.col("churn_risk_score"), F.col("estimated_clv")
    hi = risk >= F.lit(HIGH_CHURN)
    return (F.when(hi & (clv >= clv_thr), F.lit(ACTIONS[0][0]))
             .when(hi & (F.col("complaints_90d") >= MANY_COMPLAINTS), F.lit(ACTIONS[1][0]))
             .when(hi & (F.col("payment_failures_12m") >= MANY_PAYMENT_FAILURES), F.lit(ACTIONS[2][0]))
             .when((risk < F.lit(LOW_CHURN)) & (F.col("upsell_probability") >= F.lit(HIGH_UPSELL)), F.lit(ACTIONS[3][0]))
             .when(F.col("satisfaction_score") <= F.lit(LOW_SATISFACTION), F.lit(ACTIONS[4][0]))
             .otherwise(F.lit(ACTIONS[5][0])))


def success_rate(action: Column) -> Column:
    e = None
    for a, _, _, s, _ in ACTIONS:
        e = F.when(action == a, F.lit(s)) if e is None else e.when(action == a, F.lit(s))
    return e.otherwise(F.lit(0.05))


def nba_recommendations(df: DataFrame, clv_thr: Column | None = None) -> DataFrame:
    """Per customer: recommendation and expected revenue protected
    (= clv x risk x success rate of the action, 2 dp)."""
    thr = clv_thr if clv_thr is not None else clv_threshold(df)
    x = nba_inputs(df).withColumn("recommendation", rule_column(thr))
    return x.withColumn(
        "expected_revenue_protected",
        r(F.col("estimated_clv") * F.col("churn_risk_score") * success_rate(F.col("recommendation")), 2))


def nba_with_attributes(df: DataFrame) -> DataFrame:
    """K2: attach priority / confidence / reason through a broadcast join to the
    6-row action dimension (size fixed by construction)."""
    rec = nba_recommendations(df)
    dim = F.broadcast(action_dimension(df.sparkSession).drop("success_rate", "rule_order"))
    return rec.join(dim, "recommendation", "left").select(
        "customer_id", "recommendation", "priority", "confidence", "expected_revenue_protected", "reason")


def _checked_fields(df: DataFrame) -> list[tuple[str, str, float, float | None]]:
    """(column of ``df``, field, low, high) of the fields that the table has."""
    fields = [(RISK_ALIASES, "churn_risk_score", 0.0, 1.0), (CLV_ALIASES, "estimated_clv", 0.0, None),
              (["upsell_probability"], "upsell_probability", 0.0, 1.0),
              (["retention_offer_cost"], "retention_offer_cost", 0.0, None),
              (["complaints_90d"], "complaints_90d", 0.0, None),
              (["payment_failures_12m"], "payment_failures_12m", 0.0, None),
              (SAT_ALIASES, "satisfaction_score", 0.0, 10.0)]
    return [(find_col(df, aliases), name, low, high) for aliases, name, low, high in fields if find_col(df, aliases)]


def with_reject_reasons(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with ``reject_reasons``: for each input field the table has,
    a value that is missing or not a number, or out of range. Raw values are tested,
    before any default is filled in; fields that the table lacks take their defaults."""
    reasons = []
    for col, name, low, high in _checked_fields(df):
        x = safe_numeric(F.col(col))
        reasons.append(F.when(x.isNull(), F.lit(f"{name} missing"))
                       .when((x < F.lit(low)) | (x > F.lit(high) if high is not None else F.lit(False)),
                             F.lit(f"{name} out of range")))
    found = F.filter(F.array(*reasons), lambda v: v.isNotNull()) if reasons else F.array().cast("array<string>")
    return df.withColumn("reject_reasons", found)


def nba_input_validation(df: DataFrame) -> DataFrame:
    """K4: bad rows are counted, not the whole batch refused; one summary row."""
    bad = F.size("reject_reasons") > 0
    return with_reject_reasons(df).agg(F.count(F.lit(1)).alias("total"), count_if(~bad).alias("valid"),
                                       count_if(bad).alias("rejected"))


def nba_rejected_rows(df: DataFrame) -> DataFrame:
    """Each rejected customer with its reasons, in the order of the rules."""
    cid = find_col(df, ID_ALIASES)
    return (with_reject_reasons(df).filter(F.size("reject_reasons") > 0)
            .select(F.col(cid).alias("customer_id"), F.concat_ws("; ", "reject_reasons").alias("reasons")))


def validated_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows as rule inputs, rejected rows with reasons)."""
    v = with_reject_reasons(df)
    return (nba_inputs(v.filter(F.size("reject_reasons") == 0).drop("reject_reasons")),
            v.filter(F.size("reject_reasons") > 0))


def strategy_summary(df: DataFrame) -> DataFrame:
    """count, % of total and revenue protected per action. The share of
    total is a window over the aggregated result (at most six rows), never
    over customer rows."""
    rec = nba_recommendations(df)
    total = F.sum("customer_count").over(Window.partitionBy())
    return (rec.groupBy("recommendation")
               .agg(F.count(F.lit(1)).alias("customer_count"),
                    r(F.coalesce(dsum(F.col("expected_revenue_protected")), F.lit(0.0)), 2)
                    .alias("total_revenue_protected"))
               .withColumn("pct_of_total", r(ratio(F.col("customer_count"), total) * F.lit(100.0), 2))
               .select(F.col("recommendation").alias("strategy"), "customer_count", "pct_of_total",
                       "total_revenue_protected"))


def nba_batch_totals(df: DataFrame) -> DataFrame:
    rec = nba_recommendations(df)
    return rec.agg(F.count(F.lit(1)).alias("total_customers"),
                   r(F.coalesce(dsum(F.col("expected_revenue_protected")), F.lit(0.0)), 2)
                   .alias("total_revenue_protected"))


def nba_portfolio_triage(df: DataFrame) -> DataFrame:
    """action counts in one pass, dominant action (ties: rule order),
    critical = Premium + Service, growth = Upsell, portfolio level."""
    rec = nba_recommendations(df)
    a = F.col("recommendation")
    counts = [count_if(a == name).alias(f"n{i}") for i, (name, *_rest) in enumerate(ACTIONS)]
    t = rec.agg(F.count(F.lit(1)).alias("total_customers"),
                F.coalesce(dsum(F.col("expected_revenue_protected")), F.lit(0.0)).alias("protected"), *counts)
    order = [F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("a"))
             for i, (name, *_rest) in enumerate(ACTIONS)]
    crit = F.col("n0") + F.col("n1")
    share = ratio(crit, F.col("total_customers"))
    return t.select(
        "total_customers",
        F.greatest(*order)["a"].alias("dominant_action"),
        crit.alias("critical_customers"),
        F.col("n3").alias("growth_customers"),
        F.when(share > 0.25, "Critical").when(share > 0.15, "High").otherwise("Elevated").alias("risk_level"),
        F.when(F.col("total_customers") >= 500, "High").otherwise("Medium").alias("confidence"),
        r(F.col("protected"), 2).alias("revenue_protected"),
        r(F.col("protected") * F.lit(RECOVERY_SHARE), 2).alias("projected_recovery"),
        r(F.col("protected") * F.lit(UPSELL_OPPORTUNITY), 2).alias("upsell_opportunity"),
        r(F.col("protected") * F.lit(UPSELL_ARR), 2).alias("projected_upsell"))
