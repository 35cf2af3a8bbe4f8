"""Composite priority score, top-n priority list with adaptive tiers, and
the other top-k reports (C11-C14, H1-H7, G3-G4, F18, F26).

Top-n is ``orderBy(...).limit(n)`` -> ``TakeOrderedAndProject``: every
partition keeps its own n best rows, so nothing larger than n x partitions
ever meets in one task. Quantiles for the tiers are taken over that slice, whose
size the caller chooses, with an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.aggs import quantile
from ebbtide.functions.columns import (CLV_ALIASES, COMPLAINT_ALIASES, ID_ALIASES, RISK_ALIASES, find_col, find_dim)
from ebbtide.functions.scalars import clip, r, safe_numeric, truncate_text
from ebbtide.operators.kpis import _num, churn_breakdown, kpi_summary

# Composite-score weights, tier quantiles and class texts.
W_RISK, W_CLV, W_COMPLAINTS = 0.5, 0.3, 0.2
HIGH_Q, MED_Q = 0.80, 0.35
PRIORITY_ACTION = [
    ("High Priority", "Immediate Retention Outreach",
     "High priority score driven by elevated churn risk and/or CLV — "
     "immediate personalised outreach required within 48 hours."),
    ("Medium Priority", "Scheduled Retention Touch",
     "Moderate risk profile warrants proactive but non-urgent retention contact "
     "within the next 2 weeks."),
    ("Low Priority", "Routine Monitoring",
     "Low priority score — no immediate action required; "
     "include in standard monthly monitoring cycle."),
]


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scale to [0,1]; nulls count as 0 and a zero range gives all zeros."""
    return F.when(hi > lo, clip((x - lo) / (hi - lo), 0.0, 1.0)).otherwise(F.lit(0.0))


def scored(df: DataFrame) -> DataFrame:
    """Every customer with normalised CLV / complaints and the priority score."""
    risk = _num(df, RISK_ALIASES, 0.0)
    clv = _num(df, CLV_ALIASES, 0.0)
    comp_c = find_col(df, COMPLAINT_ALIASES)
    comp = safe_numeric(F.col(comp_c), 0.0) if comp_c else F.lit(0.0)
    # bounds of both columns: one aggregation, one scalar subquery, projected once
    # as a struct column that the expressions below refer to
    bounds = df.select(F.struct(F.min(clv).alias("lo_clv"), F.max(clv).alias("hi_clv"),
                                F.min(comp).alias("lo_comp"), F.max(comp).alias("hi_comp"))).scalar()
    df = df.select("*", bounds.alias("_b"))
    n_clv = scaled(clv, F.col("_b.lo_clv"), F.col("_b.hi_clv"))
    n_comp = scaled(comp, F.col("_b.lo_comp"), F.col("_b.hi_comp"))
    score = r(clip(risk * F.lit(W_RISK) + n_clv * F.lit(W_CLV) + n_comp * F.lit(W_COMPLAINTS), 0.0, 1.0), 4)
    cid, reg = find_col(df, ID_ALIASES), find_dim(df, "region")
    seg, plan = find_dim(df, "customer_segment"), find_dim(df, "plan_type")

    def dim(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) if c else F.lit("Unknown")

    return df.select(
        F.col(cid).alias("customer_id"), dim(reg).alias("region"), dim(seg).alias("customer_segment"),
        dim(plan).alias("plan_type"), clv.alias("estimated_clv"), risk.alias("churn_risk_score"),
        comp.cast("bigint").alias("complaints_90d"),
        r(n_clv, 4).alias("norm_clv"), r(n_comp, 4).alias("norm_complaints"), score.alias("priority_score"))


def minmax_normalize(df: DataFrame) -> DataFrame:
    return scored(df).select("customer_id", "norm_clv", "norm_complaints")


def priority_score(df: DataFrame) -> DataFrame:
    return scored(df).select("customer_id", "priority_score")


def _class(score: Column, hi: Column, med: Column) -> Column:
    return (F.when(score >= hi, F.lit(PRIORITY_ACTION[0][0]))
             .when(score >= med, F.lit(PRIORITY_ACTION[1][0]))
             .otherwise(F.lit(PRIORITY_ACTION[2][0])))


def _lookup(cls: Column, idx: int) -> Column:
    e = None
    for row in PRIORITY_ACTION:
        e = F.when(cls == row[0], F.lit(row[idx])) if e is None else e.when(cls == row[0], F.lit(row[idx]))
    return e


def priority_list(df: DataFrame, top_n: int = 500, fixed_cuts: tuple[float, float] | None = None,
                  segment: str | None = None, region: str | None = None) -> DataFrame:
    """H1 + G3: top ``top_n`` by score (ties: customer id) of the customers whose
    segment / region contain the given texts, tiers from the p80 / p35 of the
    returned slice (or fixed cuts, e.g. (.65, .40))."""
    n = int(top_n)
    if n < 1:
        raise ValueError("top_n must be at least 1")
    rows = scored(df)
    if segment:
        rows = rows.filter(F.lower(F.col("customer_segment")).contains(segment.lower()))
    if region:
        rows = rows.filter(F.lower(F.col("region")).contains(region.lower()))
    top = rows.orderBy(F.desc("priority_score"), F.asc("customer_id")).limit(n)
    if fixed_cuts:
        hi, med = F.lit(fixed_cuts[0]), F.lit(fixed_cuts[1])
    else:
        whole = Window.partitionBy()  # bounded slice of n rows
        hi = quantile(F.col("priority_score"), HIGH_Q).over(whole)
        med = quantile(F.col("priority_score"), MED_Q).over(whole)
    out = top.withColumn("priority_class", _class(F.col("priority_score"), hi, med))
    return out.withColumn("recommended_action", _lookup(F.col("priority_class"), 1)) \
              .withColumn("rationale", _lookup(F.col("priority_class"), 2)) \
              .drop("norm_clv", "norm_complaints")


def priority_class_counts(df: DataFrame, top_n: int = 500) -> DataFrame:
    return priority_list(df, top_n).groupBy("priority_class").agg(F.count(F.lit(1)).alias("customers"))


def priority_list_filtered(df: DataFrame, top_n: int = 20, segment: str | None = None,
                           region: str | None = None) -> DataFrame:
    """H6 + D8: the ``top_n`` customers among those that match the filters."""
    return priority_list(df, top_n, segment=segment, region=region)


def top_high_risk(df: DataFrame, region: str | None = None, k: int = 10) -> DataFrame:
    """H2: optional region filter, then the k riskiest customers (whole set sorted)."""
    risk = _num(df, RISK_ALIASES, 0.0)
    cid, reg = find_col(df, ID_ALIASES), find_dim(df, "region")
    x = df
    if region and reg:
        x = x.filter(F.lower(F.col(reg)).contains(region.lower()))
    return (x.select(F.col(cid).alias("customer_id"), F.col(reg).cast("string").alias("region"),
                     risk.alias("churn_risk_score"), _num(df, CLV_ALIASES, 0.0).alias("estimated_clv"))
             .orderBy(F.desc("churn_risk_score"), F.asc("customer_id")).limit(k))


def sorted_page(df: DataFrame, by: str, ascending: bool = False, k: int = 100) -> DataFrame:
    """H3 + C15: display projection sorted by any column, first k rows."""
    cid = find_col(df, ID_ALIASES)
    cols = [c for c in [cid, find_dim(df, "region"), find_dim(df, "customer_segment"), find_dim(df, "plan_type"),
                        find_col(df, CLV_ALIASES), find_col(df, RISK_ALIASES), "satisfaction_score", "complaints_90d"]
            if c and c in df.columns]
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.select(*cols).orderBy(key, F.asc(cid)).limit(k)


def risk_clv_scatter(df: DataFrame) -> DataFrame:
    """C14: (rounded CLV, risk to 3 dp) for every row where both exist."""
    clv, risk = find_col(df, CLV_ALIASES), find_col(df, RISK_ALIASES)
    cid = find_col(df, ID_ALIASES)
    x, y = safe_numeric(F.col(clv)), safe_numeric(F.col(risk))
    return (df.filter(x.isNotNull() & y.isNotNull())
              .select(F.col(cid).alias("customer_id"), r(x, 0).alias("clv"), r(y, 3).alias("risk")))


def segment_strategy(df: DataFrame, queue_n: int = 50) -> DataFrame:
    """per segment, churn vs portfolio and members in the top-``queue_n`` queue.

    The queue (bounded by ``queue_n``) is aggregated per segment first and
    joined to the (small) per-segment breakdown."""
    b = churn_breakdown(df, "customer_segment")
    avg = kpi_summary(df).select("churn_rate_pct").scalar()
    q = (priority_list(df, queue_n).groupBy(F.col("customer_segment"))
         .agg(F.count(F.lit(1)).alias("queue_members")))
    return (b.join(q, "customer_segment", "left")
             .select("customer_segment", "churn_rate_pct",
                     r(F.col("churn_rate_pct") - avg, 2).alias("vs_average_pp"),
                     F.coalesce(F.col("queue_members"), F.lit(0)).alias("queue_members")))


def action_truncate(df: DataFrame, top_n: int = 10, width: int = 30) -> DataFrame:
    """Action text cut to ``width`` characters plus an ellipsis."""
    return priority_list(df, top_n).select("customer_id",
                                           truncate_text(F.col("recommended_action"), width).alias("action"),
                                           truncate_text(F.col("rationale"), 40).alias("rationale_short"))
