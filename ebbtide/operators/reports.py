"""Report tables (O1-O5): the data behind the executive report sections.

Each table is built from the one-row KPI aggregates or a per-group
breakdown (a few rows), so the only passes over the customer table are the
aggregations they reuse; the report-level arithmetic runs on tiny frames.
Rates are treated as percentages throughout (the source multiplies
already-percent rates by 100 again; that is not reproduced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.ranking import with_rank
from ebbtide.functions.scalars import campaign_priority, r, risk_level, segment_action, truncate_text
from ebbtide.operators.cohorts import dimension_predicate
from ebbtide.operators.kpis import churn_breakdown, enhanced_kpis
from ebbtide.operators.priority import priority_list

# Scorecard benchmarks and status marks.
OK_MARK, WARN_MARK, NO_BENCHMARK = "✓", "⚠", "—"
CHURN_BENCH, RISK_BENCH, SAT_BENCH = 15.0, 0.30, 7.0
# Recovery scenarios (share of churned revenue).
RECOVERY = [("Conservative Recovery (20%)", 0.20), ("Base Case Recovery (28%)", 0.28),
            ("Optimistic Recovery (35%)", 0.35)]
ACTION_WIDTH = 30


def _stack(one_row: DataFrame, rows: list[tuple]) -> DataFrame:
    structs = [F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in row]) for row in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def report_scorecard(df: DataFrame) -> DataFrame:
    """O1: metric, value, benchmark, status."""
    e = enhanced_kpis(df)
    c = F.col

    def row(o, metric, value, bench, status):
        return [("ord", F.lit(o)), ("metric", metric), ("value", value.cast("double")), ("benchmark", bench),
                ("status", status)]
    warn = F.lit(WARN_MARK)
    ok = F.lit(OK_MARK)
    return _stack(e, [
        row(1, "Total Customers", c("total_customers"), NO_BENCHMARK, ok),
        row(2, "Churn Rate", c("churn_rate_pct"), "< 15%",
            F.when(c("churn_rate_pct") >= CHURN_BENCH, warn).otherwise(ok)),
        row(3, "Average CLV", c("avg_clv"), NO_BENCHMARK, ok),
        row(4, "Revenue at Risk (Churned)", c("revenue_at_risk"), "< 5% ARR", warn),
        row(5, "Top-Quartile Risk Revenue", c("biz_revenue_at_risk"), "< 10%", warn),
        row(6, "Avg Churn Risk Score", c("avg_churn_risk_score"), "< 0.30",
            F.when(c("avg_churn_risk_score") > RISK_BENCH, warn).otherwise(ok)),
        row(7, "Avg Satisfaction Score", c("avg_satisfaction_score"), "≥ 7.0",
            F.when(c("avg_satisfaction_score") < SAT_BENCH, warn).otherwise(ok)),
        row(8, "High-Value Customers", c("high_value_customers"), NO_BENCHMARK, ok),
        row(9, "High-Value Share (%)", c("high_value_pct"), NO_BENCHMARK, ok),
    ])


def _group_table(df: DataFrame, canonical: str) -> DataFrame:
    """Breakdown rows with their rank, the portfolio size and the number of groups."""
    b = churn_breakdown(df, canonical)
    total = df.agg(F.count(F.lit(1))).scalar()
    rate = F.col("churn_rate_pct")
    g = F.col("_groups")
    est = F.floor(total.cast("double") * (rate / F.lit(100.0)) * (F.lit(1.0) / g.cast("double")))
    return with_rank(b, [F.col("churn_rate_pct").isNull(), -F.col("churn_rate_pct"), F.col(canonical)], "ord", "_groups").select(
        "ord", canonical, r(rate, 1).alias("churn_rate_pct_1dp"), risk_level(rate, upper=True).alias("risk_level"),
        est.cast("bigint").alias("est_churned"), rate.alias("_rate"))


def report_segment_table(df: DataFrame) -> DataFrame:
    """O2 by segment: rate, level, estimated churned, recommended action."""
    t = _group_table(df, "customer_segment")
    return t.withColumn("action", segment_action(F.col("_rate"))).drop("_rate")


def report_region_table(df: DataFrame) -> DataFrame:
    """O2 by region: rate, level, estimated churned, campaign priority."""
    t = _group_table(df, "region")
    return t.withColumn("campaign_priority", campaign_priority(F.col("_rate"))).drop("_rate")


def report_financials(df: DataFrame) -> DataFrame:
    """O3: portfolio value waterfall and recovery scenarios (item, value)."""
    e = enhanced_kpis(df)
    c = F.col
    base = c("avg_clv") * c("total_customers")
    rows = [
        (1, "Total Customer Base Value", base),
        (2, "Revenue Lost (Churned Customers)", -c("revenue_at_risk")),
        (3, "At-Risk Cohort Exposure", -c("biz_revenue_at_risk")),
        (4, "Net Protected Revenue", base - c("revenue_at_risk") - c("biz_revenue_at_risk")),
        (5, "Total Revenue Exposure", c("revenue_at_risk") + c("biz_revenue_at_risk")),
    ]
    rows += [(6 + i, name, c("revenue_at_risk") * F.lit(share)) for i, (name, share) in enumerate(RECOVERY)]
    return _stack(e, [[("ord", F.lit(o)), ("item", F.lit(n)), ("value", r(v, 2))] for o, n, v in rows])


def report_priority_table(df: DataFrame, top_n: int = 10, region: str | None = None,
                          segment: str | None = None) -> DataFrame:
    """O4 + O5: the outreach table, honouring the report's region / segment
    filters (trim + case-insensitive equality) and its top-n."""
    pred, _ = dimension_predicate(df, {"region": region, "customer_segment": segment})
    pl = priority_list(df.filter(pred), top_n)
    w = Window.orderBy(F.desc("priority_score"), F.asc("customer_id"))  # over <= top_n rows
    return pl.select(F.row_number().over(w).alias("ord"), "customer_id", "customer_segment", "plan_type", "region",
                     "estimated_clv", "churn_risk_score", "priority_class",
                     truncate_text(F.col("recommended_action"), ACTION_WIDTH).alias("action"))


def money_by_region(df: DataFrame) -> DataFrame:
    """Total CLV per region with its compact USD and INR display strings."""
    from ebbtide.functions.aggs import dsum
    from ebbtide.functions.columns import CLV_ALIASES, find_col, find_dim
    from ebbtide.functions.scalars import format_inr, format_usd, safe_numeric
    reg, clv = find_dim(df, "region"), find_col(df, CLV_ALIASES)
    t = (df.filter(F.col(reg).isNotNull())
         .groupBy(F.col(reg).cast("string").alias("region"))
         .agg(r(F.coalesce(dsum(safe_numeric(F.col(clv))), F.lit(0.0)), 2).alias("total_clv")))
    return t.select("region", "total_clv", format_usd(F.col("total_clv")).alias("usd"),
                    format_inr(F.col("total_clv")).alias("inr"))


def display_formats(df: DataFrame, stamp: str) -> DataFrame:
    """Average CLV and churn rate by region in every display format, with
    the run's time stamp."""
    from ebbtide.functions.aggs import davg
    from ebbtide.functions.columns import CLV_ALIASES, find_col, find_dim
    from ebbtide.functions.scalars import (format_inr_exact, format_inr_report, format_percent, format_usd, run_stamp,
                                           safe_numeric)
    from ebbtide.operators.kpis import churn_value
    reg, clv = find_dim(df, "region"), find_col(df, CLV_ALIASES)
    t = (df.filter(F.col(reg).isNotNull()).groupBy(F.col(reg).cast("string").alias("region"))
         .agg(r(F.coalesce(davg(safe_numeric(F.col(clv))), F.lit(0.0)), 2).alias("avg_clv"),
              r(F.avg(churn_value(df)) * F.lit(100.0), 2).alias("churn_rate_pct"), F.count(F.lit(1)).alias("n")))
    v = F.col("avg_clv")
    return t.select("region", format_usd(v).alias("usd"), format_inr_exact(v).alias("inr_exact"),
                    format_inr_report(v).alias("inr_report"), format_percent(F.col("churn_rate_pct")).alias("churn"),
                    F.format_number("n", 0).alias("customers"),
                    run_stamp(F.to_timestamp(F.lit(stamp))).alias("generated_at"))
