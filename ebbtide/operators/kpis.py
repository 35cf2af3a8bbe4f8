"""KPI aggregates over a customer table (any table whose columns resolve by alias).

Global thresholds (p75 of risk or CLV, portfolio churn rate, ...) are one-row
aggregates attached as *scalar subqueries* (``DataFrame.scalar()``): Spark runs
them once and inlines the value — no cross join, nothing collected by us.
Grouped metrics are hash aggregates with partial (map-side) aggregation, so
a hot key is pre-combined per partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.aggs import count_if, davg, dsum, ratio
from ebbtide.functions.columns import (CHURN_ALIASES, CLV_ALIASES, KPI_CLV_ALIASES, RISK_ALIASES,
                                       SAT_ALIASES, find_col, find_col_containing, find_dim)
from ebbtide.functions.quantiles import quantiles_for
from ebbtide.functions.ranking import with_rank
from ebbtide.functions.scalars import r, risk_level, safe_numeric
from ebbtide.functions.value_counts import column_quantile, store_of

THRESHOLD_DP = 6  # places of a threshold in the output; comparisons use the raw quantile


def _num(df: DataFrame, aliases: list[str], fill: float | None = None) -> Column:
    c = find_col(df, aliases)
    return safe_numeric(F.col(c), fill) if c else F.lit(fill if fill is not None else None).cast("double")


def churn_flag(df: DataFrame) -> Column:
    """True where churn == 1; false when the churn column is absent. On an integer column
    the comparison is a plain one that reaches the scan."""
    c = find_col(df, CHURN_ALIASES)
    if c and isinstance(df.schema[c].dataType, T.IntegralType):
        return F.col(c) == F.lit(1)
    return (safe_numeric(F.col(c)) == F.lit(1.0)) if c else F.lit(False)


def churn_value(df: DataFrame) -> Column:
    c = find_col(df, CHURN_ALIASES)
    return safe_numeric(F.col(c)) if c else F.lit(None).cast("double")


def p75_threshold(df: DataFrame, aliases: list[str], p: float = 0.75) -> Column:
    """Scalar subquery: quantile of the column (nulls filled with 0; 0 without a column)."""
    q = column_quantile(df, aliases, p, fill_zero=True)
    return F.lit(0.0) if q is None else q


def p75_thresholds(df: DataFrame, *alias_lists: list[str], p: float = 0.75) -> list[Column]:
    """Several quantiles: from the table's store, else from the same passes over ``df``."""
    if store_of(df) is not None:
        return [p75_threshold(df, a, p) for a in alias_lists]
    return [q[0] for q in quantiles_for(df, [_num(df, a, 0.0) for a in alias_lists], [p])]


def high_risk_mask(df: DataFrame) -> Column:
    return _num(df, RISK_ALIASES, 0.0) >= p75_threshold(df, RISK_ALIASES)


# ---------------------------------------------------------------------------
# One-row KPI summary
# ---------------------------------------------------------------------------
def kpi_aggs(df: DataFrame) -> list[Column]:
    n = F.count(F.lit(1))
    churned = churn_flag(df)
    clv = _num(df, KPI_CLV_ALIASES)
    return [
        n.alias("total_customers"),
        r(ratio(count_if(churned), n) * F.lit(100.0), 2).alias("churn_rate_pct"),
        r(F.coalesce(davg(clv), F.lit(0.0)), 4).alias("avg_clv"),
        r(F.coalesce(dsum(F.when(churned, clv)), F.lit(0.0)), 4).alias("revenue_at_risk"),
        r(F.coalesce(davg(_num(df, RISK_ALIASES)), F.lit(0.0)), 4).alias("avg_churn_risk_score"),
        r(F.coalesce(davg(_num(df, SAT_ALIASES)), F.lit(0.0)), 4).alias("avg_satisfaction_score"),
    ]


def kpi_summary(df: DataFrame) -> DataFrame:
    return df.agg(*kpi_aggs(df))


# ---------------------------------------------------------------------------
# churn breakdown by one dimension (null keys dropped, as pandas does)
# ---------------------------------------------------------------------------
def churn_breakdown(df: DataFrame, canonical: str) -> DataFrame:
    col = find_dim(df, canonical)
    if col is None or find_col(df, CHURN_ALIASES) is None:
        return df.sparkSession.createDataFrame([], f"{canonical} string, churn_rate_pct double")
    return (df.filter(F.col(col).isNotNull())
              .groupBy(F.col(col).cast("string").alias(canonical))
              .agg(r(F.avg(churn_value(df)) * F.lit(100.0), 2).alias("churn_rate_pct"),
                   F.count(F.lit(1)).alias("customers")))


def churn_breakdown_sorted(df: DataFrame, canonical: str) -> DataFrame:
    """Chart variant: one decimal, worst first (ties by key)."""
    b = churn_breakdown(df, canonical)
    return (b.select(canonical, r(F.col("churn_rate_pct"), 1).alias("churn_rate_pct_1dp"))
             .orderBy(F.desc("churn_rate_pct_1dp"), F.asc(canonical)))


def breakdown_map(df: DataFrame, canonical: str) -> DataFrame:
    """The breakdown as one ``map<string,double>`` row (small: one entry per group)."""
    b = churn_breakdown(df, canonical)
    return b.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(canonical, "churn_rate_pct"))))
                 .alias(f"churn_by_{canonical}"))


# ---------------------------------------------------------------------------
# Quantiles, top-quartile revenue at risk, high-value customers
# ---------------------------------------------------------------------------
def clv_risk_quantiles(df: DataFrame) -> DataFrame:
    probs = [0.25, 0.5, 0.75]
    if store_of(df) is not None:
        qc, qr = [[p75_threshold(df, a, p) for p in probs] for a in (CLV_ALIASES, RISK_ALIASES)]
    else:
        qc, qr = quantiles_for(df, [_num(df, CLV_ALIASES, 0.0), _num(df, RISK_ALIASES, 0.0)], probs)
    return (df.sparkSession.range(1)
              .select(*[r(qc[i], THRESHOLD_DP).alias(f"clv_p{p}") for i, p in enumerate((25, 50, 75))],
                      *[r(qr[i], THRESHOLD_DP).alias(f"risk_p{p}") for i, p in enumerate((25, 50, 75))]))


def revenue_at_risk_top_quartile(df: DataFrame) -> DataFrame:
    thr = p75_threshold(df, RISK_ALIASES)
    clv, risk = _num(df, CLV_ALIASES, 0.0), _num(df, RISK_ALIASES, 0.0)
    hit = risk >= thr
    return df.agg(r(F.first(thr), THRESHOLD_DP).alias("risk_p75"),
                  r(F.coalesce(dsum(F.when(hit, clv)), F.lit(0.0)), 4).alias("revenue_at_risk"),
                  count_if(hit).alias("high_risk_customers"))


def high_value_customers(df: DataFrame) -> DataFrame:
    thr = p75_threshold(df, CLV_ALIASES)
    clv = _num(df, CLV_ALIASES, 0.0)
    n = F.count(F.lit(1))
    hv = count_if(clv > thr)
    return df.agg(r(F.first(thr), THRESHOLD_DP).alias("clv_p75"), hv.alias("high_value_customers"),
                  r(ratio(hv, n) * F.lit(100.0), 2).alias("high_value_pct"))


# ---------------------------------------------------------------------------
# churn (or, without a churn column, high-risk) concentration by region
# ---------------------------------------------------------------------------
def churn_concentration(df: DataFrame, use_risk: bool | None = None) -> DataFrame:
    region = find_dim(df, "region")
    if use_risk is None:
        use_risk = find_col(df, CHURN_ALIASES) is None
    mask = high_risk_mask(df) if use_risk else churn_flag(df)
    if region is None:
        return df.sparkSession.createDataFrame([("Unknown", 0, 0.0)],
                                               "top_region string, customer_count bigint, pct_of_total double")
    per = df.groupBy(F.col(region).cast("string").alias("g")).agg(count_if(mask).alias("cnt"))
    ok = F.col("g").isNotNull() & (F.col("cnt") > 0)
    best = F.min_by(F.when(ok, F.col("g")), F.when(ok, F.struct((-F.col("cnt")).alias("k"), F.col("g"))))
    best_n = F.max(F.when(ok, F.col("cnt")))
    return per.agg(F.coalesce(best, F.lit("Unknown")).alias("top_region"),
                   F.coalesce(best_n, F.lit(0)).cast("bigint").alias("customer_count"),
                   F.when(best_n.isNull(), F.lit(0.0))
                    .otherwise(r(ratio(best_n, F.sum("cnt")) * F.lit(100.0), 2)).alias("pct_of_total"))


# ---------------------------------------------------------------------------
# 3-key risk segments
# ---------------------------------------------------------------------------
def risk_segments(df: DataFrame, top: int | None = None) -> DataFrame:
    keys = [("region", find_dim(df, "region")), ("customer_segment", find_dim(df, "customer_segment")),
            ("plan_type", find_dim(df, "plan_type"))]
    present = [(k, c) for k, c in keys if c is not None]
    thr = p75_threshold(df, RISK_ALIASES)
    clv, risk = _num(df, CLV_ALIASES, 0.0), _num(df, RISK_ALIASES, 0.0)
    has_churn = find_col(df, CHURN_ALIASES) is not None
    base = df
    for _, c in present:
        base = base.filter(F.col(c).isNotNull())
    base = base.withColumn("_thr", thr)  # projected once; the aggregation refers to the column
    g = base.groupBy(*[F.col(c).cast("string").alias(k) for k, c in present]).agg(
        F.count(F.lit(1)).alias("customer_count"),
        r(davg(risk), 4).alias("avg_churn_risk_score"),
        (r(F.coalesce(F.avg(churn_value(df)), F.lit(0.0)) * F.lit(100.0), 2) if has_churn else F.lit(0.0))
        .alias("churn_rate"),
        r(dsum(clv), 4).alias("total_clv"),
        r(F.coalesce(dsum(F.when(risk >= F.col("_thr"), clv)), F.lit(0.0)), 4).alias("revenue_at_risk"))
    for k, c in keys:
        if c is None:
            g = g.withColumn(k, F.lit("N/A"))
    g = g.select("region", "customer_segment", "plan_type", "customer_count", "avg_churn_risk_score",
                 "churn_rate", "total_clv", "revenue_at_risk")
    if top:
        g = g.orderBy(F.desc("revenue_at_risk"), "region", "customer_segment", "plan_type").limit(top)
    return g


def enhanced_kpi_segments(df: DataFrame, top: int = 20) -> DataFrame:
    """F12 with F11: the top risk segments, each row with the portfolio's figures."""
    cols = ["total_customers", "churn_rate_pct", "biz_revenue_at_risk", "high_value_customers", "top_region"]
    one = enhanced_kpis(df).select(F.struct(*cols)).scalar()
    return (risk_segments(df, top).withColumn("_k", one)
            .select("*", *[F.col(f"_k.{c}").alias(f"portfolio_{c}") for c in cols]).drop("_k"))


# ---------------------------------------------------------------------------
# enhanced KPIs in one row
# ---------------------------------------------------------------------------
def enhanced_kpis(df: DataFrame) -> DataFrame:
    """F1 + F7 + F8 + F9 as one row: the main pass over the customers plus
    scalar subqueries for the thresholds and the concentration row."""
    thr_risk, thr_clv = p75_thresholds(df, RISK_ALIASES, CLV_ALIASES)
    clv, risk = _num(df, CLV_ALIASES, 0.0), _num(df, RISK_ALIASES, 0.0)
    n = F.count(F.lit(1))
    conc = churn_concentration(df).select(F.struct("*").alias("c")).scalar()
    # both thresholds projected once; the aggregation refers to the columns
    x = df.select("*", thr_risk.alias("_thr_risk"), thr_clv.alias("_thr_clv"))
    hv = count_if(clv > F.col("_thr_clv"))
    return (x.agg(*kpi_aggs(df),
                  r(F.coalesce(dsum(F.when(risk >= F.col("_thr_risk"), clv)), F.lit(0.0)), 4)
                  .alias("biz_revenue_at_risk"),
                  hv.alias("high_value_customers"),
                  r(ratio(hv, n) * F.lit(100.0), 2).alias("high_value_pct"))
              .withColumn("conc", conc)
              .select("*", F.col("conc.top_region").alias("top_region"),
                      F.col("conc.customer_count").alias("top_region_count"),
                      F.col("conc.pct_of_total").alias("pct_of_total_churned"))
              .drop("conc")
              .withColumn("risk_p75", r(thr_risk, THRESHOLD_DP)))


# ---------------------------------------------------------------------------
# churn drivers as rows (driver, subject, value, threshold, fired, kept)
# ---------------------------------------------------------------------------
def _worst(b: DataFrame, key: str) -> Column:
    """Scalar subquery: struct(key, rate) of the highest-churn group (ties: smallest key)."""
    return b.agg(F.min_by(F.struct(F.col(key).alias("k"), F.col("churn_rate_pct").alias("v")),
                          F.struct((-F.col("churn_rate_pct")).alias("o"), F.col(key))).alias("w")).scalar()


def churn_drivers(df: DataFrame) -> DataFrame:
    tenure = find_col_containing(df, ("tenure",))
    comp = find_col_containing(df, ("complaint",), ("ticket", "support"))
    pay = find_col_containing(df, ("payment", "fail"), ("payment", "delay"))
    n = F.count(F.lit(1))
    sat_avg = r(F.coalesce(davg(_num(df, SAT_ALIASES)), F.lit(0.0)), 4)
    rate = r(ratio(count_if(churn_flag(df)), n) * F.lit(100.0), 2)
    nulld = F.lit(None).cast("double")
    metrics = [
        (r(count_if(safe_numeric(F.col(tenure)) < 6.0) / n.cast("double") * F.lit(100.0), 2) if tenure else nulld)
        .alias("pct_new"),
        (r(davg(safe_numeric(F.col(comp))), 4) if comp else nulld).alias("avg_comp"),
        (r(count_if(safe_numeric(F.col(pay)) > 0.0) / n.cast("double") * F.lit(100.0), 2) if pay else nulld)
        .alias("pct_pay"),
        sat_avg.alias("avg_sat"), rate.alias("churn_pct")]
    # ONE scan: grouping sets () / (segment) / (region) in one aggregation with
    # map-side partial aggregation (the Expand x3 stays inside the scan stage,
    # only one row per group and partition is shuffled); the portfolio metrics
    # come from the () row, the worst groups from the per-dimension rows.
    dims = {k: find_dim(df, k) for k in ("customer_segment", "region")}
    dims = {k: c for k, c in dims.items() if c is not None and find_col(df, CHURN_ALIASES) is not None}
    cols = list(dict.fromkeys(dims.values()))
    g = (df.groupingSets([[]] + [[F.col(c)] for c in cols], *[F.col(c) for c in cols])
           .agg(*metrics, r(F.avg(churn_value(df)) * F.lit(100.0), 2).alias("_rate"),
                *[F.grouping(F.col(c)).alias(f"_g{i}") for i, c in enumerate(cols)]))
    total = F.lit(True)
    for i in range(len(cols)):
        total = total & (F.col(f"_g{i}") == 1)
    # an empty input has no () row: its metrics stay null, the satisfaction average 0 as above
    picks = [F.max(F.when(total, F.col(c))).alias(c) for c in ("pct_new", "avg_comp", "pct_pay", "churn_pct")]
    picks.append(F.coalesce(F.max(F.when(total, F.col("avg_sat"))), F.lit(0.0)).alias("avg_sat"))
    for name, k in (("seg", "customer_segment"), ("reg", "region")):
        if k in dims:
            i, key = cols.index(dims[k]), F.col(dims[k]).cast("string")
            own = (F.col(f"_g{i}") == 0) & key.isNotNull()
            for j in range(len(cols)):
                if j != i:
                    own = own & (F.col(f"_g{j}") == 1)
            # highest rate first, ties: smallest key (as _worst)
            picks.append(F.min_by(F.struct(key.alias("k"), F.col("_rate").alias("v")),
                                  F.when(own, F.struct((-F.col("_rate")).alias("o"), key))).alias(name))
        else:
            picks.append(F.lit(None).cast("struct<k:string,v:double>").alias(name))
    m = g.agg(*picks)  # one row: the aggregation above has one row per group
    above = r((F.col("seg.v") - F.col("churn_pct")) / F.greatest(F.col("churn_pct"), F.lit(0.01)) * F.lit(100.0), 2)
    def row(o, driver, subject, value, threshold, fired):
        return F.struct(F.lit(o).alias("ord"), F.lit(driver).alias("driver"),
                        (F.lit(subject) if isinstance(subject, str) or subject is None else subject)
                        .cast("string").alias("subject"),
                        value.cast("double").alias("value"),
                        (F.lit(threshold) if isinstance(threshold, float) else threshold).cast("double").alias("threshold"),
                        fired.alias("fired"))

    rows = F.array(
        row(1, "early_lifecycle", tenure, F.col("pct_new"), 20.0, F.coalesce(F.col("pct_new") > 20.0, F.lit(False))),
        row(2, "service_quality", comp, F.col("avg_comp"), 1.5, F.coalesce(F.col("avg_comp") > 1.5, F.lit(False))),
        row(3, "payment_friction", pay, F.col("pct_pay"), 10.0, F.coalesce(F.col("pct_pay") > 10.0, F.lit(False))),
        row(4, "low_satisfaction", "satisfaction", F.col("avg_sat"), 6.0,
            (F.col("avg_sat") > 0.0) & (F.col("avg_sat") < 6.0)),
        row(5, "segment_concentration", F.col("seg.k"), F.col("seg.v"), above, F.col("seg.k").isNotNull()),
        row(6, "geographic_concentration", F.col("reg.k"), F.col("reg.v"), F.col("churn_pct"),
            F.col("reg.k").isNotNull()))
    out = m.select(F.inline(rows))
    # six rows at most: the window runs on an already-aggregated frame
    fired_before = F.sum(F.col("fired").cast("int")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("kept", F.col("fired") & (F.coalesce(fired_before, F.lit(0)) < 5))


# ---------------------------------------------------------------------------
# Derived portfolio figures
# ---------------------------------------------------------------------------
def recovery_projection(df: DataFrame) -> DataFrame:
    k = kpi_summary(df)
    pct = F.col("churn_rate_pct")
    rec = F.when(pct >= 25, F.lit(30)).when(pct >= 20, F.lit(25)).otherwise(F.lit(20))
    churned_n = F.floor(F.col("total_customers") * pct / F.lit(100.0) + F.lit(0.5))
    return k.select(
        "total_customers", "churn_rate_pct", "revenue_at_risk",
        risk_level(pct).alias("risk_level"),
        rec.alias("recovery_pct"),
        r(F.col("revenue_at_risk") * rec / F.lit(100.0), 2).alias("expected_recovery"),
        r(F.greatest(pct * F.lit(0.75), F.lit(8.0)), 2).alias("target_churn_pct"),
        r(F.col("avg_clv") * F.col("total_customers") / F.lit(100.0), 2).alias("value_per_churn_point"),
        churned_n.alias("churned_customers"),
        F.floor(churned_n * F.lit(0.3)).alias("outreach_size"),
        r(F.col("revenue_at_risk") * F.lit(0.35), 2).alias("revenue_target"))


def group_spread(df: DataFrame, canonical: str) -> DataFrame:
    """Worst / best group and the spread in percentage points (ties: smallest key)."""
    b = churn_breakdown(df, canonical)
    worst = F.min_by(F.col(canonical), F.struct((-F.col("churn_rate_pct")).alias("o"), F.col(canonical)))
    best = F.min_by(F.col(canonical), F.struct(F.col("churn_rate_pct").alias("o"), F.col(canonical)))
    return b.agg(worst.alias("worst"), F.max("churn_rate_pct").alias("worst_rate"),
                 best.alias("best"), F.min("churn_rate_pct").alias("best_rate"),
                 r(F.max("churn_rate_pct") - F.min("churn_rate_pct"), 2).alias("spread_pp"),
                 F.count(F.lit(1)).alias("groups"))


def churn_counts(df: DataFrame) -> DataFrame:
    k = kpi_summary(df)
    churned = F.floor(F.col("total_customers") * F.col("churn_rate_pct") / F.lit(100.0))
    return k.select("total_customers", "churn_rate_pct", churned.alias("churned"),
                    (F.col("total_customers") - churned).alias("retained"),
                    r(F.lit(100.0) - F.col("churn_rate_pct"), 2).alias("retention_rate_pct"),
                    risk_level(F.col("churn_rate_pct")).alias("risk_level"))


def combined_exposure(df: DataFrame) -> DataFrame:
    e = enhanced_kpis(df)
    return e.select(F.col("revenue_at_risk").alias("churned_clv"),
                    F.col("biz_revenue_at_risk").alias("top_quartile_clv"),
                    r(F.col("revenue_at_risk") + F.col("biz_revenue_at_risk"), 4).alias("combined_exposure"))


def group_ranking(df: DataFrame, canonical: str, top: int | None = None) -> DataFrame:
    """Groups ranked by churn rate (desc, ties by key) with a +-2pp flag, for any
    number of groups (``functions.ranking``)."""
    b = churn_breakdown(df, canonical)
    avg = kpi_summary(df).select("churn_rate_pct").scalar()
    diff = F.col("churn_rate_pct") - avg
    ranked = with_rank(b, [F.col("churn_rate_pct").isNull(), -F.col("churn_rate_pct"), F.col(canonical)])
    return ((ranked.filter(F.col("rank") <= top) if top else ranked)
             .select("rank", canonical, "churn_rate_pct",
                     r(diff, 2).alias("diff_pp"),
                     F.when(diff > 2.0, F.lit("above")).when(diff < -2.0, F.lit("below"))
                      .otherwise(F.lit("")).alias("flag")))


def group_estimates(df: DataFrame, canonical: str) -> DataFrame:
    """Per group: rank, deviation from portfolio, estimated churned customers
    and revenue (portfolio figures split evenly over the G groups)."""
    b = churn_breakdown(df, canonical)
    k = kpi_summary(df).select(F.struct("*").alias("k")).scalar()
    rate = F.col("churn_rate_pct")
    return (with_rank(b, [F.col("churn_rate_pct").isNull(), -F.col("churn_rate_pct"), F.col(canonical)], total="groups").withColumn("k", k)
             .select("rank", canonical, "churn_rate_pct", "groups",
                     r(rate - F.col("k.churn_rate_pct"), 2).alias("deviation_pp"),
                     F.floor(F.col("k.total_customers") * rate / F.lit(100.0) / F.greatest(F.col("groups"), F.lit(1)))
                      .alias("est_customers"),
                     r(F.col("k.revenue_at_risk") * rate / F.greatest(F.col("k.churn_rate_pct"), F.lit(0.001))
                       / F.greatest(F.col("groups"), F.lit(1)), 2).alias("est_revenue"),
                     F.when(rate >= 25, "Critical").when(rate >= 20, "High").otherwise("Moderate").alias("risk_level")))


# ---------------------------------------------------------------------------
# ad-hoc insight on any table (substring column resolution)
# ---------------------------------------------------------------------------
def adhoc_insights(df: DataFrame, top: int | None = None) -> DataFrame:
    """Churn by the first region-like and segment-like columns (all groups, or the ``top`` worst),
    with the portfolio churn mean and churned-CLV sum on every row."""
    churn = find_col_containing(df, ("churn",))
    clv = find_col_containing(df, ("clv",), ("lifetime_value",), ("ltv",))
    reg = find_col_containing(df, ("region",), ("city",), ("location",), ("state",))
    seg = find_col_containing(df, ("segment",), ("tier",), ("plan_type",), ("plantype",))
    cv = safe_numeric(F.col(churn))
    dims = [(dim, c) for dim, c in (("region", reg), ("segment", seg)) if c is not None]
    cols = list(dict.fromkeys(c for _, c in dims))
    # ONE scan: grouping sets () / (region) / (segment), partial aggregation
    # map-side; the () row carries the portfolio figures
    g = (df.groupingSets([[]] + [[F.col(c)] for c in cols], *[F.col(c) for c in cols])
           .agg(r(F.avg(cv) * F.lit(100.0), 2).alias("churn_pct"), F.count(F.lit(1)).alias("n"),
                F.sum(cv).cast("double").alias("churned"),
                (r(F.coalesce(dsum(F.when(cv == 1.0, safe_numeric(F.col(clv)))), F.lit(0.0)), 2) if clv
                 else F.lit(None).cast("double")).alias("churned_clv"),
                *[F.grouping(F.col(c)).alias(f"_g{i}") for i, c in enumerate(cols)]))

    def only(i: int | None) -> Column:
        """Rows of the grouping set on column ``i`` (None: the () set)."""
        cond = F.lit(True)
        for j in range(len(cols)):
            cond = cond & (F.col(f"_g{j}") == (0 if j == i else 1))
        return cond

    whole = Window.partitionBy()  # over the aggregated groups only
    total = only(None)
    g = g.select("*", *[F.max(F.when(total, F.col(c))).over(whole).alias(f"p_{c}")
                        for c in ("churn_pct", "churned", "churned_clv")])
    rows = []
    for dim, c in dims:
        key = F.col(c).cast("string")
        rows.append(F.when(only(cols.index(c)) & key.isNotNull(),
                           F.struct(F.lit(dim).alias("dimension"), F.lit(c).alias("column"), key.alias("grp"),
                                    "churn_pct", "n", "p_churn_pct", "p_churned", "p_churned_clv")))
    per = g.select(F.explode(F.array(*rows)).alias("x")).filter(F.col("x").isNotNull()).select("x.*")
    rank_w = Window.partitionBy("dimension").orderBy(F.desc("churn_pct"), F.asc("grp"))
    return (per.withColumn("rank", F.row_number().over(rank_w))
               .withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("dimension")))
               .filter(F.col("rank") <= top if top else F.lit(True))
               .select("dimension", "column", "rank", "grp", "churn_pct", "n", "groups",
                       F.col("p_churn_pct").alias("portfolio_churn_pct"), F.col("p_churned").alias("churned_total"),
                       F.col("p_churned_clv").alias("churned_clv")))


def adhoc_numeric_fallback(df: DataFrame, k: int | None = None) -> DataFrame:
    """No churn column: mean / std / min / max of all numeric columns (or the first ``k``), as rows."""
    from pyspark.sql.types import NumericType
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)][:k]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), r(F.avg(x), 4).alias("mean"),
                             r(F.stddev_samp(x), 4).alias("std"),
                             F.min(x).alias("min"), F.max(x).alias("max")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))
