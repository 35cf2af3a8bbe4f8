"""Derived customer columns (added only when absent from the input)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import find_col
from ebbtide.functions.scalars import clip, r, safe_numeric, sigmoid

# Raw inputs and the fill used when missing or unparseable.
RAW_FILLS = {"monthlycharges": 0.0, "tenuremonths": 12.0, "paymentdelaydays": 0.0, "supporttickets": 0.0}
# Risk logit weights and upsell probabilities.
RISK_W_DELAY, RISK_W_TICKETS, RISK_BIAS = 0.05, 0.10, -2.0
UPSELL_STANDARD, UPSELL_OTHER, UPSELL_NO_PLAN = 0.75, 0.30, 0.40
OFFER_COST_RATE = 0.10


def raw(df: DataFrame, name: str):
    """Coerced raw input with its fill; an absent column is the fill itself."""
    fill = RAW_FILLS[name]
    c = find_col(df, [name])
    return safe_numeric(F.col(c), fill) if c else F.lit(fill)


def enrich(df: DataFrame) -> DataFrame:
    """Add estimated_clv, churn_risk_score, satisfaction_score,
    upsell_probability, retention_offer_cost, complaints_90d,
    payment_failures_12m, region, customer_segment — each only if absent.

    All pure projections: Catalyst collapses them into the scan's stage.
    """
    have = {c.lower() for c in df.columns}
    mc, tm = raw(df, "monthlycharges"), raw(df, "tenuremonths")
    pdl, st = raw(df, "paymentdelaydays"), raw(df, "supporttickets")
    new = {}  # added in this order, in ONE projection (one analysis, not one per column)
    if "estimated_clv" not in have:
        new["estimated_clv"] = r(mc * tm, 2)
    if "churn_risk_score" not in have:
        z = F.lit(RISK_W_DELAY) * pdl + F.lit(RISK_W_TICKETS) * st + F.lit(RISK_BIAS)
        new["churn_risk_score"] = r(sigmoid(z), 4)
    if "satisfaction_score" not in have:
        new["satisfaction_score"] = r(F.lit(10.0) - clip(pdl / F.lit(10.0), 0.0, 9.0), 1)
    if "upsell_probability" not in have:
        plan = find_col(df, ["plantype"])
        new["upsell_probability"] = (F.when(F.lower(F.col(plan)) == "standard", F.lit(UPSELL_STANDARD))
                                     .otherwise(F.lit(UPSELL_OTHER)) if plan else F.lit(UPSELL_NO_PLAN))
    if "retention_offer_cost" not in have:
        clv_c = find_col(df, ["estimated_clv"])
        clv = F.col(clv_c).try_cast("double") if clv_c else new["estimated_clv"]
        new["retention_offer_cost"] = r(clv * F.lit(OFFER_COST_RATE), 2)
    if "complaints_90d" not in have:
        new["complaints_90d"] = st.cast("bigint")
    if "payment_failures_12m" not in have:
        new["payment_failures_12m"] = (pdl > F.lit(30.0)).cast("bigint")
    if "region" not in have and "city" in have:
        new["region"] = F.col(find_col(df, ["city"]))
    if "customer_segment" not in have and "plantype" in have:
        new["customer_segment"] = F.col(find_col(df, ["plantype"]))
    return df.withColumns(new) if new else df


_ENRICHED: dict[tuple, DataFrame] = {}


def enriched_customers(spark, sf_dir: str) -> DataFrame:
    """The enriched customers table with its value-count store. Table and store are
    written once per session and version of the source files; the DataFrame is an
    immutable plan over them."""
    import uuid

    from ebbtide.functions.value_counts import attach, write_value_counts
    from ebbtide.session import scratch_dir
    from ebbtide.sources.fixtures import customers, source_version
    key = (spark.sparkContext.applicationId, source_version(spark, sf_dir))
    if key not in _ENRICHED:
        df = enrich(customers(spark, sf_dir))
        _ENRICHED[key] = attach(df, write_value_counts(df, scratch_dir(spark, f"tables/customer-values-{uuid.uuid4().hex}")))
    return _ENRICHED[key]
