"""Column expressions on tiny literal frames: boundaries, nulls, absent columns."""

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import scalars as S
from ebbtide.functions.columns import find_col, find_col_containing, normalize_columns
from ebbtide.operators.enrich import enrich


def _eval(spark, values, fn, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_half_up_rounding(spark):
    assert _eval(spark, [1.005, 2.5, -0.4, 0.125], lambda x: S.r(x, 2)) == [1.0, 2.5, -0.4, 0.13]


def test_sigmoid_clamped(spark):
    out = _eval(spark, [0.0, 100.0, -100.0], S.sigmoid)
    assert out[0] == 0.5
    assert out[1] == pytest.approx(1 / (1 + 2.718281828459045 ** -20))
    assert out[2] == pytest.approx(1 / (1 + 2.718281828459045 ** 20))


def test_risk_label_boundaries(spark):
    assert _eval(spark, [0.65, 0.6499, 0.35, 0.3499, None], S.risk_label) == ["High", "Medium", "Medium", "Low", "Low"]


def test_risk_level_boundaries(spark):
    assert _eval(spark, [25.0, 24.99, 20.0, 15.0, 14.99], S.risk_level) == \
        ["Critical", "High", "High", "Elevated", "Moderate"]
    assert _eval(spark, [25.0], lambda x: S.risk_level(x, upper=True)) == ["CRITICAL"]


def test_customer_level_and_satisfaction(spark):
    assert _eval(spark, [0.75, 0.55, 0.35, 0.1], S.customer_risk_level) == ["Critical", "High", "Elevated", "Moderate"]
    assert _eval(spark, [8.0, 7.0, 6.0, 5.0, 4.9], S.satisfaction_band) == \
        ["Excellent", "Good", "Fair", "Poor", "Critical"]


def test_strict_cuts(spark):
    assert _eval(spark, [25.0, 25.01, 15.0, 15.01], S.segment_action) == \
        ["Proactive Outreach", "Premium Retention Offer", "Monitor", "Proactive Outreach"]
    assert _eval(spark, [22.0, 22.5, 15.5], S.campaign_priority) == \
        ["P2 — Next Cycle", "P1 — Launch Now", "P2 — Next Cycle"]


def test_roi_label(spark):
    assert _eval(spark, [50.0, 20.0, 5.0, 1.0, 0.99], S.roi_label) == \
        ["Excellent", "Strong", "Good", "Marginal", "Negative"]


def test_safe_numeric_text_nan_null(spark):
    out = _eval(spark, ["12.5", "abc", None, "NaN", " 3 "], lambda x: S.safe_numeric(x, 0.0), "string")
    assert out[:4] == [12.5, 0.0, 0.0, 0.0]


def test_truncate(spark):
    assert _eval(spark, ["abcdef", "abc"], lambda x: S.truncate_text(x, 3), "string") == ["abc…", "abc"]


def test_alias_resolution_first_in_list_order():
    cols = ["Churn", "churn_flag", "LTV", "clv"]
    assert find_col(cols, ["churn_flag", "churned", "churn"]) == "churn_flag"
    assert find_col(cols, ["estimated_clv", "clv", "ltv"]) == "clv"
    assert find_col(cols, ["nope"]) is None
    assert find_col_containing(["a", "support_tickets_12m"], ("support", "ticket")) == "support_tickets_12m"


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], "` Customer ID ` int, `Monthly Charges` int")
    assert normalize_columns(df).columns == ["customer_id", "monthly_charges"]


def test_enrich_derives_absent_columns(spark):
    df = spark.createDataFrame([("a", 100.0, 10.0, 40.0, 2.0, "Standard", "Delhi")],
                               "customer_id string, monthlycharges double, tenuremonths double, "
                               "paymentdelaydays double, supporttickets double, plantype string, city string")
    row = enrich(df).first().asDict()
    assert row["estimated_clv"] == 1000.0
    assert row["churn_risk_score"] == pytest.approx(round(1 / (1 + 2.718281828459045 ** -(0.05 * 40 + 0.2 - 2)), 4))
    assert row["satisfaction_score"] == 6.0
    assert row["upsell_probability"] == 0.75
    assert row["retention_offer_cost"] == 100.0
    assert row["complaints_90d"] == 2
    assert row["payment_failures_12m"] == 1
    assert row["region"] == "Delhi" and row["customer_segment"] == "Standard"


def test_enrich_keeps_present_columns_and_fills(spark):
    df = spark.createDataFrame([("a", None, "x", 0.9)],
                               "customer_id string, monthlycharges double, tenuremonths string, churn_risk_score double")
    row = enrich(df).first().asDict()
    assert row["churn_risk_score"] == 0.9          # present: untouched
    assert row["estimated_clv"] == 0.0             # charges null -> 0, tenure text -> 12
    assert row["upsell_probability"] == 0.4        # no plan column
    assert row["payment_failures_12m"] == 0


def test_enrich_offer_cost_from_present_clv(spark):
    """estimated_clv present (as text): the offer cost reads it, a non-number gives null."""
    df = spark.createDataFrame([("a", "250.5"), ("b", "n/a")], "customer_id string, estimated_clv string")
    out = enrich(df)
    rows = {r["customer_id"]: r.asDict() for r in out.collect()}
    assert rows["a"]["retention_offer_cost"] == 25.05 and rows["a"]["estimated_clv"] == "250.5"
    assert rows["b"]["retention_offer_cost"] is None
    # derived columns are appended after the input columns, in their fixed order
    assert out.columns[:3] == ["customer_id", "estimated_clv", "churn_risk_score"]
    assert out.columns[-3:] == ["retention_offer_cost", "complaints_90d", "payment_failures_12m"]
