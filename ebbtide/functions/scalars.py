"""Column -> Column builders. Everything here is a native Catalyst expression
(no Python UDF), so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(x: Column, n: int) -> Column:
    """Rounding to ``n`` places, half away from zero: round(x * 10^n) / 10^n.

    The scaled value is rounded as a double (no integer type, so it cannot
    saturate) and only to whole numbers, where every engine agrees; ``F.round``
    with places would round the decimal form of a double instead.
    """
    s = float(10 ** n)
    return F.round(x.cast("double") * F.lit(s), 0) / F.lit(s)


def sigmoid(z: Column, clamp: float = 20.0) -> Column:
    """Logistic function with the logit clamped to [-clamp, clamp]."""
    zc = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), z))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-zc))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def safe_numeric(c: Column, fill: float | None = None) -> Column:
    """Coerce anything to double; text that does not parse becomes null
    (``try_cast``: a plain cast raises under ANSI mode), NaN becomes null,
    then nulls take ``fill`` when one is given."""
    d = c.try_cast("double")
    d = F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    return F.coalesce(d, F.lit(float(fill))) if fill is not None else d


def _bands(x: Column, cuts: list[tuple[float, str]], default: str, strict: bool = False) -> Column:
    expr = None
    for cut, label in cuts:
        cond = (x > F.lit(cut)) if strict else (x >= F.lit(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


# ---------------------------------------------------------------------------
# Band cut-offs and labels that must equal the reference's.
# ---------------------------------------------------------------------------
RISK_LABEL_CUTS = [(0.65, "High"), (0.35, "Medium")]                 # else Low
RISK_LEVEL_CUTS = [(25.0, "Critical"), (20.0, "High"), (15.0, "Elevated")]  # else Moderate
CUSTOMER_LEVEL_CUTS = [(0.75, "Critical"), (0.55, "High"), (0.35, "Elevated")]  # else Moderate
SIGNAL_CONFIDENCE_CUTS = [(4, "High"), (2, "Medium")]                # else Low
SCORE_CONFIDENCE_CUTS = [(0.88, "High"), (0.75, "Medium")]           # else Low
SATISFACTION_CUTS = [(8.0, "Excellent"), (7.0, "Good"), (6.0, "Fair"), (5.0, "Poor")]  # else Critical
ROI_CUTS = [(50.0, "Excellent"), (20.0, "Strong"), (5.0, "Good"), (1.0, "Marginal")]   # else Negative
SEGMENT_ACTION_CUTS = [(25.0, "Premium Retention Offer"), (15.0, "Proactive Outreach")]  # strict >, else Monitor
CAMPAIGN_PRIORITY_CUTS = [(22.0, "P1 — Launch Now"), (15.0, "P2 — Next Cycle")]       # strict >, else P3 — Monitor


def risk_label(p: Column) -> Column:
    """Probability band: >=.65 High, >=.35 Medium, else Low."""
    return _bands(p, RISK_LABEL_CUTS, "Low")


def risk_level(churn_pct: Column, upper: bool = False) -> Column:
    """Churn-percentage level: >=25 Critical, >=20 High, >=15 Elevated, else Moderate."""
    e = _bands(churn_pct, RISK_LEVEL_CUTS, "Moderate")
    return F.upper(e) if upper else e


def customer_risk_level(p: Column) -> Column:
    return _bands(p, CUSTOMER_LEVEL_CUTS, "Moderate")


def confidence_from_signals(n: Column) -> Column:
    return _bands(n, SIGNAL_CONFIDENCE_CUTS, "Low")


def confidence_from_score(s: Column) -> Column:
    return _bands(s, SCORE_CONFIDENCE_CUTS, "Low")


def satisfaction_band(s: Column) -> Column:
    return _bands(s, SATISFACTION_CUTS, "Critical")


def roi_label(roi: Column) -> Column:
    return _bands(roi, ROI_CUTS, "Negative")


def segment_action(rate_pct: Column) -> Column:
    return _bands(rate_pct, SEGMENT_ACTION_CUTS, "Monitor", strict=True)


def campaign_priority(rate_pct: Column) -> Column:
    return _bands(rate_pct, CAMPAIGN_PRIORITY_CUTS, "P3 — Monitor", strict=True)


def truncate_text(s: Column, n: int, ellipsis: str = "…") -> Column:
    """First ``n`` characters plus an ellipsis when longer (display columns)."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(ellipsis))).otherwise(s)


def format_usd(v: Column) -> Column:
    """Compact USD: $1.2B / $3.4M / $56K / $789 (one decimal for M and B)."""
    v1 = r(v, 0)
    return (F.when(v >= 1e9, F.format_string("$%.1fB", r(v / 1e9, 1)))
             .when(v >= 1e6, F.format_string("$%.1fM", r(v / 1e6, 1)))
             .when(v >= 1e3, F.format_string("$%.0fK", r(v / 1e3, 0)))
             .otherwise(F.concat(F.lit("$"), F.format_number(v1, 0))))


def format_inr_exact(v: Column) -> Column:
    """INR with two decimals: Cr above 10^7, Lakh above 10^5, else rupees."""
    return (F.when(v >= 1e7, F.format_string("₹%.2f Cr", r(v / 1e7, 2)))
             .when(v >= 1e5, F.format_string("₹%.2f Lakh", r(v / 1e5, 2)))
             .otherwise(F.concat(F.lit("₹"), F.format_number(r(v, 0), 0))))


def format_inr_report(v: Column) -> Column:
    """INR as in the reports: Cr, L, else rupees."""
    return (F.when(v >= 1e7, F.format_string("₹%.1f Cr", r(v / 1e7, 1)))
             .when(v >= 1e5, F.format_string("₹%.1f L", r(v / 1e5, 1)))
             .otherwise(F.concat(F.lit("₹"), F.format_number(r(v, 0), 0))))


def format_percent(x: Column) -> Column:
    return F.format_string("%.1f%%", r(x, 1))


def run_stamp(ts: Column) -> Column:
    """A run's time as text, UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def format_inr(v: Column) -> Column:
    """INR: Cr above 10^7, Lakh above 10^5, else thousands-separated rupees."""
    return (F.when(v >= 1e7, F.format_string("₹%.1f Cr", r(v / 1e7, 1)))
             .when(v >= 1e5, F.format_string("₹%.1f Lakh", r(v / 1e5, 1)))
             .otherwise(F.concat(F.lit("₹"), F.format_number(r(v, 0), 0))))
