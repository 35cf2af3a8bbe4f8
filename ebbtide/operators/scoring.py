"""Scored-batch operators (E1, F16, F17, J5, J6): triage and insight numbers
for any table holding a churn probability column — the model's output
(``ml.score_customers``) or the heuristic ``churn_risk_score``.

One aggregation per table; per-customer tiers are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.aggs import count_if, dsum, ratio
from ebbtide.functions.scalars import (confidence_from_signals, customer_risk_level, format_usd, r, risk_level,
                                       safe_numeric)

# Probability bands, the large-account CLV cut, the recovery
# share of CLV at risk and the batch size for a confident insight.
HIGH_P, MED_P, IMMEDIATE_P = 0.65, 0.35, 0.55
KEY_ACCOUNT_CLV = 50_000.0
BATCH_RECOVERY = 0.28
CONFIDENT_BATCH = 100
PLAYBOOKS = [("account_manager", "Assign dedicated account manager"),
             ("automated_sequence", "Enrol in automated retention sequence"),
             ("monitor", "Monitor weekly via risk dashboard"),
             ("upsell", "Focus on upsell and expansion")]


def _playbook(df: DataFrame, prob: str, clv: str) -> Column:
    """The playbook's code: by probability, and by CLV where that is high."""
    p, v = safe_numeric(F.col(prob), 0.0), safe_numeric(F.col(clv), 0.0)
    return (F.when((p >= HIGH_P) & (v >= KEY_ACCOUNT_CLV), F.lit(PLAYBOOKS[0][0]))
             .when(p >= HIGH_P, F.lit(PLAYBOOKS[1][0]))
             .when(p >= MED_P, F.lit(PLAYBOOKS[2][0])).otherwise(F.lit(PLAYBOOKS[3][0])))


def customer_playbook(df: DataFrame, prob: str, clv: str, id_col: str = "customer_id") -> DataFrame:
    """J5 + J6: 4-band level, playbook code and first action per customer."""
    p = safe_numeric(F.col(prob), 0.0)
    code = _playbook(df, prob, clv)
    first = F.when(code == PLAYBOOKS[0][0], F.lit(PLAYBOOKS[0][1]))
    for c, text in PLAYBOOKS[1:]:
        first = first.when(code == c, F.lit(text))
    return df.select(F.col(id_col), p.alias("churn_probability"), customer_risk_level(p).alias("risk_level"),
                     code.alias("playbook"), first.alias("first_action"),
                     (p >= IMMEDIATE_P).alias("immediate_action"),
                     (p >= HIGH_P).alias("above_intervention_threshold"))


# The actions of each playbook, in order; {id} and {clv} are filled in.
PLAYBOOK_ACTIONS = {
    "account_manager": ["Priority 1 — Assign dedicated account manager to {id} immediately",
                        "Priority 2 — Issue personalised retention offer (≤10% of {clv} CLV budget justified)",
                        "Priority 3 — Schedule executive-level check-in call within 5 business days"],
    "automated_sequence": ["Priority 1 — Enrol {id} in automated retention email sequence (3-touch, 14-day cadence)",
                           "Priority 2 — Trigger in-app proactive support prompt on next login",
                           "Priority 3 — Offer one-time loyalty discount at next billing cycle"],
    "monitor": ["Monitor {id} weekly via risk dashboard",
                "Send proactive health-check communication in next 30 days",
                "Flag for upsell review — medium-risk customers often respond to value-add offers"],
    "upsell": ["{id} is low risk — focus on upsell and expansion opportunities",
               "Include in NPS survey cohort for satisfaction benchmarking"],
}
CONFIDENT_FACTORS = 3


def customer_actions(df: DataFrame, prob: str, clv: str, factors: Column, id_col: str = "customer_id") -> DataFrame:
    """J6 + J7: every action of each customer's playbook, with the confidence of the
    insight (High from three risk factors on) and the label of the signal count."""
    x = df.select(F.col(id_col), _playbook(df, prob, clv).alias("playbook"), safe_numeric(F.col(clv)).alias("_clv"),
                  factors.cast("int").alias("_f"))
    money = F.when(F.coalesce(F.col("_clv"), F.lit(0.0)) != 0, format_usd(F.col("_clv"))).otherwise(F.lit("unknown"))
    e = None
    for code, texts in PLAYBOOK_ACTIONS.items():
        arr = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{id}"), F.col(id_col).cast("string")), F.lit("{clv}"), money)
                        for t in texts])
        e = F.when(F.col("playbook") == code, arr) if e is None else e.when(F.col("playbook") == code, arr)
    conf = F.when(F.col("_f") >= CONFIDENT_FACTORS, F.lit("High")).otherwise(F.lit("Medium"))
    return x.select(id_col, "playbook", conf.alias("confidence"), confidence_from_signals(F.col("_f")).alias("signal_confidence"),
                    F.posexplode(e).alias("position", "action"))


def batch_risk_triage(df: DataFrame, prob: str) -> DataFrame:
    """F16: scored rows and High / Medium / Low counts (bands .65 / .35)."""
    p = safe_numeric(F.col(prob), 0.0)
    return df.agg(F.count(F.lit(1)).alias("total_scored"), count_if(p >= HIGH_P).alias("high_risk_count"),
                  count_if((p >= MED_P) & (p < HIGH_P)).alias("medium_risk_count"),
                  count_if(p < MED_P).alias("low_risk_count"))


def batch_insight(df: DataFrame, prob: str, clv: str) -> DataFrame:
    """E1 + F17: CLV of customers at p >= .65 (score and CLV sit on the same
    row: no join), band counts and shares, average probability and its
    level, 28 % recovery, confidence by batch size."""
    p = safe_numeric(F.col(prob), 0.0)
    v = safe_numeric(F.col(clv), 0.0)
    n = F.count(F.lit(1))
    hi, med = count_if(p >= HIGH_P), count_if((p >= MED_P) & (p < HIGH_P))
    a = df.agg(n.alias("total"), hi.alias("n_high"), med.alias("n_medium"),
               r(ratio(hi, n) * F.lit(100.0), 2).alias("high_pct"), r(ratio(med, n) * F.lit(100.0), 2).alias("medium_pct"),
               F.try_divide(dsum(p), n.cast("double")).alias("avg_p"),
               F.coalesce(dsum(F.when(p >= HIGH_P, v)), F.lit(0.0)).alias("clv_at_risk"))
    avg_pct = F.coalesce(F.col("avg_p"), F.lit(0.0)) * F.lit(100.0)
    return a.select("total", "n_high", "n_medium", "high_pct", "medium_pct",
                    r(avg_pct, 2).alias("avg_probability_pct"), risk_level(avg_pct).alias("risk_level"),
                    r(F.col("clv_at_risk"), 2).alias("clv_at_risk"),
                    r(F.col("clv_at_risk") * F.lit(BATCH_RECOVERY), 2).alias("projected_recovery"),
                    F.when(F.col("total") >= CONFIDENT_BATCH, F.lit("High")).otherwise(F.lit("Medium"))
                    .alias("confidence"))
