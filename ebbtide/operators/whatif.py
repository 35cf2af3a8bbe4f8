"""Retention-campaign what-if (M1-M4).

A scenario grid is evaluated in ONE pass over the customer table: each
scenario contributes a handful of conditional aggregates (count / sums of
its cohort) to a single global aggregation (partial aggregation per
partition, one tiny final merge), and the per-scenario arithmetic runs on
the resulting one-row-per-scenario frame. Large grids first reduce the
table to distinct (region, segment, plan, risk) rows and run in batches.
The auto-threshold fallback is a scalar subquery inside the plan. No cross
join with the parameter grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.aggs import dsum
from ebbtide.functions.columns import CLV_ALIASES, FEE_ALIASES, RISK_ALIASES, find_col
from ebbtide.functions.scalars import r, roi_label
from ebbtide.operators.cohorts import effective_thresholds, segment_predicate
from ebbtide.operators.kpis import _num

# Flat offer cost when the fee is unknown, confidence cut-offs.
FALLBACK_OFFER_COST = 500.0
HIGH_CONF_N, MED_CONF_N = 200, 50


@dataclass(frozen=True)
class Scenario:
    target_segment: str = "All"
    risk_threshold: float = 0.6
    retention_budget: float = 500_000.0
    offer_discount_pct: float = 10.0
    expected_success_rate: float = 0.18


def default_grid(region: str = "asia", segment: str = "building") -> list[Scenario]:
    """{All, one region, one segment, no match} x thresholds {.6, 1.0} x budgets {250k, 500k}."""
    out = []
    for tgt in ("All", region, segment, "no-such-segment"):
        for thr in (0.6, 1.0):
            for budget in (250_000.0, 500_000.0):
                out.append(Scenario(tgt, thr, budget, 10.0, 0.18))
    return out


def campaign_grid(df: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Evaluate every scenario; one row per scenario.

    Cohorts depend on (segment, threshold) only, so a scenario grid of any size is
    one pass: each customer is tagged with the distinct cohorts that it belongs to,
    the tags are summed up with map-side combine, and the scenarios (a table as
    large as the caller's grid) look up their cohort's sums.
    """
    risk = _num(df, RISK_ALIASES, 0.0)
    clv = _num(df, CLV_ALIASES, 0.0)
    has_fee = find_col(df, FEE_ALIASES) is not None
    fee = _num(df, FEE_ALIASES, 0.0)
    effs = effective_thresholds(df, [s.risk_threshold for s in scenarios])
    cohorts = {k: i for i, k in enumerate(dict.fromkeys((s.target_segment, float(s.risk_threshold)) for s in scenarios))}
    names = {t: f"_eff{k}" for k, t in enumerate(effs)}
    base = df.select(*_dim_cols(df), risk.alias("_risk"), clv.alias("_clv"), fee.alias("_fee"),
                     *[effs[t].alias(names[t]) for t in effs])
    tags = [F.when((F.col("_risk") >= F.col(names[t])) & segment_predicate(base, seg), F.lit(k))
            for (seg, t), k in cohorts.items()]
    sums = (base.select(F.explode(F.array(*tags)).alias("cohort"), "_clv", "_fee", "_risk")
            .where(F.col("cohort").isNotNull()).groupBy("cohort")
            .agg(F.count(F.lit(1)).alias("n"), dsum(F.col("_clv")).alias("rev"),
                 dsum(F.col("_fee")).alias("fee_sum"), dsum(F.col("_risk")).alias("risk_sum")))
    rows = [(i, s.target_segment, float(s.risk_threshold), float(s.retention_budget), float(s.offer_discount_pct),
             float(s.expected_success_rate), cohorts[s.target_segment, float(s.risk_threshold)])
            for i, s in enumerate(scenarios)]
    asked = df.sparkSession.createDataFrame(
        rows, "scenario_id int, target_segment string, risk_threshold double, retention_budget double, "
              "offer_discount_pct double, expected_success_rate double, cohort int")
    eff = F.lit(None).cast("double")
    for t, x in effs.items():
        eff = F.when(F.col("risk_threshold") == F.lit(t), x).otherwise(eff)
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    g = asked.withColumn("effective_threshold", eff).join(sums, "cohort", "left").select(
        "scenario_id", "target_segment", "risk_threshold", r(F.col("effective_threshold"), 6).alias("effective_threshold"), "retention_budget",
        "offer_discount_pct", "expected_success_rate", zero("n", "bigint"), zero("rev", "double"),
        zero("fee_sum", "double"), zero("risk_sum", "double"))
    return _finish(g, has_fee)


def _dim_cols(df: DataFrame) -> list[Column]:
    """The region / segment / plan columns the segment filter looks at (as present)."""
    from ebbtide.functions.columns import find_dim
    return [F.col(c) for c in dict.fromkeys(find_dim(df, k) for k in ("region", "customer_segment", "plan_type"))
            if c is not None]


def _finish(g: DataFrame, has_fee: bool, ids: list[str] = ["scenario_id"]) -> DataFrame:  # noqa: B006
    n = F.col("n")
    empty = n == 0
    nd = n.cast("double")
    avg_fee = F.when(empty, F.lit(0.0)).otherwise(F.col("fee_sum") / nd)
    avg_risk = F.when(empty, F.lit(0.0)).otherwise(F.col("risk_sum") / nd)
    offer0 = avg_fee * F.col("offer_discount_pct") / F.lit(100.0)
    offer = F.when(offer0 <= 0, F.lit(FALLBACK_OFFER_COST)).otherwise(offer0)
    g = g.withColumn("offer", offer)
    reach = F.least(F.floor(F.col("retention_budget") / F.col("offer")), n)
    g = g.withColumn("reach", F.when(empty, F.lit(0)).otherwise(reach).cast("bigint"))
    g = g.withColumn("saved", F.floor(F.col("reach") * F.col("expected_success_rate")).cast("bigint"))
    rev_saved = F.col("rev") / F.greatest(n, F.lit(1)).cast("double") * F.col("saved")
    g = g.withColumn("rev_saved", F.when(empty, F.lit(0.0)).otherwise(rev_saved))
    roi = r(F.col("rev_saved") / F.greatest(F.col("retention_budget"), F.lit(1.0)), 2)
    g = g.withColumn("roi", F.when(empty, F.lit(0.0)).otherwise(roi))
    coverage = F.col("reach") / F.greatest(n, F.lit(1)).cast("double") * F.lit(100.0)
    conf = (F.when((n >= HIGH_CONF_N) & F.lit(has_fee), F.lit("High"))
             .when(n >= MED_CONF_N, F.lit("Medium")).otherwise(F.lit("Low")))
    return g.select(
        *ids, "target_segment", "risk_threshold", r(F.col("effective_threshold"), 6).alias("effective_threshold"),
        (F.col("effective_threshold") != F.col("risk_threshold")).alias("threshold_adjusted"),
        "retention_budget", "offer_discount_pct", "expected_success_rate",
        n.alias("affected_customers"),
        r(F.col("rev"), 2).alias("current_revenue_at_risk"),
        r(avg_fee, 2).alias("avg_monthly_fee"),
        r(avg_risk, 4).alias("avg_churn_risk_score"),
        F.when(empty, F.lit(0.0)).otherwise(r(F.col("offer"), 2)).alias("avg_offer_cost"),
        F.col("reach").alias("customers_reachable"),
        F.col("saved").alias("expected_customers_saved"),
        r(F.col("rev_saved"), 2).alias("expected_revenue_saved"),
        F.when(empty, F.lit(0.0)).otherwise(r(F.col("reach") * F.col("offer"), 2)).alias("total_spend"),
        F.col("roi").alias("estimated_roi"),
        F.when(empty, F.lit("N/A")).otherwise(roi_label(F.col("roi"))).alias("roi_label"),
        F.when(empty, F.lit(0.0)).otherwise(r(coverage, 2)).alias("coverage_pct"),
        F.when(empty, F.lit("Low")).otherwise(conf).alias("confidence_level"))


def campaign_whatif(df: DataFrame, scenario: Scenario | None = None) -> DataFrame:
    return campaign_grid(df, [scenario or Scenario()])


def verdict(roi: Column, coverage: Column) -> tuple[Column, Column]:
    """M3: (roi tier, coverage tier) codes."""
    tier = (F.when(roi >= 20, F.lit("proceed")).when(roi >= 5, F.lit("strong"))
             .when(roi >= 1, F.lit("marginal")).otherwise(F.lit("negative")))
    cov = F.when(coverage < 50, F.lit("partial")).when(coverage < 80, F.lit("adequate")).otherwise(F.lit("full"))
    return tier, cov


def campaign_verdict(df: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    g = campaign_grid(df, scenarios)
    tier, cov = verdict(F.col("estimated_roi"), F.col("coverage_pct"))
    empty = F.col("affected_customers") == 0
    return g.select("scenario_id", F.when(empty, F.lit("adjust_filters")).otherwise(tier).alias("roi_tier"),
                    F.when(empty, F.lit("none")).otherwise(cov).alias("coverage_tier"))


def budget_projection(df: DataFrame, budgets=(250_000.0, 500_000.0), discount_pct: float = 10.0,
                      success: float = 0.18) -> DataFrame:
    """M4: fixed-budget projections from the portfolio average CLV (offer = 10 % of avg CLV)."""
    from ebbtide.operators.kpis import kpi_summary
    k = kpi_summary(df)
    rows = []
    for b in budgets:
        offer = F.greatest(F.col("avg_clv") * F.lit(discount_pct / 100.0), F.lit(1.0))
        reach = F.floor(F.lit(float(b)) / offer)
        saved = F.floor(reach * F.lit(success))
        protected = reach * F.lit(success) * F.col("avg_clv")
        rows.append(F.struct(F.lit(float(b)).alias("budget"), reach.alias("customers_reachable"),
                             saved.alias("expected_retained"), r(protected, 2).alias("revenue_protected"),
                             r(protected / F.lit(float(b)), 4).alias("estimated_roi")))
    return k.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------------------
# N6 into M1: a simulation for every message
# ---------------------------------------------------------------------------
class RiskLadder:
    """Customers added up by risk score, in order of the score.

    A written table with one row for each distinct score: the number of customers and the
    sums of CLV, fee and risk, each with its running total over the smaller scores. The
    cohort ``risk >= t`` of any threshold is the grand total less the running total at the
    first score not below t, so any number of thresholds is answered from one row each.
    """

    SUMS = ["n", *(f"{m}_{part}" for m in ("clv", "fee", "risk") for part in ("dec", "rest"))]

    def __init__(self, df: DataFrame, path: str):
        from ebbtide.functions.aggs import two_parts
        from ebbtide.functions.running import write_running
        risk, clv, fee = _num(df, RISK_ALIASES, 0.0), _num(df, CLV_ALIASES, 0.0), _num(df, FEE_ALIASES, 0.0)
        parts = {f"{m}_{k}": c for m, x in (("clv", clv), ("fee", fee), ("risk", risk)) for k, c in zip(("dec", "rest"), two_parts(x))}
        per = df.groupBy(risk.alias("score")).agg(F.count(F.lit(1)).alias("n"), *[
            F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,10)" if k.endswith("dec") else "double").alias(k) for k, c in parts.items()])
        self.has_fee = find_col(df, FEE_ALIASES) is not None
        self.table = write_running(per, path, [], "score", self.SUMS)

    def cohorts(self, thresholds: DataFrame) -> DataFrame:
        """(threshold, n, rev, fee_sum, risk_sum) of each distinct ``threshold``: an as-of
        lookup. Thresholds are dealt to the range that holds the next score (one bound a
        range), and inside a range one sorted pass carries the next score down to them."""
        bounds = self.table.groupBy("part").agg(F.max("score").alias("top")).agg(
            F.sort_array(F.collect_list(F.struct("top", "part"))).alias("b")).scalar()
        asked = thresholds.select("threshold").distinct().withColumn("b", bounds)
        holds = F.get(F.filter("b", lambda c: c["top"] >= F.col("threshold")), F.lit(0))
        asked = asked.select(holds["part"].alias("part"), F.col("threshold").alias("score"), F.lit(1).alias("kind"), F.lit(None).alias("at"))
        steps = self.table.select("part", "score", F.lit(0).alias("kind"), F.struct(*[f"{c}_before" for c in self.SUMS]).alias("at"))
        down = Window.partitionBy("part").orderBy(F.desc("score"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (steps.unionByName(asked.select("part", "score", "kind", F.col("at").cast(steps.schema["at"].dataType)))
                 .withColumn("at", F.last("at", ignorenulls=True).over(down)).where("kind = 1"))
        whole = self.table.agg(F.struct(*[F.sum(c).alias(c) for c in self.SUMS])).scalar()
        found = found.withColumn("whole", whole)

        def rest(c: str) -> Column:
            """Total less what lies below the threshold; nothing where no score reaches it."""
            return F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.col(f"whole.{c}") - F.col(f"at.{c}_before"))

        both = lambda m: rest(f"{m}_dec").cast("double") + rest(f"{m}_rest").cast("double")
        return found.select(F.col("score").alias("threshold"), rest("n").cast("bigint").alias("n"), both("clv").alias("rev"),
                            both("fee").alias("fee_sum"), both("risk").alias("risk_sum"))


def message_whatif(msgs: DataFrame, df: DataFrame, ladder: RiskLadder) -> DataFrame:
    """One simulation for each message (conv_id, turn, text), with the parameters that its
    text names: the row that ``campaign_whatif`` gives for them over ``df``.

    All rows of one threshold share a lookup in ``ladder``; the rest is row-local. A
    threshold that no customer reaches falls back to p75(risk), as in the grid."""
    from ebbtide.operators.cohorts import top_and_fallback
    from ebbtide.operators.tagging import whatif_parameters
    top, p75 = top_and_fallback(df)
    asked = whatif_parameters(msgs).withColumn("_top", top).withColumn("_p75", p75)
    reached = F.coalesce(F.col("_top") >= F.col("risk_threshold"), F.lit(True))
    asked = asked.withColumn("effective_threshold", F.when(reached, F.col("risk_threshold")).otherwise(F.col("_p75")))
    sums = ladder.cohorts(asked.select(F.col("effective_threshold").alias("threshold")))
    g = asked.join(sums, F.col("effective_threshold") == F.col("threshold"), "left").select(
        "conv_id", "turn", F.lit("All").alias("target_segment"), "risk_threshold", "effective_threshold", "retention_budget",
        "offer_discount_pct", "expected_success_rate", *[F.coalesce(F.col(c), F.lit(0)).cast(k).alias(c) for c, k in (
            ("n", "bigint"), ("rev", "double"), ("fee_sum", "double"), ("risk_sum", "double"))])
    return _finish(g, ladder.has_fee, ["conv_id", "turn"])
