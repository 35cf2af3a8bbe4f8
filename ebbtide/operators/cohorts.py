"""Cohort filters (D1-D9). Predicates are Catalyst filters evaluated in the scan's
stage. Only comparisons of plain columns reach the Parquet reader; those on derived
scores, on coerced text or on lowered names cannot, and read their columns whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import CLV_ALIASES, DIM_ALIASES, ID_ALIASES, RISK_ALIASES, find_col, find_dim
from ebbtide.functions.scalars import r, risk_label
from ebbtide.functions.value_counts import store_of
from ebbtide.operators.kpis import THRESHOLD_DP, _num, churn_flag, p75_threshold


def dimension_predicate(df: DataFrame, filters: dict[str, str | None]) -> tuple[Column, dict[str, str]]:
    """AND of trim+lower equality over the known dimensions present in ``df``.
    Unknown or absent dimensions are ignored (and not reported as applied).
    A null cell never equals a filter value."""
    preds, applied = [], {}
    for canonical, val in filters.items():
        if val is None or canonical not in DIM_ALIASES:
            continue
        col = find_dim(df, canonical)
        if col is None:
            continue
        preds.append(F.lower(F.trim(F.col(col).cast("string"))) == F.lit(val.strip().lower()))
        applied[canonical] = val
    return (reduce(lambda a, b: a & b, preds) if preds else F.lit(True)), applied


def filter_dimensions(df: DataFrame, filters: dict[str, str | None], limit: int = 100) -> DataFrame:
    """One page of matching rows, ordered by customer id (deterministic page)."""
    pred, _ = dimension_predicate(df, filters)
    cid = find_col(df, ID_ALIASES)
    out = df.filter(pred)
    return out.orderBy(F.col(cid)).limit(limit) if cid else out.limit(limit)


def filter_total_matches(df: DataFrame, filters: dict[str, str | None], limit: int = 100) -> DataFrame:
    pred, applied = dimension_predicate(df, filters)
    applied_txt = ",".join(f"{k}={v}" for k, v in sorted(applied.items()))
    return (df.filter(pred).agg(F.count(F.lit(1)).alias("total_matches"))
              .withColumn("returned_rows", F.least(F.col("total_matches"), F.lit(limit)))
              .withColumn("filters_applied", F.lit(applied_txt)))


def _cohort_cols(df: DataFrame) -> list[Column]:
    cid = find_col(df, ID_ALIASES)
    return [F.col(cid).alias("customer_id"),
            _num(df, RISK_ALIASES, 0.0).alias("churn_risk_score"),
            _num(df, CLV_ALIASES, 0.0).alias("estimated_clv")]


def high_risk_cohort(df: DataFrame) -> DataFrame:
    """risk >= p75(risk) (ties at the threshold included)."""
    risk = _num(df, RISK_ALIASES, 0.0)
    return df.filter(risk >= p75_threshold(df, RISK_ALIASES)).select(*_cohort_cols(df))


def high_value_cohort(df: DataFrame) -> DataFrame:
    """clv > p75(clv) (strict)."""
    clv = _num(df, CLV_ALIASES, 0.0)
    return df.filter(clv > p75_threshold(df, CLV_ALIASES)).select(*_cohort_cols(df))


def churned_cohort(df: DataFrame) -> DataFrame:
    return df.filter(churn_flag(df)).select(*_cohort_cols(df))


def segment_predicate(df: DataFrame, target: str) -> Column:
    """Literal (not regex) case-insensitive substring match on any of the
    region / segment / plan columns; "all" or "" means no filter."""
    val = target.strip().lower()
    if val in ("all", ""):
        return F.lit(True)
    cols = [c for c in (find_dim(df, "region"), find_dim(df, "customer_segment"), find_dim(df, "plan_type"))
            if c is not None]
    if not cols:
        return F.lit(False)
    return reduce(lambda a, b: a | b,
                  [F.coalesce(F.lower(F.col(c).cast("string")).contains(F.lit(val)), F.lit(False)) for c in cols])


def segment_contains(df: DataFrame, target: str) -> DataFrame:
    return df.filter(segment_predicate(df, target)).select(*_cohort_cols(df))


def effective_thresholds(df: DataFrame, thresholds: list[float]) -> dict[float, Column]:
    """For each distinct threshold: itself if any row reaches it, else p75(risk), over
    the whole table and before any segment filter. With a value-count store the maximum
    is known beforehand, and only thresholds out of reach look the quantile up; else both
    are scalar subqueries."""
    store, c = store_of(df), find_col(df, RISK_ALIASES)
    if store is not None and c is not None and c in store:
        top = store.maximum(c, fill_zero=True)
        return {float(t): F.lit(float(t)) if top is None or float(t) <= top else p75_threshold(df, RISK_ALIASES) for t in thresholds}
    top = df.agg(F.max(_num(df, RISK_ALIASES, 0.0))).scalar()
    p75 = p75_threshold(df, RISK_ALIASES)
    return {float(t): F.when(F.coalesce(top >= F.lit(float(t)), F.lit(True)), F.lit(float(t))).otherwise(p75) for t in thresholds}


def top_and_fallback(df: DataFrame) -> tuple[Column, Column]:
    """The largest risk score and p75(risk), both with nulls as 0: what decides the
    effective threshold of any asked one."""
    store, c = store_of(df), find_col(df, RISK_ALIASES)
    if store is not None and c is not None and c in store:
        return F.lit(store.maximum(c, fill_zero=True)).cast("double"), p75_threshold(df, RISK_ALIASES)
    return df.agg(F.max(_num(df, RISK_ALIASES, 0.0))).scalar(), p75_threshold(df, RISK_ALIASES)


def effective_threshold(df: DataFrame, threshold: float) -> Column:
    return effective_thresholds(df, [threshold])[float(threshold)]


def at_risk_auto_threshold(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """One row per input threshold: effective threshold, adjusted flag, cohort size."""
    risk = _num(df, RISK_ALIASES, 0.0)
    effs = effective_thresholds(df, thresholds)
    names = {t: f"_eff{k}" for k, t in enumerate(effs)}
    x = df.select(risk.alias("_risk"), *[effs[t].alias(names[t]) for t in effs])
    aggs = []
    for t in thresholds:
        eff = F.col(names[float(t)])
        aggs.append(F.struct(F.lit(float(t)).alias("input_threshold"),
                             r(F.first(eff), THRESHOLD_DP).alias("effective_threshold"),
                             (F.first(eff) != F.lit(float(t))).alias("adjusted"),
                             F.count(F.when(F.col("_risk") >= eff, 1)).alias("cohort_size")))
    return x.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def row_text_search(df: DataFrame, term: str) -> DataFrame:
    """Rows where any column's string form contains ``term`` (case-insensitive).
    The separator cannot occur in the term, so no false cross-column hits."""
    blob = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in df.columns]))
    return df.filter(blob.contains(F.lit(term.lower())))


def risk_band_counts(df: DataFrame) -> DataFrame:
    """High >= .65, Medium [.35, .65), Low < .35 over the risk column."""
    risk = _num(df, RISK_ALIASES, 0.0)
    return df.groupBy(risk_label(risk).alias("risk_band")).agg(F.count(F.lit(1)).alias("customers"))
