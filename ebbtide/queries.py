"""Registration of every query key (Spark side + oracle SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ebbtide.checks import oracle_kpis as OK
from ebbtide.operators import kpis
from ebbtide.operators.enrich import enriched_customers as C
from ebbtide.registry import register
from ebbtide.session import scratch_dir


def _reg(name, sql_map, fn):
    register(name, sql_map.get(name))(fn)


# --- KPIs -------------------------------------------------------------------
_reg("kpi_summary", OK.SQL, lambda s, d: kpis.kpi_summary(C(s, d)))
_reg("churn_by_region", OK.SQL, lambda s, d: kpis.churn_breakdown(C(s, d), "region"))
_reg("churn_by_segment", OK.SQL, lambda s, d: kpis.churn_breakdown(C(s, d), "customer_segment"))
_reg("churn_by_plan", OK.SQL, lambda s, d: kpis.churn_breakdown(C(s, d), "plan_type"))
_reg("churn_by_region_sorted", OK.SQL, lambda s, d: kpis.churn_breakdown_sorted(C(s, d), "region"))
_reg("clv_risk_quantiles", OK.SQL, lambda s, d: kpis.clv_risk_quantiles(C(s, d)))
_reg("revenue_at_risk_top_quartile", OK.SQL, lambda s, d: kpis.revenue_at_risk_top_quartile(C(s, d)))
_reg("high_value_customers", OK.SQL, lambda s, d: kpis.high_value_customers(C(s, d)))
_reg("churn_concentration", OK.SQL, lambda s, d: kpis.churn_concentration(C(s, d)))
_reg("risk_concentration", OK.SQL, lambda s, d: kpis.churn_concentration(C(s, d), use_risk=True))
_reg("risk_segments", OK.SQL, lambda s, d: kpis.risk_segments(C(s, d)))
_reg("risk_segments_top20", OK.SQL, lambda s, d: kpis.risk_segments(C(s, d), top=20))
_reg("enhanced_kpis", OK.SQL, lambda s, d: kpis.enhanced_kpis(C(s, d)))
_reg("churn_drivers", OK.SQL, lambda s, d: kpis.churn_drivers(C(s, d)))
_reg("recovery_projection", OK.SQL, lambda s, d: kpis.recovery_projection(C(s, d)))
_reg("churn_counts", OK.SQL, lambda s, d: kpis.churn_counts(C(s, d)))
_reg("combined_exposure", OK.SQL, lambda s, d: kpis.combined_exposure(C(s, d)))
_reg("region_spread", OK.SQL, lambda s, d: kpis.group_spread(C(s, d), "region"))
_reg("segment_spread", OK.SQL, lambda s, d: kpis.group_spread(C(s, d), "customer_segment"))
_reg("region_ranking", OK.SQL, lambda s, d: kpis.group_ranking(C(s, d), "region"))
_reg("segment_ranking", OK.SQL, lambda s, d: kpis.group_ranking(C(s, d), "customer_segment"))



def _many_groups(s, d):
    """The customers with a region for every few of them."""
    return C(s, d).withColumn("region", F.concat_ws("-", "state", (F.col("customer_id") * 7 % 499).cast("string")))


_reg("many_group_ranking", OK.SQL, lambda s, d: kpis.group_ranking(_many_groups(s, d), "region"))
_reg("many_group_estimates", OK.SQL, lambda s, d: kpis.group_estimates(_many_groups(s, d), "region"))
_reg("region_estimates", OK.SQL, lambda s, d: kpis.group_estimates(C(s, d), "region"))
_reg("segment_estimates", OK.SQL, lambda s, d: kpis.group_estimates(C(s, d), "customer_segment"))

# --- cohorts ------------------------------------------------------------------
from ebbtide.checks import oracle_ops as OO  # noqa: E402
from ebbtide.operators import cohorts, nba, priority, whatif  # noqa: E402

_TEXT_COLS = ["customer_id", "region", "customer_segment", "plantype", "estimated_clv", "churn_risk_score"]
_reg("filter_dimensions", OO.SQL, lambda s, d: cohorts.filter_dimensions(C(s, d), OO.FILTERS, 100))
_reg("filter_total_matches", OO.SQL, lambda s, d: cohorts.filter_total_matches(C(s, d), OO.FILTERS, 100))
_reg("high_risk_cohort", OO.SQL, lambda s, d: cohorts.high_risk_cohort(C(s, d)))
_reg("high_value_cohort", OO.SQL, lambda s, d: cohorts.high_value_cohort(C(s, d)))
_reg("churned_cohort", OO.SQL, lambda s, d: cohorts.churned_cohort(C(s, d)))
_reg("segment_contains", OO.SQL, lambda s, d: cohorts.segment_contains(C(s, d), "asia"))
_reg("at_risk_auto_threshold", OO.SQL, lambda s, d: cohorts.at_risk_auto_threshold(C(s, d), OO.AUTO_THRESHOLDS))
_reg("row_text_search", OO.SQL, lambda s, d: cohorts.row_text_search(C(s, d), "machinery").select(*_TEXT_COLS))
_reg("risk_band_counts", OO.SQL, lambda s, d: cohorts.risk_band_counts(C(s, d)))

# --- next best action ---------------------------------------------------------
_reg("nba_recommendations", OO.SQL, lambda s, d: nba.nba_recommendations(C(s, d)))
_reg("nba_dimension_join", OO.SQL, lambda s, d: nba.nba_with_attributes(C(s, d)))
_reg("nba_input_validation", OO.SQL, lambda s, d: nba.nba_input_validation(C(s, d)))
def _bad_inputs(s, d):
    """Customers with planted bad values in every field but one."""
    k = F.col("customer_id")
    plant = {"churn_risk_score": (7, 1.5), "estimated_clv": (11, None), "upsell_probability": (13, 1.5),
             "retention_offer_cost": (17, -3.0), "complaints_90d": (19, -1), "satisfaction_score": (23, 10.5)}
    return C(s, d).withColumns({c: F.when(k % m == 0, F.lit(v)).otherwise(F.col(c)) for c, (m, v) in plant.items()})


_reg("nba_rejected_rows", OO.SQL, lambda s, d: nba.nba_rejected_rows(_bad_inputs(s, d)))
_reg("strategy_summary", OO.SQL, lambda s, d: nba.strategy_summary(C(s, d)))
_reg("nba_batch_totals", OO.SQL, lambda s, d: nba.nba_batch_totals(C(s, d)))
_reg("nba_portfolio_triage", OO.SQL, lambda s, d: nba.nba_portfolio_triage(C(s, d)))

# --- priority list and top-k --------------------------------------------------
_reg("minmax_normalize", OO.SQL, lambda s, d: priority.minmax_normalize(C(s, d)))
_reg("priority_score", OO.SQL, lambda s, d: priority.priority_score(C(s, d)))
_reg("priority_list", OO.SQL, lambda s, d: priority.priority_list(C(s, d), 500))
_reg("priority_class_counts", OO.SQL, lambda s, d: priority.priority_class_counts(C(s, d), 500))
_reg("priority_list_filtered", OO.SQL, lambda s, d: priority.priority_list_filtered(C(s, d), 20, segment="auto"))
_reg("top_high_risk", OO.SQL, lambda s, d: priority.top_high_risk(C(s, d), "europe"))
_reg("sorted_page", OO.SQL, lambda s, d: priority.sorted_page(C(s, d), "estimated_clv"))
_reg("risk_clv_scatter", OO.SQL, lambda s, d: priority.risk_clv_scatter(C(s, d)))
_reg("segment_strategy", OO.SQL, lambda s, d: priority.segment_strategy(C(s, d), 50))
_reg("action_truncate", OO.SQL, lambda s, d: priority.action_truncate(C(s, d), 10))

# --- what-if --------------------------------------------------------------------
def _ladder(s, d):
    """The customers' risk ladder, written once with their table."""
    df = C(s, d)
    if not hasattr(df, "_risk_ladder"):
        df._risk_ladder = whatif.RiskLadder(df, scratch_dir(s, f"tables/risk-ladder-{uuid.uuid4().hex}"))
    return df._risk_ladder


def _questions(s, d):
    """The users' messages, and a question for each customer with parameters of its own."""
    k = F.col("customer_id")
    ask = F.concat(F.lit("What if we offer "), k % 37, F.lit("% discount to customers with risk > 0."),
                   F.lpad((k * 131 % 1000).cast("string"), 3, "0"), F.lit(", budget $"), 50 + k % 900, F.lit("k and "),
                   5 + k % 60, F.lit("% success?"))
    asked = C(s, d).select((-k).alias("conv_id"), F.lit(0).cast("long").alias("turn"), ask.alias("text"))
    return tagging.user_messages(T(s, d, "conversations")).unionByName(asked)


_reg("campaign_whatif", OO.SQL, lambda s, d: whatif.campaign_whatif(C(s, d)))
_reg("campaign_grid", OO.SQL, lambda s, d: whatif.campaign_grid(C(s, d), whatif.default_grid()))
_reg("campaign_verdict", OO.SQL, lambda s, d: whatif.campaign_verdict(C(s, d), whatif.default_grid()))
_reg("whatif_messages", OO.SQL, lambda s, d: whatif.message_whatif(_questions(s, d), C(s, d), _ladder(s, d)))
_reg("budget_projection", OO.SQL, lambda s, d: whatif.budget_projection(C(s, d)))

# --- profiling and domain tagging ---------------------------------------------
from ebbtide.checks import oracle_profile as OP  # noqa: E402
from ebbtide.operators import profile  # noqa: E402
from ebbtide.functions.scalars import r  # noqa: E402
from ebbtide.sources.tables import table as T  # noqa: E402


def _labelled_docs(s, d):
    return T(s, d, "documents").join(T(s, d, "labels"), "doc_id", "left").select(*OP.QI_COLS)


_reg("column_catalog", OP.SQL, lambda s, d: profile.column_catalog(C(s, d)))
_reg("missing_report", OP.SQL, lambda s, d: profile.missing_report(C(s, d)))
_reg("top_missing", OP.SQL, lambda s, d: profile.top_missing(C(s, d)))
_reg("duplicate_rows", OP.SQL, lambda s, d: profile.duplicate_rows(T(s, d, "events")))
_reg("numeric_profile", OP.SQL, lambda s, d: profile.numeric_profile(T(s, d, "lineitem"), OP.LINEITEM_NUM))
_reg("categorical_profile", OP.SQL, lambda s, d: profile.categorical_profile(C(s, d), OP.CAT_COLS))
_reg("iqr_outliers", OP.SQL, lambda s, d: profile.iqr_outliers(T(s, d, "events"), OP.EVENT_NUM))
_reg("quality_issues", OP.SQL, lambda s, d: profile.quality_issues(_labelled_docs(s, d)))
_reg("data_quality_rating", OP.SQL, lambda s, d: profile.data_quality_rating(C(s, d)))
_reg("dataset_profile_summary", OP.SQL, lambda s, d: profile.dataset_profile_summary(C(s, d)))
_reg("domain_tag_documents", OP.SQL, lambda s, d: profile.domain_tag_documents(T(s, d, "documents")))
_reg("domain_metadata_join", OP.SQL,
     lambda s, d: profile.domain_metadata_join(profile.domain_tag_documents(T(s, d, "documents"))))

# --- question tagging ------------------------------------------------------------
from ebbtide.checks import oracle_tagging as OT  # noqa: E402
from ebbtide.operators import tagging  # noqa: E402


def _msgs(s, d):
    return tagging.user_messages(T(s, d, "conversations"))


_reg("intent_keyword_tag", OT.SQL, lambda s, d: tagging.tag_intents_keyword(_msgs(s, d)))
_reg("entity_tag", OT.SQL, lambda s, d: tagging.tag_entities(_msgs(s, d)))
_reg("parameter_extract", OT.SQL, lambda s, d: tagging.extract_parameters(_msgs(s, d)))
_reg("intent_regex_tag", OT.SQL, lambda s, d: tagging.tag_intents_regex(_msgs(s, d)))
_reg("agent_route", OT.SQL, lambda s, d: tagging.route_agents(_msgs(s, d)))
_reg("whatif_params_from_text", OT.SQL, lambda s, d: tagging.whatif_parameters(_msgs(s, d)))
_reg("intent_counts", OT.SQL, lambda s, d: tagging.intent_counts(tagging.tag_intents_regex(_msgs(s, d))))

# --- report tables ------------------------------------------------------------------
from ebbtide.checks import oracle_reports as OR  # noqa: E402
from ebbtide.operators import reports  # noqa: E402

_reg("report_scorecard", OR.SQL, lambda s, d: reports.report_scorecard(C(s, d)))
_reg("report_segment_table", OR.SQL, lambda s, d: reports.report_segment_table(C(s, d)))
_reg("report_region_table", OR.SQL, lambda s, d: reports.report_region_table(C(s, d)))
_reg("report_financials", OR.SQL, lambda s, d: reports.report_financials(C(s, d)))
_reg("report_priority_table", OR.SQL,
     lambda s, d: reports.report_priority_table(C(s, d), 10, region=OR.REPORT_REGION))

# --- ad-hoc insights on any table ---------------------------------------------------
_reg("adhoc_insights", OK.SQL, lambda s, d: kpis.adhoc_insights(C(s, d)))
_reg("adhoc_numeric_fallback", OK.SQL, lambda s, d: kpis.adhoc_numeric_fallback(T(s, d, "lineitem")))

# --- churn-propensity ML --------------------------------------------------------------
from ebbtide.checks import oracle_ml as OM  # noqa: E402
from ebbtide.operators import ml  # noqa: E402


def _models(s, d):
    # LR + RF as in the source (its boosted model is optional); trained once per version of the customers table
    df = C(s, d)
    if not hasattr(df, "_models"):
        df._models = ml.TrainedModels(df, include_gbt=False)
    return df._models


def _risk_scored(s, d):
    return C(s, d).select("churned", "churn_risk_score",
                          (F.col("churn_risk_score") >= ml.PRED_CUT).cast("double").alias("prediction"))


_reg("ml_feature_selection", OM.SQL, lambda s, d: ml.feature_selection(C(s, d)))
_reg("stratified_split", OM.SQL, lambda s, d: ml.split_counts(C(s, d)))
_reg("class_weights", OM.SQL, lambda s, d: ml.class_weights(C(s, d)))
_reg("median_impute", OM.SQL, lambda s, d: ml.median_values(C(s, d), OM.ML_NUM))
_reg("mode_impute", OM.SQL, lambda s, d: ml.mode_values(C(s, d), OM.ML_CAT_PREFERRED + OM.ML_CAT_OTHER))
_reg("roc_auc_rank", OM.SQL,
     lambda s, d: ml.roc_auc(C(s, d), "churn_risk_score", "churned").select(r(F.col("auc"), 6).alias("roc_auc")))
_reg("classification_metrics", OM.SQL,
     lambda s, d: ml.classification_metrics(_risk_scored(s, d), "churn_risk_score", "churned", "prediction"))


def _trees(s, d):
    """Training table of the tree models, one for each version of the customers table."""
    df = C(s, d)
    if not hasattr(df, "_trees"):
        df._trees = ml.TreeTraining(df)
    return df._trees


def _boosted_scores(s, d):
    t = _trees(s, d)
    return t.scored(t.boosted()).select(F.col("id").alias("customer_id"), "is_test", "label", r(F.col("probability"), 4).alias("churn_probability"))


_reg("boosted_metrics", {}, lambda s, d: _trees(s, d).metrics(_trees(s, d).boosted(), "GradientBoosting"))
_reg("boosted_scores", {}, _boosted_scores)
_reg("full_forest_metrics", {}, lambda s, d: _trees(s, d).metrics(_trees(s, d).forest(), "RandomForest"))
_reg("ml_metrics", {}, lambda s, d: _models(s, d).metrics)
_reg("feature_importance", {}, lambda s, d: _models(s, d).importances())
_reg("score_customers", {}, lambda s, d: ml.score_customers(_models(s, d).best, C(s, d), _models(s, d).importances()))

# --- sources and sinks ------------------------------------------------------------------
from ebbtide.checks import oracle_io as OI  # noqa: E402
from ebbtide.sources import delimited as DL  # noqa: E402
from ebbtide.sources import io as IO  # noqa: E402
from ebbtide.sources.artifacts import ArtifactStore  # noqa: E402
from ebbtide.sources.tables import append_chunks  # noqa: E402


def _display_names(df):
    """Header names as a spreadsheet would show them ("Customer Id")."""
    return {c: " " + c.replace("_", " ").title() + " " for c in df.columns}


def _csv_scan(s, d):
    df = C(s, d)
    return IO.roundtrip(df, "csv", header_names=_display_names(df))


def _delimited(s, d):
    """A delimited text for each customer: their orders, with quoted remarks that hold
    separators and quotes, empty fields, a short last line, and separators by turns."""
    sep = F.get(F.array(F.lit(","), F.lit("\t"), F.lit("|")), (F.col("doc_id") % 3).cast("int"))
    o = T(s, d, "orders").where(F.col("o_custkey").isNotNull() & F.col("o_orderkey").isNotNull()).withColumn("doc_id", F.col("o_custkey"))
    remark = F.concat(F.lit('"said ""'), "o_orderpriority", F.lit('""'), F.when(F.col("o_orderkey") % 2 == 0, sep).otherwise(F.lit("")), F.lit(' twice"'))
    line = F.concat_ws("\u0001", F.col("o_orderkey"), F.when(F.col("o_orderkey") % 4 == 1, F.lit("")).otherwise(F.col("o_orderstatus")),
                       F.floor("o_totalprice").cast("long"), F.col("o_orderkey") % 2 == 0, remark)
    line = F.replace(line, F.lit("\u0001"), sep)
    rows = o.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("rows"))
    head = F.replace(F.lit("order key\u0001status\u0001price\u0001even\u0001remark\n"), F.lit("\u0001"), sep)
    last = F.concat(F.lit("\n-1"), sep, F.lit("X"), sep, F.lit("0"), sep, F.lit("true"))
    return rows.select("doc_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["l"]), "\n"), last).alias("text"))


def _text_table(s, d):
    """The orders written as pipe-separated text files, sniffed and read with inferred types."""
    path = IO.new_output_dir(s, "text-table")
    T(s, d, "orders").select(F.col("o_orderkey").alias(" Order Key "), "o_orderstatus", "o_totalprice", "o_orderpriority").write.option(
        "header", True).option("sep", "|").csv(path)
    return DL.read_text_table(s, path)


def _chunks(s, d):
    """Three chunks of the customers with differing columns and types, appended."""
    k, df = F.col("customer_id"), C(s, d)
    a = df.where(k % 3 == 0).select(k.cast("int").alias("Customer Id"), F.floor("estimated_clv").cast("int").alias("clv"), "region")
    b = df.where(k % 3 == 1).select("customer_id", F.col("estimated_clv").alias("clv"), F.lit(None).alias("region"), "tenuremonths")
    c = df.where(k % 3 == 2).select("customer_id", F.col("estimated_clv").cast("decimal(18,2)").alias("CLV"), F.col("state").alias("region"),
                                    F.concat(F.col("tenuremonths").cast("string"), F.lit(" months")).alias("tenuremonths"))
    return append_chunks([a, b, c])


def _versions(s, d):
    """Two committed versions and one that was never finished: the second one is read."""
    store = ArtifactStore(s, IO.new_output_dir(s, "artifacts"))
    store.write(tables={"churn": kpis.churn_breakdown(C(s, d), "region")})
    store.write(tables={"churn": kpis.churn_breakdown(C(s, d), "customer_segment")})

    class Lost(Exception):
        pass

    def lose():
        raise Lost

    try:
        store.write(tables={"churn": kpis.churn_breakdown(C(s, d), "plan_type")}, before_commit=lose)
    except Lost:
        pass
    return store.table("churn")


def _saved_scores(s, d):
    """Scores by the model, and with the importances, as read back from a saved version."""
    store = ArtifactStore(s, IO.new_output_dir(s, "models"))
    _models(s, d).save_version(store)
    return ml.score_customers(store.model("model"), C(s, d), store.table("importances").orderBy(F.desc("importance"), "feature"))


_reg("csv_scan", OI.SQL, _csv_scan)
_reg("json_roundtrip", OI.SQL, lambda s, d: IO.roundtrip(C(s, d), "json"))
_reg("parquet_roundtrip", OI.SQL, lambda s, d: IO.roundtrip(C(s, d), "parquet"))
_reg("sample_rows", OI.SQL, lambda s, d: IO.sample_rows(C(s, d), 10, "customer_id"))
_reg("export_action_list", OI.SQL, lambda s, d: IO.export_action_list(priority.priority_list(C(s, d), 500))[1])
_reg("sniff_delimiter", OI.SQL, lambda s, d: IO.sniff_delimiter(T(s, d, "documents")))
_reg("delimited_cells", OI.SQL, lambda s, d: DL.parse_texts(_delimited(s, d)))
_reg("delimited_types", OI.SQL, lambda s, d: DL.field_types(DL.parse_texts(_delimited(s, d))))
_reg("delimited_documents", OI.SQL, lambda s, d: DL.parse_texts(T(s, d, "documents")))
_reg("text_table", OI.SQL, _text_table)
_reg("append_chunks", OI.SQL, _chunks)
_reg("artifact_versions", OI.SQL, _versions)
_reg("artifact_scores", {}, _saved_scores)
_reg("text_preview", OI.SQL, lambda s, d: IO.text_preview(T(s, d, "documents")))

# --- scored batches, enrichment, bands, formats ---------------------------------------
from ebbtide.functions.scalars import risk_level as _risk_level, satisfaction_band  # noqa: E402
from ebbtide.operators import scoring  # noqa: E402

_reg("enrich_customers", OO.SQL, lambda s, d: C(s, d).select(*[c.strip() for c in OO.ENRICHED_COLS.split(",")]))
_reg("customer_playbook", OO.SQL, lambda s, d: scoring.customer_playbook(C(s, d), "churn_risk_score", "estimated_clv"))
_reg("batch_risk_triage", OO.SQL, lambda s, d: scoring.batch_risk_triage(C(s, d), "churn_risk_score"))
_reg("batch_insight", OO.SQL, lambda s, d: scoring.batch_insight(C(s, d), "churn_risk_score", "estimated_clv"))
_reg("satisfaction_bands", OO.SQL, lambda s, d: C(s, d).groupBy(
    satisfaction_band(F.coalesce(F.col("satisfaction_score"), F.lit(0.0))).alias("satisfaction_band"))
    .agg(F.count(F.lit(1)).alias("customers")))
_reg("risk_level_by_region", OO.SQL, lambda s, d: kpis.churn_breakdown(C(s, d), "region").select(
    "region", "churn_rate_pct", _risk_level(F.col("churn_rate_pct")).alias("risk_level")))
_reg("format_money", OO.SQL, lambda s, d: reports.money_by_region(C(s, d)))
_reg("breakdown_map", OO.SQL, lambda s, d: kpis.breakdown_map(C(s, d), "region").select(
    F.to_json("churn_by_region").alias("churn_by_region")))
_reg("source_context", OP.SQL, lambda s, d: profile.source_context(C(s, d), "customers"))

# --- whole-profile, segment, action and format results ---------------------------------
from ebbtide.operators.enrich import enrich  # noqa: E402


def _plain_customers(s, d):
    """The customers as a table with a city and without region, segment and failures."""
    return enrich(C(s, d).select("customer_id", F.col("state").alias("city"), "plantype", "monthlycharges", "tenuremonths",
                                 "paymentdelaydays", "supporttickets", "churned"))


def _factors():
    """How many of four warning signs a customer shows."""
    x = lambda c, fill: F.coalesce(F.col(c).cast("double"), F.lit(float(fill)))
    return ((x("paymentdelaydays", 0) > 30).cast("int") + (x("supporttickets", 0) >= 2).cast("int")
            + (x("tenuremonths", 12) < 6).cast("int") + (x("satisfaction_score", 10) < 6).cast("int"))


_reg("enhanced_kpi_segments", OK.SQL, lambda s, d: kpis.enhanced_kpi_segments(C(s, d)))
_reg("enrich_derived_dims", OO.SQL, lambda s, d: _plain_customers(s, d).select(
    "customer_id", "region", "customer_segment", "payment_failures_12m", "estimated_clv", "churn_risk_score",
    "satisfaction_score", "complaints_90d"))
_reg("customer_actions", OO.SQL, lambda s, d: scoring.customer_actions(C(s, d), "churn_risk_score", "estimated_clv", _factors()))
_reg("display_formats", OO.SQL, lambda s, d: reports.display_formats(C(s, d), "2026-01-02 03:04:05"))
_reg("profile_report", OP.SQL, lambda s, d: profile.profile_report(C(s, d), OP.PROFILE_NUM, OP.CAT_COLS, key="customer_id"))
_reg("source_insights", OP.SQL, lambda s, d: profile.source_insights(C(s, d), "customers"))
