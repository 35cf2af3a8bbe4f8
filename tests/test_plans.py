"""Physical plans: no Python UDFs, bounded top-k, no cartesian products."""

import pytest

from ebbtide import registry

registry.load_all()
# trained models: they run jobs while they are built, and tree models score rows in Arrow batches
SKIP = {"ml_metrics", "feature_importance", "score_customers", "artifact_scores", "boosted_metrics", "boosted_scores", "full_forest_metrics"}


from ebbtide.plans.inspect import physical_plan as _plan
from ebbtide.plans.inspect import scan_pushdown, slow_path_operators


@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - SKIP))
def test_no_python_udf_or_cartesian(spark, sf_dir, key):
    assert slow_path_operators(registry.QUERIES[key](spark, sf_dir)) == [], key


@pytest.mark.parametrize("key", ["priority_list", "risk_segments_top20", "top_high_risk", "sorted_page"])
def test_topk_is_take_ordered(spark, sf_dir, key):
    assert "TakeOrderedAndProject" in _plan(registry.QUERIES[key](spark, sf_dir))


def test_filters_reach_parquet_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from ebbtide.sources.tables import table
    df = table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select("text")
    assert scan_pushdown(df) == [("[IsNotNull(role), EqualTo(role,user)]", "struct<role:string,text:string>")]


@pytest.mark.parametrize("key", ["churn_by_region", "risk_segments", "duplicate_rows", "categorical_profile",
                                 "strategy_summary", "intent_counts"])
def test_grouping_combines_map_side(spark, sf_dir, key):
    """Partial aggregation before every shuffle: a key holding a third of all
    rows is pre-combined on each partition, never sent whole to one task."""
    p = _plan(registry.QUERIES[key](spark, sf_dir))
    assert "Exchange hashpartitioning" in p
    assert "partial_" in p


@pytest.mark.parametrize("key", ["churn_drivers", "campaign_grid", "at_risk_auto_threshold", "priority_list",
                                 "iqr_outliers", "quality_issues"])
def test_scan_count_bounded(spark, sf_dir, key):
    """Portfolio metrics and both worst-group breakdowns come from one
    grouping-sets pass; thresholds, bounds and fences are each one subquery,
    projected once, not repeated per expression."""
    import re
    df = registry.QUERIES[key](spark, sf_dir)
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    txt = df._jdf.queryExecution().explainString(mode)
    places = re.findall(r"^\(\d+\) Scan parquet.*?\nLocation: \w+ \[(.*?)\]", txt, re.M | re.S)
    scans = sum("values" not in p for p in places)  # lookups in the value-count store read single row groups
    # quantiles of a table without a store are three passes inside the plan, the last of which is planned twice and
    # runs once (its exchange is reused); quality_issues joins two tables (one pass of its own, two for duplicates)
    limit = {"churn_drivers": 1, "campaign_grid": 1, "at_risk_auto_threshold": 1, "priority_list": 2, "iqr_outliers": 5,
             "quality_issues": 14}[key]
    assert scans <= limit, (key, scans)
