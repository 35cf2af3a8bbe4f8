"""The value-count store, running totals, exact sums, the exact split, the risk ladder."""

import random
import uuid
from dataclasses import astuple

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ebbtide import session
from ebbtide.functions.aggs import davg, dsum
from ebbtide.functions.running import write_running
from ebbtide.functions.value_counts import attach, column_quantile, store_of, write_value_counts
from ebbtide.operators import cohorts, ml, whatif
from ebbtide.operators.tagging import whatif_parameters
from ebbtide.sources.fixtures import checked_order_key


def fresh(spark, name):
    """A folder of its own: the shared folder may outlive a run."""
    return session.scratch_dir(spark, f"{uuid.uuid4().hex}-{name}")


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(5)
    rows = [(i, 42.0 if i % 3 == 0 else round(rnd.gauss(0, 30), 1), None if i % 4 == 0 else float(i % 7 - 3), None)
            for i in range(3000)]
    return spark.createDataFrame(rows, "id long, hot double, sparse double, none double").repartition(5)


def test_quantiles_from_the_store(spark, frame):
    store = write_value_counts(frame, fresh(spark, "test-values"))
    pdf = frame.toPandas()
    asked, want = [], []
    for c in ("id", "hot", "sparse"):
        for p in PROBS:
            asked += [store.quantile(c, p).alias(f"{c}_{p}"), store.quantile(c, p, fill_zero=True).alias(f"{c}_{p}_zero")]
            x = pdf[c].astype(float)
            want += [np.quantile(x.dropna(), p), np.quantile(x.fillna(0), p)]
    got = spark.range(1).select(*asked).first()
    assert list(got) == pytest.approx(want, abs=1e-9)
    row = spark.range(1).select(store.quantile("none", 0.5).alias("a"), store.quantile("none", 0.5, fill_zero=True).alias("b")).first()
    assert row.a is None and row.b == 0.0
    assert store.maximum("none") is None and store.maximum("none", True) == 0.0 and store.maximum("sparse", True) == 3.0


def test_store_of_an_empty_table(spark, frame):
    store = write_value_counts(frame.limit(0), fresh(spark, "test-values"))
    assert spark.range(1).select(store.quantile("hot", 0.5).alias("a")).first().a is None


def test_store_belongs_to_one_table_only(spark, frame):
    df = attach(frame.select("*"), write_value_counts(frame, fresh(spark, "test-values")))
    assert store_of(df) is not None and store_of(df.where("id < 10")) is None
    q = spark.range(1).select(column_quantile(df, ["id"], 0.5).alias("a"), column_quantile(df.where("id < 11"), ["id"], 0.5).alias("b")).first()
    assert (q.a, q.b) == (1499.5, 5.0) and column_quantile(df, ["absent"], 0.5) is None


@pytest.fixture
def many_ranges(spark):
    """Small partitions are kept apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_totals(spark, many_ranges):
    rows = [(k % 3, float(v), v % 5) for k, v in enumerate(random.Random(2).sample(range(5000), 900))]
    df = spark.createDataFrame(rows, "g long, v double, n long").repartition(7)
    out = write_running(df, fresh(spark, "test-running"), ["g"], "v", ["n"])
    assert out.select("part").distinct().count() > 1
    for r in out.collect():
        assert r.n_before == sum(n for g, v, n in rows if g == r.g and v < r.v) and r.n_upto == r.n_before + r.n


@pytest.mark.parametrize("values, total", [
    ([1e-11, 3e-11], 4e-11), ([1e-12] * 3, 3e-12), ([1e18, 2e18, 5.25], 3e18), ([9e17] * 400, 3.6e20), ([1e300, -1e300, 7.5], 7.5),
    ([0.1] * 10, 1.0), ([None, 2.5], 2.5)])
def test_sums_keep_tiny_and_huge_values(spark, values, total):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    s, a = df.agg(dsum(F.col("x")), davg(F.col("x"))).first()
    n = sum(v is not None for v in values)
    assert s == pytest.approx(total, rel=1e-12) and a == pytest.approx(total / n, rel=1e-12)


def test_sum_of_nothing_is_null(spark):
    assert spark.createDataFrame([(None,)], "x double").agg(dsum(F.col("x"))).first()[0] is None


@pytest.mark.parametrize("hashes", [lambda i: "00ff", lambda i: f"{i % 3:04x}", lambda i: f"{i * 7919 % 65536:04x}"])
def test_split_is_exact_with_equal_hashes(spark, hashes):
    rows = [(i, hashes(i), float(i % 5 == 0)) for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, h string, y double").repartition(4)
    cuts = {r.cls: (r.cut_hash, r.cut_id) for r in ml.split_cuts(df, F.col("y"), F.col("h"), F.col("id"), 0.2).collect()}
    for y in (0.0, 1.0):
        own = sorted((h, i) for i, h, c in rows if c == y)
        assert cuts[y] == own[int(0.2 * len(own) + 0.5) - 1]


def test_split_covers_every_class(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 3) for i in range(1000)], "customer_id long, churned long")
    got = {(r.label, r.is_test): r.rows for r in ml.split_counts(df).collect()}
    for y in (0, 1, 2):
        n = sum(1 for i in range(1000) if i % 10 and i % 3 == y)
        assert got[y, True] == int(0.2 * n + 0.5) and got[y, True] + got[y, False] == n
    assert got[None, False] == 100


def test_order_keys_are_checked(spark):
    df = spark.createDataFrame([(1,), (None,), ((1 << 41) - 1,)], "k long")
    assert df.select(checked_order_key(F.col("k"))).count() == 3
    with pytest.raises(Exception, match="order key out of range"):
        spark.createDataFrame([(1 << 41,)], "k long").select(checked_order_key(F.col("k"))).collect()


ASKS = ["what if we spend $50k budget", "12% discount, risk > 0.35", "risk > 0.999 and 40% success", "risk 0.0001, budget $2m, 0% off",
        "", None, "risk score of 0.487 with 7.5% success", "simulate"]


def test_messages_equal_single_simulations(spark, customers):
    ladder = whatif.RiskLadder(customers, fresh(spark, "test-ladder"))
    msgs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(ASKS)], "conv_id long, turn long, text string")
    got = {r.conv_id: r for r in whatif.message_whatif(msgs, customers, ladder).collect()}
    params = {r.conv_id: r for r in whatif_parameters(msgs).collect()}
    assert len(got) == len(ASKS)
    for i, p in params.items():
        s = whatif.Scenario("All", p.risk_threshold, p.retention_budget, p.offer_discount_pct, p.expected_success_rate)
        assert astuple(s)[1:] == (p.risk_threshold, p.retention_budget, p.offer_discount_pct, p.expected_success_rate)
        want = whatif.campaign_whatif(customers, s).first().asDict()
        del want["scenario_id"]
        assert {k: v for k, v in got[i].asDict().items() if k not in ("conv_id", "turn")} == want, ASKS[i]


def test_ladder_over_many_ranges(spark, customers, many_ranges):
    ladder = whatif.RiskLadder(customers, fresh(spark, "test-ladder"))
    assert ladder.table.select("part").distinct().count() > 3
    scores = [r[0] for r in customers.select("churn_risk_score").collect()]
    ts = sorted({0.0, 1.0, *scores, *(s + 1e-5 for s in scores)})
    out = {r.threshold: r.n for r in ladder.cohorts(spark.createDataFrame([(t,) for t in ts], "threshold double")).collect()}
    assert out == {t: sum(s >= t for s in scores) for t in ts}


CUSTOMER_KEYS = ["kpi_summary", "churn_by_region", "enhanced_kpis", "risk_segments_top20", "churn_drivers", "region_estimates", "high_risk_cohort",
                 "high_value_cohort", "at_risk_auto_threshold", "nba_recommendations", "strategy_summary", "priority_list", "campaign_grid",
                 "quality_issues", "numeric_profile", "stratified_split", "clv_risk_quantiles", "revenue_at_risk_top_quartile", "iqr_outliers"]


def test_building_a_query_starts_no_job(spark, sf_dir):
    E.queries()["kpi_summary"](spark, sf_dir)  # the customers table is written once
    tracker = spark.sparkContext.statusTracker()
    for key in CUSTOMER_KEYS:
        spark.sparkContext.setJobGroup(f"build-{key}", key)
        E.queries()[key](spark, sf_dir)
        # reading the schema of a plain Parquet table is a job of Spark's own
        allowed = {"quality_issues": 2, "numeric_profile": 1, "iqr_outliers": 1}.get(key, 0)
        assert len(tracker.getJobIdsForGroup(f"build-{key}")) <= allowed, key
    spark.sparkContext.setJobGroup("", "")


def test_fallback_without_a_store(spark, customers):
    plain = customers.select("*")
    assert store_of(plain) is None and store_of(customers) is not None
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(cohorts.high_risk_cohort(plain)) == rows(cohorts.high_risk_cohort(customers))
    assert rows(cohorts.at_risk_auto_threshold(plain, [0.6, 1.0])) == rows(cohorts.at_risk_auto_threshold(customers, [0.6, 1.0]))
    assert rows(whatif.campaign_grid(plain, whatif.default_grid())) == rows(whatif.campaign_grid(customers, whatif.default_grid()))
