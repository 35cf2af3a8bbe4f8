"""Question tagging on the source's own sample questions (expected values read off its rules)."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import tagging as TG

SAMPLES = [
    # message, keyword intent, regex intent, agent
    ("What is the churn rate?", "churn_rate", "churn_rate", "DataAnalystAgent"),
    ("Give me an executive summary", "kpi_summary", "executive", "ExecutiveBriefingAgent"),
    ("Which region has the highest churn?", "region_analysis", "region_breakdown", "DataAnalystAgent"),
    ("Which segment has the highest churn?", "segment_analysis", "segment_breakdown", "DataAnalystAgent"),
    ("What is the revenue at risk?", "revenue_risk", "revenue_risk", "DataAnalystAgent"),
    ("Who are the top priority customers for outreach?", "unknown", "top_customers", "RetentionStrategistAgent"),
    ("Recommend retention strategies for premium customers", "recommend", "specific_segment",
     "RetentionStrategistAgent"),
    ("Simulate a $500,000 retention campaign with 10% discount", "recommend", "scenario", "ScenarioPlannerAgent"),
    ("How is customer satisfaction?", "unknown", "satisfaction", "DataAnalystAgent"),
    ("What did I upload?", "unknown", "upload_info", "UploadedDataAgent"),
    ("Show the most at-risk customers in South", "region_analysis", "specific_region", "DataAnalystAgent"),
    ("Are there data quality issues?", "data_profile", "general_analysis", "DataAnalystAgent"),
    ("How is Enterprise performing vs SMB?", "segment_analysis", "specific_segment", "DataAnalystAgent"),
]


@pytest.fixture(scope="module")
def msgs(spark):
    rows = [(i, 1, "user", m) for i, (m, *_rest) in enumerate(SAMPLES)]
    return TG.user_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def _by_id(df, col):
    return {r["conv_id"]: r[col] for r in df.collect()}


def test_keyword_intents(msgs):
    got = _by_id(TG.tag_intents_keyword(msgs), "intent")
    assert [got[i] for i in range(len(SAMPLES))] == [s[1] for s in SAMPLES]


def test_regex_intents(msgs):
    got = _by_id(TG.tag_intents_regex(msgs), "intent")
    assert [got[i] for i in range(len(SAMPLES))] == [s[2] for s in SAMPLES]


def test_agent_routes(msgs):
    got = _by_id(TG.route_agents(msgs), "agent")
    assert [got[i] for i in range(len(SAMPLES))] == [s[3] for s in SAMPLES]


def test_entities_first_listed_word_wins(spark):
    df = spark.createDataFrame([(1, 1, "user", "compare northeast with the mid-market tier")],
                               "conv_id long, turn long, role string, text string")
    row = TG.tag_entities(df).first()
    assert row["region"] == "North"          # "north" precedes "northeast"
    assert row["segment"] == "Mid-Market"


def test_parameters(spark):
    df = spark.createDataFrame([(1, 1, "user", "Top 15 customers in Pune with a $2.5m budget and 20% off"),
                                (2, 1, "user", "nothing here")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r.asDict() for r in TG.extract_parameters(df).collect()}
    assert got[1]["budget"] == 2_500_000.0 and got[1]["discount"] == 20.0 and got[1]["top_n"] == 15
    assert got[1]["region"] == "Pune" and got[1]["segment"] is None
    assert got[2]["budget"] is None and got[2]["top_n"] is None


def test_whatif_parameters(spark):
    df = spark.createDataFrame([(1, 1, "user", "Run a what-if with 50k budget, risk threshold 0.7 and 25% success"),
                                (2, 1, "user", "Simulate a $500,000 retention campaign with 10% discount")],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r.asDict() for r in TG.whatif_parameters(df).collect()}
    assert got[1]["retention_budget"] == 50_000.0
    assert got[1]["risk_threshold"] == 0.7 and got[1]["expected_success_rate"] == 0.25
    assert got[1]["offer_discount_pct"] == 10.0
    assert got[2]["retention_budget"] == 500_000.0 and got[2]["risk_threshold"] == 0.6


def test_intent_counts_sum(spark, sf_dir):
    from ebbtide.sources.tables import table
    m = TG.user_messages(table(spark, sf_dir, "conversations"))
    counts = TG.intent_counts(TG.tag_intents_regex(m))
    assert counts.agg(F.sum("messages")).first()[0] == m.count()
