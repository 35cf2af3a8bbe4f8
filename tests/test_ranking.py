"""Distributed ranks."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from ebbtide.functions.ranking import with_rank, with_totals_before
from ebbtide.operators import ml


def test_ranks_over_many_ranges(spark):
    """Many small ranges cut from thin samples: the exchange runs once for sizes and rows."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5",
                "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # a third of the rows share a score
        df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.round(F.rand(3) * 100, 2)).alias("score"),
                                        F.concat(F.lit("k"), F.col("id")).alias("key"))
        df = df.groupBy("key").agg(F.max("score").alias("score"))
        got = with_rank(df, [-F.col("score"), F.col("key")], total="n").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.n for r in got} == {20_000}
    want = {r.key: k for k, r in enumerate(sorted(got, key=lambda r: (-r.score, r.key)), 1)}
    assert {r.key: r["rank"] for r in got} == want


def test_columns_of_one_side_only(spark):
    """Ranges cut from samples, and columns that only the rows or only the totals need: the exchange still runs once."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5",
                "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).select((F.xxhash64("id") % 1_000_003).alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 3).alias("other"))
        df = df.groupBy("k").agg(F.max("x").alias("x"), F.max("other").alias("other"))
        rows = sorted(df.collect())
        totals = with_totals_before(df, [F.col("k")], {"below": F.col("x")})
        wide, thin = totals.collect(), totals.select("below").collect()
        ranks = with_rank(df, [F.col("k")]).select("rank", "other").collect()
        pred = spark.range(20_000).select((F.xxhash64("id") % 1_000_003 / 1_000_003).alias("p"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("double").alias("label"))
        got = ml.classification_metrics(pred, "p", "label").first().roc_auc
        scored = [(r.p, r.label) for r in pred.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    below, at = {}, 0
    for r in rows:
        below[r.k], at = at, at + r.x
    assert {r.k: r.below for r in wide} == below and sorted(r.below for r in thin) == sorted(below.values())
    assert sorted(ranks) == [(k, r.other) for k, r in enumerate(rows, 1)]
    by: dict = {}
    for p, y in scored:
        by.setdefault(p, []).append(y == 1)
    negatives, wins = 0, 0.0
    for _, labels in sorted(by.items()):
        here = labels.count(False)
        wins += labels.count(True) * (negatives + here / 2)
        negatives += here
    assert abs(got - wins / (negatives * (len(scored) - negatives))) <= 5e-5


def test_ranks_of_nothing(spark):
    assert with_rank(spark.range(0), [F.col("id")], total="n").collect() == []


def test_no_task_ranks_all_groups(spark, sf_dir):
    for key in ("many_group_ranking", "many_group_estimates", "region_ranking", "report_region_table"):
        plan = E.queries()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"rangepartitioning", plan), key
        assert "Window [" not in plan, key
