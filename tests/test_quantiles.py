"""The bracketed exact quantile equals Spark's exact percentile."""

import random

import pytest
from pyspark.sql import functions as F

from ebbtide.functions.quantiles import quantile_struct, quantiles_for

PROBS = [0.0, 0.01, 0.25, 0.35, 0.5, 0.75, 0.8, 0.99, 1.0]


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(20000):
        hot = 42.0 if i % 3 == 0 else round(rnd.lognormvariate(3, 1.2), 2)  # a third of rows share one value
        rows.append((i, round(rnd.gauss(100, 30), 2), hot, None if i % 7 == 0 else float(i % 101)))
    return spark.createDataFrame(rows, "id long, x double, hot double, sparse double")


def _same(frame, cols, **kw):
    row = frame.sparkSession.range(1).select(quantile_struct(frame, [F.col(c) for c in cols], PROBS, **kw).alias("q")).first().q
    want = frame.agg(*[F.percentile(c, PROBS).alias(c) for c in cols]).first()
    for i, c in enumerate(cols):
        for j, p in enumerate(PROBS):
            assert row[f"q{i}_{j}"] == pytest.approx(want[c][j], rel=1e-12, abs=1e-9), (c, p)


# coarse sketches: the brackets hold many rows and are narrowed on a small table too
@pytest.mark.parametrize("kw", [{}, {"accuracy": 1000}, {"accuracy": 50}, {"accuracy": 10}])
def test_equals_exact_percentile(frame, kw):
    _same(frame, ["x", "hot", "sparse", "id"], **kw)


def test_huge_values(spark):
    df = spark.createDataFrame([(1.7e15 + 1e6 * k, -4.0e18 + 1e12 * k) for k in range(501)], "a double, b double")
    _same(df, ["a", "b"], accuracy=20)


def test_all_null_column(spark):
    df = spark.createDataFrame([(i, None) for i in range(300)], "id long, z double")
    got = quantiles_for(df, [F.col("z"), F.col("id")], [0.5])
    row = spark.range(1).select(got[0][0].alias("z"), got[1][0].alias("id")).first()
    assert row["z"] is None and row["id"] == 149.5


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10, 11, 101])
def test_small_tables(spark, n):
    _same(spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("m")).repartition(3), ["id", "m"])
