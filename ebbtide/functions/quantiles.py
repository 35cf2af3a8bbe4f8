"""Exact quantiles (linear interpolation, as pandas and ``quantile_cont``) inside the
plan, by one path at every table size and with bounded memory. Nothing runs while a
query is built: the result is a scalar subquery, and its passes are subqueries of it.

Any number of columns and probabilities share the passes:

1. non-null counts, and a bracket around each target rank from a ``percentile_approx``
   sketch of fixed accuracy;
2. rows below every bracket;
3. the bracketed rows, 4 in 10,000 and those equal to a bound, tagged (column,
   probability) and reduced to (value, count) by a hash aggregation (a value repeated a
   billion times is one row). A bracket is cut into slices of equal width; a running
   count over the slices' totals finds the one or two that hold the wanted ranks, and
   only their values are ordered.

No task holds more than a sketch or one slice. Pass 2 hands the bounds of pass 1 on to
pass 3 together with its counts, so all use the same bounds. Should a sketch break its
promise, the plan fails instead of giving a wrong number.

Tables written with a value-count store (``functions.value_counts``) look their
quantiles up there instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Slices of a bracket.
SLICES = 1024


def quantile_struct(df: DataFrame, exprs: list[Column], probs: list[float], accuracy: int = ACCURACY) -> Column:
    """One scalar subquery: a struct with the field ``q<i>_<j>`` for the exact quantile
    ``probs[j]`` of ``exprs[i]`` over ``df`` (nulls ignored; null without any value).
    Project it once and refer to its fields."""
    probs = list(probs)
    margin, width = 2.0 / accuracy, len(probs)
    base = df.select(*[e.cast("double").alias(f"x{i}") for i, e in enumerate(exprs)])
    cells = [(i, j) for i in range(len(exprs)) for j in range(width)]
    ends = ", ".join(["0D", "1D"] + [f"{max(0.0, p - margin)!r}D" for p in probs] + [f"{min(1.0, p + margin)!r}D" for p in probs])

    # 1: for each column n and the brackets
    first = base.selectExpr("struct(" + ", ".join(
        f"count(x{i}) AS n{i}, percentile_approx(x{i}, array({ends}), {accuracy}) AS b{i}" for i in range(len(exprs))) + ") AS a")

    # 2: for each cell the rows below (u) and inside (w); then, on one row, its bracket and
    # where in it the order statistics stand
    low, high, aggs, places = {}, {}, ["first(a) AS a"], [[] for _ in exprs]
    for i, j in cells:
        few = f"a.n{i} < {2 * accuracy}"  # from here on the margins hold a few rows; less rows are all looked at
        low[i, j], high[i, j] = f"if({few}, a.b{i}[0], a.b{i}[{2 + j}])", f"if({few}, a.b{i}[1], a.b{i}[{2 + width + j}])"
        aggs += [f"count_if(x{i} < {low[i, j]}) AS u{i}_{j}"]
        pos = f"{probs[j]!r}D * (a.n{i} - 1)"
        places[i] += [f"{low[i, j]} AS l{j}", f"{high[i, j]} AS h{j}", f"floor({pos}) - u{i}_{j} + 1 AS r{j}",
                      f"least(floor({pos}) + 1, a.n{i} - 1) - u{i}_{j} + 1 AS m{j}", f"{pos} - floor({pos}) AS s{j}"]
    second = base.withColumn("a", first.scalar()).selectExpr(*aggs).selectExpr(
        "array(" + ", ".join(f"struct({', '.join(c)})" for c in places) + ") AS b")

    # 3: the brackets' values with their counts, cut into slices of equal width. Columns become
    # rows before the brackets are looked at, so the generated code stays small enough to be compiled
    values = base.withColumn("b", second.scalar()).selectExpr(
        "b", "explode(array(" + ", ".join(f"struct({i} AS i, x{i} AS v)" for i in range(len(exprs))) + ")) AS s").where("s.v IS NOT NULL")
    tags = ", ".join(
        f"CASE WHEN v BETWEEN p.l{j} AND p.h{j} THEN struct(i * {width} + {j} AS cell, v AS v, "
        f"CASE WHEN p.h{j} - p.l{j} BETWEEN 1e-300 AND 1e300 THEN cast((v - p.l{j}) / (p.h{j} - p.l{j}) * {SLICES} AS int) ELSE 0 END AS slice, "
        f"p.r{j} AS rank, p.m{j} AS next, p.s{j} AS share) END" for j in range(width))
    # most values lie in no bracket and leave before the second explode
    inside = " OR ".join(f"v BETWEEN p.l{j} AND p.h{j}" for j in range(width))
    per = (values.selectExpr("s.i AS i", "s.v AS v", "b[s.i] AS p").where(inside).selectExpr(f"explode(array({tags})) AS s").where("s IS NOT NULL").select("s.*")
           .groupBy("cell", "v", "slice", "rank", "next", "share").agg(F.count(F.lit(1)).alias("c")))
    # the slices that hold the wanted ranks, by a running count over the slices' totals
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("slice"))
    kept = (per.groupBy("cell", "slice", "rank", "next").agg(F.sum("c").alias("n")).withColumn("upto", upto)
            .where("upto >= rank AND upto - n < next").select("cell", "slice", (F.col("upto") - F.col("n")).alias("base")))
    run = Window.partitionBy("cell", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = per.join(kept, ["cell", "slice"]).withColumn("cum", F.col("base") + F.sum("c").over(run))
    picked = cum.groupBy("cell").agg(F.expr("min(CASE WHEN cum >= rank THEN struct(cum, v) END).v AS lo"),
                                     F.expr("min(CASE WHEN cum >= next THEN struct(cum, v) END).v AS hi"),
                                     F.first("share").alias("share"), F.min("rank").alias("rank"))
    # a rank below the bracket or beyond it would be a broken promise of the sketch
    picked = picked.selectExpr("cell", """CASE WHEN lo IS NULL OR hi IS NULL OR rank < 1 THEN raise_error('quantile beyond its bracket')
        WHEN lo = hi THEN lo ELSE lo + (hi - lo) * share END AS q""")
    return picked.agg(F.expr("struct(" + ", ".join(
        f"max(CASE WHEN cell = {k} THEN q END) AS q{i}_{j}" for k, (i, j) in enumerate(cells)) + ") AS q")).scalar()


def quantiles_for(df: DataFrame, exprs: list[Column], probs: list[float], accuracy: int = ACCURACY) -> list[list[Column]]:
    """``out[i][j]`` = exact quantile ``probs[j]`` of ``exprs[i]``: fields of one subquery.
    For more than a few of them, project ``quantile_struct`` once instead."""
    if not exprs:
        return []
    s = quantile_struct(df, exprs, probs, accuracy)
    return [[s[f"q{i}_{j}"] for j in range(len(probs))] for i in range(len(exprs))]


def quantile_of(df: DataFrame, x: Column, p: float) -> Column:
    return quantiles_for(df, [x], [p])[0][0]
