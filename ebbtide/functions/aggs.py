"""Aggregate builders with engine-independent results.

Money and score sums run as decimals (exact, independent of partition order)
and are turned into doubles only at the end; averages are exact sum / count. What
a decimal of ten places cannot hold of a value is summed beside it as a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Values from here on are summed as doubles (a decimal of ten places holds 18 whole digits).
BIG = 1e17


def two_parts(x: Column) -> tuple[Column, Column]:
    """A value as a decimal of ten places (null from ``BIG`` on) and a double with the rest."""
    d = x.cast("double")
    fits = F.abs(d) < F.lit(BIG)
    dec = F.when(fits, d).cast("decimal(28,10)")
    return dec, F.when(fits, d - dec.cast("double")).otherwise(d)


def dsum(x: Column) -> Column:
    """Sum of a column, returned as double; null without any value.

    Two parts: the first ten decimals of all values below ``BIG`` as an exact decimal
    sum, and a double sum of the rest, that is of the digits beyond ten decimals and of
    whole values from ``BIG`` on. For values of at most ten decimals the second part is
    zero and the result does not depend on the order of the rows; tiny and huge values
    keep a double's precision and overflow nothing."""
    dec, rest = two_parts(x)
    return F.coalesce(F.sum(dec).cast("double"), F.when(F.count(rest) > 0, F.lit(0.0))) + F.sum(rest)


def davg(x: Column) -> Column:
    """Exact average (decimal sum / non-null count) as double; null if no values."""
    return F.try_divide(dsum(x), F.count(x).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1) as double (the reference's zero-guard)."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def quantile(x: Column, p, accuracy: int | None = None) -> Column:
    """Linear-interpolated quantile (same definition as pandas / quantile_cont).

    Exact ``percentile`` keeps one value->count map per group; the columns we
    use it on are rounded scores with a bounded number of distinct values
    (risk: at most 10,001). For unbounded-cardinality columns at very large
    scale pass ``accuracy`` to switch to ``percentile_approx``.
    """
    if accuracy:
        return F.percentile_approx(x, p, accuracy)
    return F.percentile(x, p)
