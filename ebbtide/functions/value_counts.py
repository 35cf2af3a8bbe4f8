"""Value-count store: the distribution of a written table's numeric columns.

For every column and distinct value: how often it occurs (``n``) and how many smaller
values there are (``below``), ``upto = below + n``. It is written once, beside the
table, in order of (column, value). A quantile is then a lookup inside the plan: the
row whose ranks [below, upto) hold the wanted one, found by filters on the name and the
ranks. No job runs while a query is built and no sketch is needed; the answer is exact.
Running counts come from ``functions.running``, so no task holds a whole column, and a
value that makes up a third of a column is one row a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.functions.columns import find_col
from ebbtide.functions.quantiles import quantile_of, quantile_struct
from ebbtide.functions.running import write_running
from ebbtide.functions.scalars import safe_numeric

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class ColumnStats:
    """Numbers of values, of nulls, of values below and equal to zero, and the range."""
    n: int
    nulls: int
    negative: int
    zeros: int
    low: float | None
    high: float | None


class ValueCounts:
    def __init__(self, table: DataFrame, stats: dict[str, ColumnStats]):
        self.table, self.stats = table, stats

    def __contains__(self, column: str) -> bool:
        return column in self.stats

    def maximum(self, column: str, fill_zero: bool = False) -> float | None:
        s = self.stats[column]
        if fill_zero and s.nulls:
            return 0.0 if s.high is None else max(0.0, s.high)
        return s.high

    def at_rank(self, column: str, low: int, high: int) -> DataFrame:
        """One row (a, b): the values at two neighbouring ranks of the non-null values."""
        t = F.col
        rows = self.table.where((t("name") == column) & (t("below") <= F.lit(high)) & (t("upto") > F.lit(low)))
        return rows.agg(F.min("value").alias("a"), F.max("value").alias("b"))

    def quantile(self, column: str, p: float, fill_zero: bool = False) -> Column:
        """The exact quantile as a scalar subquery; with ``fill_zero`` nulls count as 0."""
        s = self.stats[column]
        extra = s.nulls if fill_zero else 0
        n = s.n + extra
        if not n:
            return F.lit(None).cast("double")
        pos = p * (n - 1)
        low = math.floor(pos)
        high = min(low + 1, n - 1)

        def rank(k: int) -> int | None:
            """Rank among the non-null values; None where the filled value stands."""
            if not extra or k < s.negative:
                return k
            return None if k < s.negative + s.zeros + extra else k - extra

        a, b = rank(low), rank(high)
        if a is None and b is None:
            return F.lit(0.0)
        row = self.at_rank(column, b if a is None else a, a if b is None else b)
        x = F.lit(0.0) if a is None else F.col("a")
        y = F.lit(0.0) if b is None else F.col("b")
        return row.select(F.when(x == y, x).otherwise(x + (y - x) * F.lit(pos - low)).alias("q")).scalar()


    def quantiles(self, columns: list[str], probs: list[float]) -> Column:
        """A struct with the field ``q<i>_<j>`` for quantile ``probs[j]`` of ``columns[i]``
        (nulls ignored): one subquery that reads the store once."""
        aggs, fields, keep = [], [], F.lit(False)
        for i, c in enumerate(columns):
            n = self.stats[c].n
            for j, p in enumerate(probs):
                pos = p * (n - 1)
                low = math.floor(pos)
                for end, k in (("a", low), ("b", min(low + 1, n - 1))):
                    hit = (F.col("name") == c) & (F.col("below") <= k) & (F.col("upto") > k)
                    keep = keep | hit
                    aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"{end}{i}_{j}"))
                x, y = F.col(f"a{i}_{j}"), F.col(f"b{i}_{j}")
                fields.append(F.when(x == y, x).otherwise(x + (y - x) * F.lit(pos - low)).alias(f"q{i}_{j}"))
        return self.table.where(keep).agg(*aggs).select(F.struct(*fields)).scalar()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def write_value_counts(df: DataFrame, path: str, columns: list[str] | None = None) -> ValueCounts:
    """Write the store of ``df``'s numeric columns under ``path`` and open it."""
    spark = df.sparkSession
    columns = numeric_columns(df) if columns is None else columns
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), safe_numeric(F.col(c)).alias("value")) for c in columns])).alias("c")).select("c.*")
    per = cells.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    table = write_running(per.where(F.col("value").isNotNull()), path, ["name"], "value", ["n"])
    table = table.select("name", "value", "n", F.col("n_before").alias("below"), F.col("n_upto").alias("upto"))
    v, n = F.col("value"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    known = table.groupBy("name").agg(total(v.isNotNull()).alias("n"), total(v < 0).alias("negative"), total(v == 0).alias("zeros"),
                                      F.min("value").alias("low"), F.max("value").alias("high")).collect()  # one row a column
    rows = df.count()
    stats = {c: ColumnStats(0, rows, 0, 0, None, None) for c in columns}
    stats |= {r["name"]: ColumnStats(r["n"], rows - r["n"], r["negative"], r["zeros"], r["low"], r["high"]) for r in known}
    return ValueCounts(table, stats)


def attach(df: DataFrame, store: ValueCounts) -> DataFrame:
    """Let the quantiles of this very DataFrame (not of what is derived from it) come
    from its store."""
    df._value_counts = store
    return df


def store_of(df: DataFrame) -> ValueCounts | None:
    return getattr(df, "_value_counts", None)


def quantiles_of(df: DataFrame, columns: list[str], probs: list[float]) -> Column:
    """The struct of ``quantile_struct`` for whole columns, from the store of ``df`` if it
    has them all."""
    store = store_of(df)
    if store is not None and all(c in store for c in columns):
        return store.quantiles(columns, probs)
    return quantile_struct(df, [F.col(c) for c in columns], probs)


def column_quantile(df: DataFrame, aliases: list[str], p: float, fill_zero: bool = False) -> Column | None:
    """The quantile of the column that the aliases name (None if there is none): from the
    store of ``df`` if it has one, else from the passes of ``functions.quantiles``."""
    c = find_col(df, aliases)
    if c is None:
        return None
    store = store_of(df)
    if store is not None and c in store:
        return store.quantile(c, p, fill_zero)
    return quantile_of(df, safe_numeric(F.col(c), 0.0 if fill_zero else None), p)
