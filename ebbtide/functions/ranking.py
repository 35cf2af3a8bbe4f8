"""Global ranks and running totals without a task that sees all rows.

Rows are range-partitioned by a total order; each partition adds up its own, and the
totals of the partitions before it are added. The partitions' totals are one entry a
partition in a scalar subquery over the same exchange, which Spark runs once and reuses;
as it is the same only with the same columns, both sides read all of them, so that none
is pruned on one side. Ranges are sampled, so should the exchange ever run twice and cut elsewhere, some row lies
outside the bounds that the subquery found for its partition, and the query fails instead
of giving wrong numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROW = (1 << 33) - 1  # of a monotonically increasing id: the row within its partition


def _dealt(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> tuple[DataFrame, Column]:
    """The rows in ranges with ``_part`` and ``_key``, and the subquery of the partitions'
    sizes (n), bounds (a, b) and sums (s0, s1, ...)."""
    dealt = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part"), F.struct(
        *[x.alias(f"k{i}") for i, x in enumerate(order)]).alias("_key"))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("a"), F.max("_key").alias("b"),
                                       F.bit_xor(F.xxhash64(*df.columns)).alias("h"),
                                       *[F.sum(x).alias(f"s{i}") for i, x in enumerate(sums.values())])
    return dealt, sizes.agg(F.collect_list(F.struct("*")).alias("s")).scalar()


def _checked(value: Column, columns: list[str]) -> Column:
    here = F.exists("_s", lambda x: (x["_part"] == F.col("_part")) & (x["a"] <= F.col("_key")) & (F.col("_key") <= x["b"]))
    read = F.xxhash64(*columns).bitwiseAND(F.lit(1)) >= 0  # always true
    return F.when(here & read, value).otherwise(F.raise_error(F.lit("range exchange was not reused")))


def _total(field: str, kind, parts: Column) -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(parts, zero, lambda a, x: (a + F.coalesce(x[field], zero)).cast(kind))


def _parts_before() -> Column:
    return F.filter("_s", lambda x: x["_part"] < F.col("_part"))


def with_rank(df: DataFrame, order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 1-based rank of each row in ascending ``order`` (which must be total), and the
    number of rows under the name ``total``. Rows are numbered as they leave the sort."""
    dealt, sizes = _dealt(df, order, {})
    out = dealt.sortWithinPartitions("_key").withColumn("_id", F.monotonically_increasing_id()).withColumn("_s", sizes)
    place = _total("n", "long", _parts_before()) + F.col("_id").bitwiseAND(F.lit(ROW)) + 1
    more = [_total("n", "long", F.col("_s")).alias(total)] if total else []
    return out.select(*df.columns, _checked(place, df.columns).cast("int").alias(rank), *more)


def with_totals_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add for each name the total of its column over all rows that stand before in
    ascending ``order`` (which must be total)."""
    dealt, sizes = _dealt(df, order, sums)
    previous = Window.partitionBy("_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.sum(x).over(previous).alias(f"_s{i}") for i, x in enumerate(sums.values())]).withColumn("_s", sizes)
    kinds = [out.schema[f"_s{i}"].dataType for i in range(len(sums))]
    return out.select(*df.columns, *[
        _checked(_total(f"s{i}", kinds[i], _parts_before()) + F.coalesce(F.col(f"_s{i}"), F.lit(0).cast(kinds[i])), df.columns).alias(name)
        for i, name in enumerate(sums)])
