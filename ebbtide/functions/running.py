"""Running totals in a total order that no single task holds.

Rows are range-partitioned by (keys, order); each partition adds up its own rows, and the
partitions' totals, one row for each key and partition, give the offsets. The partitioned
rows are written before they are read twice: ranges are sampled, so a second evaluation
could cut elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_running(df: DataFrame, path: str, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """Write ``df`` (one row for each key and value of ``order``) under ``path`` in order of
    (keys, order), with ``part`` and for each column of ``sums`` its totals over the key's
    rows of smaller order, ``<column>_before``, and with the row's own value added,
    ``<column>_upto``. Returns the table as read back."""
    spark = df.sparkSession
    df.repartitionByRange(*keys, order).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    own = parts.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"_own_{c}") for c in sums])
    previous = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = own.select(*keys, "part", *[F.sum(f"_own_{c}").over(previous).alias(f"_base_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def before(c: str):
        zero = F.lit(0).cast(df.schema[c].dataType)
        return (F.coalesce(F.col(f"_base_{c}"), zero) + F.coalesce(F.sum(c).over(inside), zero)).alias(f"{c}_before")

    placed = parts.join(offsets, [*keys, "part"]).select(*df.columns, "part", *[before(c) for c in sums])
    placed = placed.select("*", *[(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_upto") for c in sums])
    placed.sortWithinPartitions(*keys, order).write.mode("overwrite").parquet(f"{path}/running")
    return spark.read.parquet(f"{path}/running")
