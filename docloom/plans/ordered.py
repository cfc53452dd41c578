"""Row numbers and lags over ordered groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned by
(keys, order), so that a large group spans several partitions; each partition is numbered
on its own and a small table with one row per (group, partition) links them up.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.scratch import materialize


def place(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Sorted rows with their partition ``_part`` and running position ``_row``.

    The result is written out: both numbers depend on range sampling, so they must not be
    computed a second time after a task is lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    placed = (
        df.repartitionByRange(parts, *by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    return materialize(placed, "placed")


def global_row_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per group."""
    placed = place(df, keys, order)
    chunks = placed.groupBy(*keys, "_part").agg(
        F.count("*").alias("_size"), F.min("_row").alias("_low")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    number = F.col("_row") - F.col("_low") + F.col("_before") + 1
    return (
        placed.join(chunks, [*keys, "_part"])
        .withColumn(name, number)
        .drop("_part", "_row", "_size", "_low", "_before")
    )


def global_lag(
    df: DataFrame, keys: list[str], order: list[str], value: Column, name: str
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)``; ``value`` is never NULL."""
    placed = place(df.withColumn("_value", value), keys, order)
    inside = F.lag("_value").over(Window.partitionBy(*keys, "_part").orderBy("_row"))
    tails = placed.groupBy(*keys, "_part").agg(F.max_by("_value", "_row").alias("_tail"))
    tails = tails.withColumn(
        "_carry", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_part"))
    )
    return (
        placed.withColumn("_inside", inside)
        .join(tails, [*keys, "_part"])
        .withColumn(name, F.coalesce("_inside", "_carry"))
        .drop("_part", "_row", "_value", "_inside", "_tail", "_carry")
    )
