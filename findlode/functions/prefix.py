"""Running totals and gapless numbers over a whole table, without putting it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findlode.functions.session import checkpointed


def running_total(rows: DataFrame, keys: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the total of ``value`` over this row and all before it in the order of the keys.

    Rows go to ranges of the order, which are kept so that a range's number stands; a window over the ranges' sums, a row
    per range, says what lies before each, and windows within the ranges do the rest. Keys must tell all rows apart.
    """
    ranged = rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__value", value)
    ranged = checkpointed(ranged)
    sums = ranged.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__before"))
    within = F.sum("__value").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__within", within).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__value", "__within", "__before")


def numbered(rows: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """``rows`` with numbers from 0 in the order of the keys."""
    return running_total(rows, keys, F.lit(1), name).withColumn(name, (F.col(name) - 1).cast("bigint"))
