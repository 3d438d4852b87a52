"""Places of rows in an order over a whole table, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows counted from 0 in ``order``.

    Counts come from sorted ranges and the number of rows in the ranges before, so
    that no task holds all rows. Rows equal in ``order`` may get either's count.
    """
    ranges = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranges.groupBy("__part").agg(F.count("*").alias("n"))  # a row to a range
    before = counts.select("__part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranges.join(before, "__part").withColumn(name, F.col("__before") + within - 1).drop("__part", "__before")
