"""Spans as rows: which of them can touch each other at all, told without a list of a text's spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A text's spans without their values.
PLACES = "array<struct<start:int,end:int,type:string>>"


def clusters(rows: DataFrame, key: str, start: Column, end: Column, name: str = "cluster") -> DataFrame:
    """rows with the number of their cluster in the key's text: a new one begins where no earlier span reaches.

    The largest end so far and the number are running values over rows in order of start, so no row waits for a list, and
    one sort by key and start is all it takes.
    """
    placed = rows.withColumns({"_low": start, "_high": end})
    order = Window.partitionBy(key).orderBy("_low", "_high")
    far = F.max("_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = placed.withColumn("_fresh", F.when(F.col("_low") < far, 0).otherwise(1))
    return fresh.withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_low", "_high", "_fresh")
