"""Rows dealt out to as many tasks as their work needs, where a file has few bytes a row and much is made of each."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows that are worth a task of their own where cores have none.
LEAST = 500


def dealt(df: DataFrame, key: str, most: int) -> DataFrame:
    """df in tasks of about ``most`` rows each, dealt by a key if its files would make fewer; a few rows are dealt to all cores.

    Rows are counted, since bytes don't tell them: files are compressed. What is shuffled should be the short rows that texts are made of, not the texts.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    wanted = max(math.ceil(n / most), min(cores, math.ceil(n / LEAST)), 1)
    return df if wanted == 1 or df.rdd.getNumPartitions() >= 4 * wanted else df.repartition(wanted, key)
