"""Joins whose small side is sent to all workers only if its rows, counted, are known to be few bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast, and bytes that a row takes beside its strings.
SMALL, ROW = 32 << 20, 64


def measured_bytes(df: DataFrame) -> int:
    """About what the rows take in memory, from their number and their strings' lengths."""
    strings = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    return int(df.agg(F.coalesce(F.sum(sum(strings, F.lit(ROW)).cast("long")), F.lit(0))).first()[0])


def checked(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast in a join if it is small, else to be shuffled like any other side; most: another limit than SMALL."""
    return F.broadcast(df) if measured_bytes(df) <= (SMALL if most is None else most) else df.hint("shuffle_merge")
