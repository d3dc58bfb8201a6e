"""Notes de-identified as they arrive: every row is on its own, so no state, watermark or late data is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimveil.operators.redaction import redact


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema("note_id string, member_id string, text string").parquet(folder)


def write_redacted(notes: DataFrame, salt: str, out: str, state: str) -> StreamingQuery:
    """Writes redacted notes as Parquet files; ``state`` is where the stream's progress is kept, in a shared folder."""
    clean = redact(notes, salt).select("note_id", "member_id", "clean")
    return clean.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
