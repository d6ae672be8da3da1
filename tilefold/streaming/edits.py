"""A stream of palette edits, kept as the last edit of each block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_edits(log: DataFrame) -> DataFrame:
    """The row of the greatest ``seq`` of each block; works on a batch and, in update mode, on a stream."""
    return log.groupBy("block").agg(F.max_by("row", "seq").alias("row"), F.max("seq").alias("seq"), F.count("*").alias("edits"))


def edits_by_minute(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Edits a block and minute; events later than the watermark are left out of a stream's windows."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), "block").agg(F.count("*").alias("edits")).select(F.col("w.start").alias("minute"), "block", "edits")
