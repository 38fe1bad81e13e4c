"""Incremental profile counts over a stream of aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_counts(rows: DataFrame, time_col: str, seq_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, pos, res, n): residue counts by column and time window; rows later than the watermark are left out."""
    letters = rows.withWatermark(time_col, late).select(time_col, F.posexplode(F.split(seq_col, "")).alias("pos", "res")).filter("res <> ''")
    return letters.groupBy(F.window(time_col, window), (F.col("pos") + 1).alias("pos"), "res").agg(F.count("*").alias("n"))
