"""Monitoring of the audit log: an extension that runs the audit's aggregates as Structured Streaming.

The same functions serve batch and streams. A stream's state is one row per open window; the watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def flag_rates(audit: DataFrame, width: str, lateness: str | None = None) -> DataFrame:
    """(start, total, flag_rate) per window of `at`; rows later than lateness are dropped from streams."""
    if audit.isStreaming:
        audit = audit.withWatermark("at", lateness or width)
    out = audit.groupBy(F.window("at", width)).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("decision") != "allow", F.lit(True))).alias("flagged"))
    return out.select(F.col("window.start").alias("start"), "total", F.round(F.col("flagged") / F.col("total"), 9).alias("flag_rate"))


def write_rates(audit: DataFrame, width: str, path: str, checkpoint: str, lateness: str | None = None) -> StreamingQuery:
    """Append closed windows to Parquet under path as the log grows."""
    return flag_rates(audit, width, lateness).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
