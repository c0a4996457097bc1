"""Cleaning as a stream: each document is independent, so the batch column runs unchanged on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import cleaned, findings_column


def cleaned_stream(docs: DataFrame, level: str = "standard", text_col: str = "text") -> DataFrame:
    """A streaming frame with the cleaned text and its report."""
    return cleaned(docs, level, text_col)


def rule_counts(docs: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes", level: str = "standard", text_col: str = "text") -> DataFrame:
    """Findings by rule in tumbling windows of event time; rows later than the watermark are dropped."""
    found = docs.withWatermark(time_col, late).select(time_col, F.explode(findings_column(level)(F.col(text_col))).alias("f"))
    return found.groupBy(F.window(time_col, window).alias("window"), F.col("f.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


def write_cleaned(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet sink with exactly-once commits; what is available now is processed, then the query ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
