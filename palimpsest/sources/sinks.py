"""Sinks: cleaned documents that changed, beside their sources' names, and reports partitioned by rule family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import cleaned_path


def write_changed(cleaned: DataFrame, path: str, path_col: str = "path", extension: str = "txt") -> None:
    """Only documents that changed and passed the self-check, under the name of the cleaned file.

    Spark's commit protocol makes the files appear whole or not at all; an existing folder is refused.
    """
    rows = cleaned.filter(F.col("report.changed") & F.col("report.error").isNull())
    rows.select(cleaned_path(F.col(path_col), extension).alias("path"), F.col("report.cleaned").alias("text")).write.parquet(path)


def write_findings(found: DataFrame, path: str) -> None:
    """Findings partitioned by rule family, so that a reader of one family prunes the others."""
    found.withColumn("family", F.substring_index("rule_id", ".", 1)).write.partitionBy("family").parquet(path)
