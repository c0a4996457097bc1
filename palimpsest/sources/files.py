"""Files as rows: bytes, format, decoded text, newline kind; one bad file is a row with an error, not a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import format_of
from ..functions.text import newline_kind

TEXTUAL = ("text", "markdown", "html")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length, content, format)`` of all files under a path; a format of null is unsupported."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content", format_of(F.col("path")).alias("format"))


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with text, had_bom, newline and error: strict UTF-8 for textual formats.

    A byte-order mark is taken off unless a variation selector follows it, which then opens a provenance frame.
    """
    raw = F.when(F.col("format").isin(*TEXTUAL), F.try_validate_utf8(F.col("content").cast("string")))
    rows = files.withColumn("_raw", raw)
    frame = "^\ufeff[\ufe00-\ufe0f\U000e0100-\U000e01ef]"
    bom = F.startswith(F.col("_raw"), F.lit("\ufeff")) & ~F.rlike(F.col("_raw"), F.lit(frame))
    bad = (
        F.when(F.col("format").isNull(), F.struct(F.lit("UnsupportedFormat").alias("kind"), F.col("path").alias("message")))
        .when(F.col("format").isin(*TEXTUAL) & F.col("_raw").isNull(), F.struct(F.lit("Encoding").alias("kind"), F.lit("not valid UTF-8").alias("message")))
    )
    text = F.when(bom, F.substring(F.col("_raw"), F.lit(2), F.length("_raw"))).otherwise(F.col("_raw"))
    return rows.withColumn("text", text).withColumn("had_bom", F.coalesce(bom, F.lit(False))).withColumn("newline", newline_kind(F.col("text"))).withColumn("error", bad).drop("_raw")
