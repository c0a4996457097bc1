"""Cleaning of files as they come, each version of a file once, across restarts.

The state of a path is the hash of its text and the version of the rules that cleaned it. A file that comes again unchanged
passes neither the rules nor the sink; one whose text or whose rules have changed does. The sink keeps a log of batches,
each written under its own number, so a batch that is run again after a failure replaces itself; readers take the last
entry of each path, and compaction rewrites the log as one entry a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import engine
from ..operators import rules as R

_STATE = "digest string, version string, modified timestamp"


def version_of(level: str | int, rules: Sequence[R.Rule] | None = None) -> str:
    """A name for what a level does: rules, their order, patterns and replacements by value; functions by their names."""
    told = [(k, r.id, r.pattern, r.replace if not callable(r.replace) else r.replace.__name__, getattr(r.scan, "__name__", None), r.needles, r.words) for k, r in engine.active(level, rules)]
    return hashlib.sha256(repr(told).encode()).hexdigest()[:16]


def changed(files: DataFrame, version: str) -> DataFrame:
    """``(path, text, modified, digest)`` of a stream of ``(path, text, modified)``: what has to be cleaned.

    Of several versions of a path in one batch only the last modified one counts (ties: the greatest text); one older than
    what was cleaned is left out; null paths and texts are. A path's state is a few dozen bytes and kept for good.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            for text, modified in zip(frame["text"], frame["modified"]):
                if last is None or (modified, text) > last:
                    last = modified, text
        modified, text = last
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        if state.exists:
            known, by, at = state.get
            if (known, by) == (digest, version) or pd.Timestamp(at) > modified:
                return
        state.update((digest, version, modified.to_pydatetime()))
        yield pd.DataFrame({"path": [key[0]], "text": [text], "modified": [modified], "digest": [digest]})

    named = files.filter("path is not null and text is not null and modified is not null").select("path", "text", "modified")
    return named.groupBy("path").applyInPandasWithState(step, "path string, text string, modified timestamp, digest string", _STATE, "update", GroupStateTimeout.NoTimeout)


def sink(folder: str, level: str | int, rules: Sequence[R.Rule] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: cleans a batch of ``changed`` and writes it to the log, in place of an earlier try."""
    version = version_of(level, rules)

    def write(batch: DataFrame, number: int) -> None:
        made = engine.cleaned(batch, level, rules=rules)
        rows = made.select("path", "modified", "digest", F.lit(version).alias("version"), "report.cleaned", "report.changed", "report.edits_applied", "report.flags", "report.error")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def start(files: DataFrame, folder: str, checkpoint: str, level: str | int = "standard", rules: Sequence[R.Rule] | None = None, **trigger):
    """A running query that keeps the table in ``folder``; ``trigger`` as for a stream writer (``availableNow=True``)."""
    writer = changed(files, version_of(level, rules)).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(sink(folder, level, rules)).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The last cleaned version of each path; ``batch`` says when it came."""
    log = spark.read.parquet(folder)
    rest = [c for c in log.columns if c != "path"]
    return log.groupBy("path").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("path", *[F.col(f"x.{c}").alias(c) for c in rest])


def compacted(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """The log as a new one in ``target`` with one entry a path, under the numbers that the entries had."""
    current(spark, folder).write.partitionBy("batch").mode("overwrite").parquet(target)
    return spark.read.parquet(target)
