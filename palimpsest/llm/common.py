"""Helpers shared by the corpus operators: tables, durable cut points, words, global prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256

#: Byte map behind ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` as separators after A-Z became a-z.
ALNUM_MAP = bytes(
    ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
#: Byte map that lower-cases A-Z only; ``bytes.split()`` then cuts at space and 0x09-0x0D.
LOWER_MAP = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Java and RE2 forms of the two word classes of the corpus operators.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus through Spark's own reader, so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names, which all executors share.

    Where none is named, a local master gets a temporary folder of its own; on a cluster that would be each machine's
    own disk, so there an error is raised.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpus-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df`` checkpointed to the shared folder, so that lost executors cost no recomputation; partitions and
    their order stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder. Unlike a checkpoint it carries nothing of the plan that made it
    (constraints, statistics), so rounds that feed on each other keep plans of one size; partitions may change."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, dots and back quotes included."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df`` as they are."""
    return [F.col(quoted(c)) for c in df.columns]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many more underscores in front as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with over this share of all rows is hot; so there are fewer hot keys than this number's inverse.
HOT_SHARE = 1 / 1000


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, a row for each key with ``n``, how many of the ``total`` rows have it.

    Rows of hot keys stay where they are and meet a broadcast of at most a thousand rows; all others are shuffled, no key
    with over a thousandth of the rows. ``rows`` and ``table`` are read twice, so they should be durable. Null keys
    meet nothing; ``n`` is not returned.
    """
    is_hot = F.col("n") > max(1.0, total * HOT_SHARE)
    hot = F.broadcast(table.filter(is_hot).drop("n"))
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(table.filter(~is_hot).drop("n"), keys)
    return rows.join(hot, keys).unionByName(cold)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of the letters-and-digits class, lower-cased; null has none."""
    return (text or b"").translate(ALNUM_MAP).split()


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, lower-cased; null has none."""
    return (text or b"").translate(LOWER_MAP).split()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[list[list]]:
    """Columns of Python values, a few hundred rows at a time, which bounds a worker's memory under long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(i).to_pylist() for i in range(part.num_columns)]


def binary_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with the text as UTF-8 bytes, which Arrow hands over without decoding."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


#: Rows of one partition of ``prefix_sums``.
ROWS_A_PART = 2_000_000


def prefix_sums(
    rows: DataFrame, order: list[str], values: list[str], partitions: int | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """Rows in global order with, for each column of ``values``, the sum over all rows before (``before_<value>``).

    Rows are written and counted, so that what made them (texts read and hashed) runs once; then range-partitioned by
    ``order`` and sorted within partitions of at most some ROWS_A_PART rows, cut durably (a later pass must see the very
    same partitions), each partition's totals are added up on the driver (a row per partition), and one more pass adds
    the partition's offset to the running sums. No window over the whole table, no single task. ``before_rows`` counts
    rows. Null values count as 0. Returns the frame and the totals.
    """
    spark = rows.sparkSession
    rows = written(rows)
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_PART))
    laid = durable(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    sums = [F.sum(F.coalesce(F.col(v), F.lit(0)).cast("long")).alias(v) for v in values]
    # The partition number is taken before the aggregation's exchange, from the partitions that were written.
    totals = (
        laid.select(F.spark_partition_id().alias("part"), *values)
        .groupBy("part")
        .agg(F.count(F.lit(1)).alias("rows"), *sums)
        .collect()
    )
    names = ["rows", *values]
    offsets: dict[int, list[int]] = {}
    run = [0] * len(names)
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets[row["part"]] = list(run)
        run = [a + (row[n] or 0) for a, n in zip(run, names)]
    shared = spark.sparkContext.broadcast(offsets)
    value_at = [laid.columns.index(v) for v in values]
    schema = T.StructType(
        laid.schema.fields + [T.StructField(f"before_{n}", T.LongType(), False) for n in names]
    )
    fields = [f.name for f in schema.fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        state = list(shared.value.get(TaskContext.get().partitionId(), [0] * len(names)))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            steps = [np.ones(n, np.int64)]
            steps += [
                np.asarray(batch.column(i).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                for i in value_at
            ]
            out = []
            for k, step in enumerate(steps):
                after = np.cumsum(step) + state[k]
                out.append(pa.array(after - step, pa.int64()))
                state[k] = int(after[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=fields)

    return laid.mapInArrow(add, schema), dict(zip(names, run))
