"""Contiguous shards of near-equal bytes, cut from global prefix sums of sizes.

Rows are laid out in one global order, by a hash of the text and then by id, so that equal texts are neighbours. Byte
totals of the sorted partitions, one number each, are added up into offsets; every row then knows how many bytes stand
before it, and the cuts are the rows nearest to equal targets. A cut that would part a group of equal texts moves to
the nearer end of the group if that shifts it by no more than ``SLACK`` of a shard. Only ids, sizes and hashes are
sorted; texts stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, read_table

SHARDS = 24
#: Bytes of a row besides its text.
OVERHEAD = 8
#: Share of a shard's bytes by which a cut may move to keep a group of equal texts whole.
SLACK = 0.01


@dataclass(frozen=True)
class Cuts:
    """``starts``: for each shard but the first, its first row's bytes before it; ``keys``: that row's (hash, id)."""

    total: int
    starts: list[int]
    keys: list[tuple[int, object]]


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        F.col(f"`{id_col}`").alias("id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("crc"),
    )


def plan(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> tuple[DataFrame, Cuts]:
    """The key rows with their global prefix sums, and the cuts. An empty table has no cuts."""
    laid, totals = prefix_sums(_keys(docs, id_col, text_col), ["h", "id", "size"], ["size"])
    total = totals["size"]
    if not totals["rows"]:
        return laid, Cuts(0, [], [])
    end = F.col("before_size") + F.col("size")
    # Rows that hold a target k * total / shards for some k: at most shards - 1 of them. Whole numbers only: a quotient rounded
    # to six places takes a row that ends just short of a target for the one that holds it.
    passed = lambda at: F.call_function("div", at.cast("decimal(28,0)") * F.lit(shards), F.lit(total).cast("decimal(28,0)"))
    over = laid.filter(passed(end) > passed(F.col("before_size")))
    held = over.select("h", "before_size", "size").distinct().orderBy("before_size").collect()
    hashes = sorted({r["h"] for r in held})
    groups = {
        r["h"]: (r["a"], r["b"])
        for r in laid.filter(F.col("h").isin(hashes)).groupBy("h").agg(F.min("before_size").alias("a"), F.max(end).alias("b")).collect()
    }
    starts = []
    for k in range(1, shards):
        target = k * total / shards
        row = next((r for r in held if r["before_size"] <= target < r["before_size"] + r["size"]), None)
        if row is None:
            starts.append(total)
            continue
        ends = [row["before_size"], row["before_size"] + row["size"]]
        whole = min(groups[row["h"]], key=lambda x: abs(x - target))
        near = min(ends, key=lambda x: abs(x - target))
        starts.append(whole if abs(whole - target) <= max(slack * total / shards, abs(near - target)) else near)
    starts = [max(starts[: i + 1]) for i in range(len(starts))]
    first = {r["before_size"]: (r["h"], r["id"]) for r in laid.filter(F.col("before_size").isin([s for s in starts if s < total])).collect()}
    last = (2**63 - 1, None)
    return laid, Cuts(total, starts, [first.get(s, last) for s in starts])


def assigned(laid: DataFrame, cuts: Cuts) -> DataFrame:
    """Key rows with shard and slot (the row's place within its shard, gapless from 0)."""
    starts = F.array(*[F.lit(s).cast("long") for s in cuts.starts]) if cuts.starts else F.array().cast("array<long>")
    out = laid.withColumn("shard", F.size(F.filter(starts, lambda s: s <= F.col("before_size"))).cast("int"))
    firsts = {r["shard"]: r["n"] for r in out.groupBy("shard").agg(F.min("before_rows").alias("n")).collect()}
    at = F.array(*[F.lit(firsts.get(k, 0)).cast("long") for k in range(len(cuts.starts) + 1)])
    return out.withColumn("slot", F.col("before_rows") - F.element_at(at, F.col("shard") + 1))


def shard_of(cuts: Cuts, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The shard of a document from its own columns, by comparison with the cuts' keys: a narrow pass over texts.

    Rows equal in id and text fall on one side of a cut together; otherwise the result is that of ``assigned``.
    """
    h, key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.col(f"`{id_col}`")
    shard = F.lit(0)
    for hash_, id_ in cuts.keys:
        same = F.lit(True) if id_ is None else F.coalesce(key >= F.lit(id_), F.lit(False))
        after = (h > F.lit(hash_)) | ((h == F.lit(hash_)) & same)
        shard = shard + (F.lit(0) if hash_ == 2**63 - 1 and id_ is None else after.cast("int"))
    return shard.cast("int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: shard and slot of every document under the law of near-equal bytes."""
    laid, cuts = plan(read_table(spark, sf_dir, "documents"))
    return assigned(laid, cuts).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
