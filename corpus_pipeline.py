"""A training corpus from raw documents: five stages, each by one of the corpus operators.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go, sources are mixed to
target weights (a document taken twice is two rows), and the rest is cut into contiguous shards of near-equal bytes.
Each stage takes (spark, docs, sf_dir) and is stateless; its result is written as Parquet and read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, mixing, sharding, simhash, toxicity
from palimpsest.llm.common import read_table, shared_folder


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; learnt from labelled documents outside op10's held-out fold."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), learn=lambda k: ~toxicity.held_out(k))
    return toxicity.accepted(docs, model)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, that of the smallest id."""
    return simhash.kept(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size and shard, which replace columns of those names."""
    _, cuts = sharding.plan(docs)
    return docs.withColumns({"size": sharding.size_of(docs["text"]), "shard": sharding.shard_of(cuts)})


STAGES = [
    ("toxicity", toxic_removed),
    ("near_dedup", near_copies_removed),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the learnt scores nor the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
