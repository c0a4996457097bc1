"""Every operator on awkward tables: very long texts, empty tables, nulls everywhere, repeated rows, clashing columns."""

import time
from collections import Counter

import pytest
from corpora import documents, words
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, decontam, jaccard, licenses, mixing, phrases, pii, quality, runs, sharding, simhash, topk, toxicity

LONG = 60_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    base = words(LONG, 1)  # about half a megabyte
    shout = "you vile scum fool really nasty words "
    texts = [base, base + " end", base, " ".join(["same"] * LONG), "x" * 400_000, "é𝐀 " * 50_000, "4111 1111 1111 1111 a@b.de " * 8_000, "under the MIT License " * 8_000, "", None, "  \n\t"]
    texts += [words(50 + i % 9, i) + (shout if i % 4 == 0 else "") for i in range(60)]
    rows = [(i if i != 9 else None, t, None, None if i % 3 == 0 else "s", None, None, "z", None, None, None, None) for i, t in enumerate(texts)]
    documents(spark, rows + [rows[20], rows[20]]).withColumn("a.b", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 > 0), int(i % 4 == 3)) for i in range(11, 71)] + [(None, 1, 0), (12, None, None), (0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q", " ".join(base.split()[100:140])), (None, None), ("e", "")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    turns = [(1, t, "user", "t") for t in range(1200)] + [(2, 0, "user", base), (2, 1, None, None), (None, 1, "user", "x"), (3, None, "user", "x"), (2, 0, "user", base)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    vectors = [(i, [float(i % 7), 1.0]) for i in range(150)] + [(None, [1.0, 2.0]), (100, [1.0, 1.0]), (200, None), (300, []), (400, [float("nan"), 1.0]), (500, [1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


QUERIES = {
    "op2": simhash.query, "op3": quality.query, "op4": licenses.query, "op5": pii.query, "op6": sharding.query, "op7": decontam.query, "op9": mixing.query, "op10": toxicity.query, "op12": runs.query, "op13": jaccard.query,
}


@pytest.mark.parametrize("name", QUERIES)
def test_long_null_and_repeated_rows_have_results(spark, folder, name):
    began = time.time()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = QUERIES[name](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect()) and time.time() - began < 120
    by_id = {r.doc_id: r for r in got}
    if name == "op2":
        assert by_id[0].component_id == by_id[1].component_id == by_id[2].component_id == 0 and by_id[8].fingerprint == by_id[None].fingerprint == "0" * 16
    if name == "op4":
        assert by_id[7].n_base == 8_000 and by_id[7].last_word == 4 * 7_999 and by_id[7].labels == "mit"
    if name == "op5":
        assert by_id[6].n_email == 8_000 and by_id[6].n_card == 8_000 and by_id[8].spans == by_id[None].spans == ""
    if name == "op7":
        assert by_id[0].n_items == 1 and by_id[0].n_hit == 40 and not by_id[0].contaminated and by_id[3].n_words == LONG
    if name == "op12":
        assert by_id[3].n_runs == 1 and (by_id[3].start, by_id[3].period) == (0, 1) and by_id[8].n_runs == 0 and by_id[8].start is None
    if name == "op13":
        assert by_id[0].component_id == by_id[1].component_id == by_id[2].component_id == 0 and by_id[8].component_id == 8 and by_id[3].n_shingles == 1
    if name in ("op3", "op10"):
        assert all(0 <= r.score <= 1 for r in got)


def test_phrases_of_awkward_documents(spark, folder):
    got = phrases.query(spark, folder).collect()
    assert {r.lang for r in got} <= {"und", "z"} and any(r.phrase == "under the mit license" and r.a == 8_000 for r in got)


def test_conversations_and_vectors(spark, folder):
    began = time.time()
    calls = chat.query(spark, folder).collect()
    assert max(r.level for r in calls if r.conv_id == 1) == 1199 and sum(r.conv_id == 2 and r.call_id == "2:0" for r in calls) == 2 and time.time() - began < 150
    assert all(r.conv_id in (1, 2) for r in calls)
    found = topk.query(spark, folder).collect()
    assert {r.query_id for r in found} == {0, 100, 500} - {500} and all(r.vec_id != r.query_id for r in found)


EMPTY = {
    "documents": "doc_id long, text string, lang string, source string", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id string, text string",
    "conversations": "conv_id long, turn int, role string, text string", "embeddings": "vec_id long, embedding array<float>",
}


def test_empty_tables_give_empty_results(spark, tmp_path):
    for name, kind in EMPTY.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (*QUERIES.values(), chat.query, topk.query, phrases.query, corpus_pipeline.run):
        assert query(spark, str(tmp_path)).collect() == [], query


def test_the_pipeline_runs_over_awkward_documents(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert "a.b" in out.columns and out.count() > 10 and out.filter("shard is null").count() == 0
