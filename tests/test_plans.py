"""Physical plans: what is read, what is shuffled, what stays in the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import diff, engine
from palimpsest.plans import queries
from palimpsest.sources.sinks import write_changed, write_findings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"text “{i}” … wow!!\nsecond line", "en", f"s{i % 3}", 30) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["rule_typo_quotes_straighten", "rule_style_punctuation_repeated", "newlines"])
def test_native_queries_stay_in_the_jvm_without_a_shuffle(spark, folder, name):
    text = plan(queries.queries()[name](spark, folder))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert "WholeStageCodegen" in text or "codegen id" in text
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"doc_id:bigint,text:string"}


@pytest.mark.parametrize("name", ["clean_standard", "findings", "lexical_pack", "convert_documents", "stylometry"])
def test_the_engine_is_one_narrow_arrow_pass(spark, folder, name):
    text = plan(queries.queries()[name](spark, folder))
    assert "Exchange" not in text and len(re.findall(r"\(\d+\) ArrowEvalPython", text)) == 1
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"doc_id:bigint,text:string"}


def test_the_report_shuffles_counts_only(spark, folder):
    text = plan(queries.queries()["report_by_rule"](spark, folder))
    assert "partial_sum" in text and len(re.findall(r"\(\d+\) ArrowEvalPython", text)) == 1
    assert all("text" not in x for x in re.findall(r"Exchange\nInput \[\d+\]: \[([^\]]*)\]", text))


def test_sinks_and_diff(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("path", F.concat(F.lit("in/"), "doc_id", F.lit(".md")))
    made = engine.cleaned(docs.unionByName(docs.limit(1).withColumn("text", F.lit("plain")).withColumn("path", F.lit("in/plain.md"))))
    write_changed(made, f"{tmp_path}/out", extension="md")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == 60 and {r.path for r in out} == {f"in/{i}.cleaned.md" for i in range(60)} and all("“" not in r.text for r in out)
    write_findings(engine.findings(docs, "aggressive"), f"{tmp_path}/found")
    back = spark.read.parquet(f"{tmp_path}/found").filter("family = 'style'")
    assert back.count() == 60 and "PartitionFilters: [isnotnull(family" in plan(back)
    assert diff.line_diff("a\nb\nc\nd", "a\nB\nc\nd\ne") == ["-b", "+B", "+e"] and diff.line_diff("x", "x") == []
    lines = diff.diffs(made.select("path", "text", F.col("report.cleaned").alias("new")), "path", "text", "new")
    assert lines.count() == 120
