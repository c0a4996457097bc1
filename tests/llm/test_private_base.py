"""The base spans alone are the operator's, found in one pass without rounds."""

from palimpsest.llm import parts, pii


def test_private_base_is_the_operators_base_and_runs_no_job(spark, tmp_path):
    texts = ["mail a.b@ex.am or 10.0.0.1, password=Xk29!fQz7", None, "", "call +49 (30) 1234567, card 4111 1111 1111 1111", "é 300.1.1.1 x@y.z x@y.z"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    group = "private-base"
    spark.sparkContext.setJobGroup(group, group)
    found = parts.private_base(spark, str(tmp_path))
    # Reading the table's schema is the one job there may be; the operator's rounds are dozens.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= 1
    whole = pii.query(spark, str(tmp_path)).select(found.columns)
    key = lambda r: r.doc_id
    assert sorted(found.collect(), key=key) == sorted(whole.collect(), key=key)
    assert {r.n_email for r in found.collect()} == {0, 1, 2}
