"""The engine in SQL text gives what the DataFrame API gives, row by row, packs of the user's own included."""

import pytest

from palimpsest.operators import engine, lateral
from palimpsest.operators import rules as R

TEXTS = ["“Quoted” — and​ more… utm_source=chatgpt.com", "plain", "", None, "É 𝐀 ‘x’ wort WORT", "As an AI language model, I delve­ into it 😀"]


@pytest.mark.parametrize("level", ["light", "standard", "aggressive"])
@pytest.mark.parametrize("own", [False, True])
def test_lateral_joins_agree_with_the_dataframe_api(spark, level, own):
    packs = [R.Rule("own.word", R.LIGHT, pattern="wort", replace="word", needles=("wort",), ignore_case=True)] if own else []
    rules = [*R.builtin(), *packs] if own else None
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.createOrReplaceTempView("lateral_docs")
    names = lateral.register(spark, packs, prefix="t_")
    assert names == ["t_findings", "t_cleaned"]
    got = spark.sql(f"SELECT d.doc_id, f.* FROM lateral_docs d, LATERAL t_findings(d.text, '{level}') f")
    want = engine.findings(docs, level, rules=rules)
    assert got.schema == want.schema or [f.name for f in got.schema] == [f.name for f in want.schema]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    made = spark.sql(f"SELECT d.doc_id, c.* FROM lateral_docs d, LATERAL t_cleaned(d.text, '{level}') c").collect()
    whole = {r.doc_id: r.report for r in engine.cleaned(docs, level, rules=rules).collect()}
    assert len(made) == len(TEXTS)
    for r in made:
        want = whole[r.doc_id]
        assert (r.cleaned, r.changed, r.applied, r.flagged) == ((want.cleaned, want.changed, want.applied, want.flagged) if want else (None,) * 4)
    assert not own or "word" in next(r.cleaned for r in made if r.doc_id == 4)


def test_levels_may_differ_by_row_and_sql_goes_on_from_findings(spark):
    lateral.register(spark)
    spark.createDataFrame([(k, t, lv) for k, t in enumerate(TEXTS) for lv in ("light", None, "aggressive")], "id long, text string, level string").createOrReplaceTempView("levels")
    got = spark.sql("SELECT level, count(*) AS n FROM levels, LATERAL findings(text, level) GROUP BY level").collect()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    assert {r.level: r.n for r in got} == {lv: engine.findings(docs, lv or "standard").count() for lv in ("light", None, "aggressive")}


def test_findings_of_a_text_are_no_arrow_batch_of_their_own(spark):
    lateral.register(spark, prefix="p_")
    plan = spark.sql("SELECT f.* FROM VALUES ('a') AS d(text), LATERAL p_findings(d.text, 'light') f")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "Arrow" not in plan
