"""Files that come again, changed or not, over restarts of a stream."""

import datetime as dt

from palimpsest.operators import engine
from palimpsest.operators import rules as R
from palimpsest.streaming import incremental

KIND = "path string, text string, modified timestamp"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def run(spark, folder, rows, level="standard", rules=None):
    """Puts rows into the stream's source and runs it until they are done, as after a restart."""
    if rows:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(KIND).parquet(f"{folder}/in")
    query = incremental.start(stream, f"{folder}/table", f"{folder}/checkpoint", level, rules, availableNow=True)
    query.awaitTermination()
    return {r.path: r for r in incremental.current(spark, f"{folder}/table").collect()}


def test_a_replayed_and_a_changed_file_give_one_row_each_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    first = run(spark, folder, [("a", "“x”", at(1)), ("b", "y…", at(1)), ("b", "y… z", at(2)), ("c", None, at(1)), (None, "z", at(1))])
    assert {p: r.cleaned for p, r in first.items()} == {"a": '"x"', "b": "y... z"}
    # a as it was, b changed, d new, an old version of b.
    then = run(spark, folder, [("a", "“x”", at(5)), ("b", "“new”", at(6)), ("d", "plain", at(5)), ("b", "older", at(0))])
    assert {p: r.cleaned for p, r in then.items()} == {"a": '"x"', "b": '"new"', "d": "plain"}
    assert then["a"].batch == first["a"].batch and then["b"].batch > first["b"].batch and then["a"].modified == at(1)
    log = spark.read.parquet(f"{folder}/table")
    assert sorted((r.path, r.cleaned) for r in log.collect()) == [("a", '"x"'), ("b", '"new"'), ("b", "y... z"), ("d", "plain")]
    # Nothing new: no rows. An older version alone: left out.
    assert run(spark, folder, []) == then
    assert run(spark, folder, [("b", "older still", at(3))]) == then
    small = incremental.compacted(spark, f"{folder}/table", f"{folder}/small")
    assert small.count() == 3 and {r.path: r.cleaned for r in incremental.current(spark, f"{folder}/small").collect()} == {p: r.cleaned for p, r in then.items()}


def test_other_rules_clean_again_what_comes_again(spark, tmp_path):
    folder = str(tmp_path)
    own = [*R.builtin(), R.Rule("own.word", R.LIGHT, pattern="wort", replace="word", needles=("wort",))]
    assert incremental.version_of("light") == incremental.version_of("light") != incremental.version_of("standard")
    assert incremental.version_of("light", own) not in (incremental.version_of("light"), incremental.version_of("standard", own))
    one = run(spark, folder, [("a", "ein wort", at(1)), ("b", "kein wort", at(1))])
    two = run(spark, folder, [("a", "ein wort", at(1))], rules=own)
    assert two["a"].cleaned == "ein word" and two["b"].cleaned == "kein wort" and two["a"].version != one["a"].version


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    write = incremental.sink(f"{tmp_path}/table", "standard")
    batch = spark.createDataFrame([("a", "“x”", at(1), "d")], f"{KIND}, digest string")
    write(batch, 4)
    write(batch, 4)
    got = spark.read.parquet(f"{tmp_path}/table").collect()
    assert [(r.path, r.batch, r.cleaned) for r in got] == [("a", 4, engine.cleaned(batch, "standard").first().report.cleaned)]
