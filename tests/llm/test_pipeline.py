"""The pipeline against plain versions of its stages, on a small corpus with every case planted."""

from collections import Counter

import corpus_pipeline
import pytest
from corpora import alnum_words, space_words, words
from test_dedup_shard_mix import plain_components, plain_fingerprint
from test_text_ops import brute_scan

from palimpsest.llm import mixing, toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    bad = " you vile scum fool really nasty words you vile scum fool"
    rows = [(i, words(60 + i % 40, 3000 + i) + (bad if i % 5 == 0 else ""), "en", f"s{i % 3}", 7, "x") for i in range(150)]
    item = words(40, 77)
    rows += [(200, rows[1][1], "en", "s1", 7, "x"), (201, rows[1][1].replace(" ", "  "), "en", "s2", 7, "x"), (202, words(60, 5) + " " + item, "en", "s0", 7, "x"), (203, None, None, None, None, None), (204, "", "en", "s0", 0, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def staged(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
        path = f"{folder}/out/{k}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        yield name, [(r.doc_id, r.text) for r in before.collect()], docs


def test_stages_equal_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"), learn=lambda k: ~toxicity.held_out(k))
    dense = model.dense()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    for name, before, frame in staged(spark, corpus):
        after = [(r.doc_id, r.text) for r in frame.collect()]
        if name == "toxicity":
            want = [(i, t) for i, t in before if toxicity.score_text(t.encode() if t else None, dense, model) < 0.7]
            assert len(want) <= 127 and 203 in dict(want)
        elif name == "near_dedup":
            roots = plain_components([plain_fingerprint(t) for _, t in before], [i for i, _ in before])
            want = [(i, t) for (i, t), c in zip(before, roots) if i == c]
            assert not {200, 201} & dict(want).keys()
        elif name == "decontamination":
            want = [(i, t) for i, t in before if not ((s := brute_scan(t, bench))[1] and 20 * s[1] >= s[0])]
            assert 202 not in dict(want)
        elif name == "mixing":
            times, size = Counter(after), {d: len(space_words(d[1])) for d in before}
            assert set(times) <= set(before) and max(times.values()) <= 2
            source = {r.doc_id: r.source for r in docs.collect()}
            sizes, taken = Counter(), Counter()
            for d in before:
                sizes[source[d[0]]] += size[d]
                taken[source[d[0]]] += size[d] * times[d]
            names = sorted(sizes, key=lambda s: (s is None, s or ""))
            for s, t in zip(names, mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])):
                assert abs(taken[s] - t) <= 100, (s, t, taken[s])
            continue
        else:
            rows = frame.collect()
            per = Counter()
            for r in rows:
                per[r.shard] += r.size
                assert r.size == len((r.text or "").encode()) + 8
            assert sum(per.values()) / 24 * 0.3 < min(per.values()) and max(per.values()) < sum(per.values()) / 24 * 2 and Counter(after) == Counter(before)
            continue
        assert sorted(map(str, after)) == sorted(map(str, want)), name


def test_run_is_the_stages_in_turn(spark, corpus):
    *_, (_, _, last) = staged(spark, corpus)
    one = sorted(str((r.doc_id, r.text, r["size"], r.shard)) for r in last.collect())
    assert one == sorted(str((r.doc_id, r.text, r["size"], r.shard)) for r in corpus_pipeline.run(spark, corpus).collect())
    assert all(alnum_words(r.text) or r.text in (None, "") for r in last.collect())


def test_empty_documents(spark, corpus, tmp_path):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, corpus)
    assert empty.count() == 0
