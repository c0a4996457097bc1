import json
import random
import time
import zlib

import numpy as np
import pytest
import zstandard
from corpora import alnum_words, documents, words
from pyspark.sql import functions as F

from palimpsest.llm import chat, quality, topk, toxicity


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def labelled(kind, n=300):
    r = random.Random(5)
    texts, y = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = words(r.randrange(30, 90), i)
        if bad and kind == "toxic":
            t += " you vile" + r.choice(["scum", "rat"]) + " fool" + " really nasty words"
        if bad and kind == "quality":
            t = (t.upper().replace(" ", "!! ") + "!!") if i % 2 else (t.split()[0] + " ") * 80
        texts.append(t)
        y.append(int(bad) if kind == "toxic" else int(not bad))
    return texts, np.array(y)


def test_toxicity_is_learnt_and_sparse():
    texts, y = labelled("toxic")
    raw = [t.encode() for t in texts]
    model = toxicity.fit(raw[:200], y[:200], toxicity.Settings(l1=2.0))
    dense = model.dense()
    s = np.array([toxicity.score_text(t, dense, model) for t in raw[200:]])
    assert auc(s, y[200:]) > 0.99 and len(model.at) < 5000 and 0 < toxicity.score_text(None, dense, model) < 0.7


def test_quality_is_learnt():
    texts, y = labelled("quality")
    raw = [t.encode() for t in texts]
    model = quality.fit(raw[:200], y[:200])
    both = quality.Compressors(model.bad, model.good)
    s = np.array([quality.score_text(t, both, model) for t in raw[200:]])
    assert auc(s, y[200:]) > 0.97 and 0 <= quality.score_text(b"", both, model) <= 1 and 0 <= quality.score_text(None, both, model) <= 1


@pytest.mark.parametrize("module,target", [(toxicity, "toxic"), (quality, "quality")])
def test_queries_score_every_row(spark, tmp_path, module, target):
    texts, y = labelled(target)
    data = [(i, t, *[None] * 9) for i, t in enumerate(texts)] + [(900, "", *[None] * 9), (901, None, *[None] * 9), (None, "x", *[None] * 9), (0, texts[0], *[None] * 9)]
    documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(v) if target == "quality" else None, int(v) if target == "toxic" else None) for i, v in enumerate(y)] + [(5000, 1, 1), (None, 1, 1), (900, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = module.query(spark, str(tmp_path)).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [(r.score, y[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(y)]
    assert auc(np.array([s for s, _ in held]), np.array([v for _, v in held])) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels_give_a_constant(spark, module):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r.score for r in module.scores(docs, module.train(docs, labels)).collect()}
    assert len(scores) == 1
    assert module.scores(documents(spark, []), module.train(docs, labels)).count() == 0


def test_search_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    data = [(i, [float(x) for x in centres[i % 8] + rng.normal(scale=0.2, size=16)]) for i in range(900)]
    data += [(1000 + i, data[i][1]) for i in range(20)] + [(2000, None), (2100, [1.0, None] + [0.0] * 14), (2200, [float("nan")] + [0.0] * 15), (2300, [float("inf")] + [0.0] * 15), (2400, [])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in topk.query(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(1024 * np.array(v, np.float32).astype(float)) for i, v in data if v and not any(x is None or not np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 100 == 0):
        want = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert set(got) == {i for i in good if i % 100 == 0}


def test_search_in_blocks_and_small_tables(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(-50, 50, 4)]) for i in range(40)], "vec_id long, v array<double>")
    whole = sorted(map(tuple, topk.search(vectors, vectors).collect()))
    assert whole == sorted(map(tuple, topk.search(vectors, vectors, part_rows=7, sample=5, pivots=3).collect())) and len(whole) == 400
    few = vectors.filter("vec_id < 3")
    assert topk.search(few, few).count() == 6 and topk.search(few.filter("false"), few).count() == 0


def test_search_of_several_lengths_without_ids_and_with_tied_ids(spark):
    rng = np.random.default_rng(6)
    data = [(i if i % 9 else None, [float(x) for x in rng.integers(-9, 9, 3 if i % 3 else 5)]) for i in range(120)]
    data += [data[1], data[1], (data[2][0], data[4][1]), (7000, [])]
    vectors = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = {}
    for r in topk.search(vectors, vectors.filter("vec_id % 10 = 0 or vec_id is null"), part_rows=11).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q, v in data:
        if q is not None and q % 10 == 0 and v:
            want = sorted((-int(np.dot(v, u)), i) for i, u in data if i is not None and i != q and len(u) == len(v))[:10]
            assert sorted(got.pop(q)) == want
    assert not got


@pytest.mark.parametrize("part_rows", [None, 7])
def test_rows_of_any_lengths_and_repeated_ids_ask_and_answer(spark, part_rows):
    rng = np.random.default_rng(8)
    data = [(int(rng.integers(12)) * 50, [float(x) for x in rng.integers(-9, 9, int(d))]) for d in rng.integers(0, 45, 300)]
    data += [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (100, [1.0, 0.0]), (100, []), (7, []), (None, [1.0, 2.0]), (5, None)]
    vectors = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(vectors, F.col("vec_id") % 100 == 0, k=4, part_rows=part_rows, pivots=5, sample=50).collect())
    want, live = [], [(i, v) for i, v in data if i is not None and v is not None]
    for n, (q, v) in enumerate(live):
        if q % 100 == 0:
            best = sorted((-int(np.dot(v, u)), i) for m, (i, u) in enumerate(live) if m != n and len(u) == len(v))[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want) and len({len(v) for _, v in live}) > 40


def test_the_query_and_its_sql_count_repeated_ids_as_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    data = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (200, [1.0, 0.5]), (200, [1.0, 0.5]), (300, []), (2, []), (400, None), (None, [1.0, 1.0]), (None, None)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(tuple(r) for r in topk.query(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(topk.ORACLE).fetchall()) and sum(q == 100 for q, *_ in got) == 8 and (300, 1, 2, 0) in got


def test_far_parts_are_left_out_and_return_only_rows_that_reach_the_bar(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in np.floor(np.eye(8)[i % 8] * 1000 + rng.normal(scale=9, size=8))]) for i in range(4000)]
    vectors = spark.createDataFrame(data, "vec_id long, v array<double>")
    centres = topk.choose_pivots(np.array([v for _, v in data[:200]]), 16)
    laid = topk.index(vectors.withColumn("dim", F.lit(8)), centres, 4, 250)
    parts = laid.select("part").distinct().count()
    rings = spark.sparkContext.broadcast(topk.described(laid))
    some = laid.filter("vec_id < 80").selectExpr("row key", "vec_id", "v", "dim")
    first = topk._asked(some, centres, rings, 10, (np.array([v for _, v in data[:200]]), np.arange(200), np.full(200, 8)))
    again = topk._asked(first.select("key", "vec_id", "v", "dim", F.col("part").alias("done"), "bar"), centres, rings, 10, None)
    assert first.count() == 80 and again.count() < 80 * parts / 2
    assert topk._meet(laid, "row", first, centres, 10).groupBy("key").count().agg({"count": "max"}).first()[0] <= 10


def test_levels_order_calls_and_leave_cycles_out(spark):
    edges = spark.createDataFrame(
        [("c", "a", None), ("c", "b", "a"), ("c", "d", "b"), ("c", "d", "a"), ("c", "e", "missing"), ("c", "x", "y"), ("c", "y", "x"), ("c", "z", "y"), (None, "q", None)],
        "conv string, call string, needs string",
    )
    assert {r.call: r.level for r in chat.levels(edges).collect()} == {"a": 0, "b": 1, "d": 2, "e": 0, "x": None, "y": None, "z": None}


def test_levels_of_random_graphs_equal_brute_force(spark):
    r = random.Random(8)
    rows, needs = [], {}
    for conv in range(3):
        for i in range(60):
            own = {i - 1} if i and r.random() < 0.6 else {r.randrange(i) for _ in range(r.randrange(4))} if i else set()
            needs[conv, i] = own
            rows += [(str(conv), str(i), str(n)) for n in own] + [(str(conv), str(i), None)]
    level = {}
    for (conv, i), own in needs.items():
        level[str(conv), str(i)] = max((level[str(conv), str(n)] + 1 for n in own), default=0)
    r.shuffle(rows)
    got = chat.levels(spark.createDataFrame(rows, "conv string, call string, needs string")).collect()
    assert {(x.conv, x.call): x.level for x in got} == level


def test_levels_in_small_blocks_equal_brute_force(spark):
    """Local needs, far needs and cycles, over blocks so small that needs cross them; ``at`` in order and at random."""
    r = random.Random(3)
    rows, needs = [], {}
    for conv in ("local", "far", "loops", "unplaced"):
        for i in range(32):
            own = {max(0, i - r.randrange(1, 4)) for _ in range(r.randrange(3))} - {i}
            if conv != "local" and i > 2:
                own |= {r.randrange(32 if conv == "loops" and r.random() < 0.1 else i)} - ({i} if conv != "loops" else set())
            needs[conv, str(i)] = {(conv, str(n)) for n in own}
            at = r.randrange(32) if conv == "unplaced" else i
            rows += [(conv, at, str(i), str(n)) for n in own] + [(conv, at, str(i), None)] * 2
    level, moved = {}, True
    while moved:
        new = {k: max((level[n] + 1 for n in v), default=0) for k, v in needs.items() if k not in level and all(n in level for n in v)}
        level, moved = level | new, bool(new)
    r.shuffle(rows)
    got = chat.levels(spark.createDataFrame(rows, "conv string, at long, call string, needs string"), width=9).collect()
    assert {(x.conv, x.call): x.level for x in got} == {k: level.get(k) for k in needs} and any(x.level is None for x in got)


def test_levels_of_a_thousand_consecutive_calls(spark):
    began = time.time()
    turns = spark.range(1000).selectExpr("1L conv_id", "id turn", "'user' role", "'x' text")
    got = chat.levels(chat.from_turns(turns)[2]).collect()
    assert sorted(r.level for r in got) == list(range(1000)) and time.time() - began < 60


def test_levels_without_an_end_raise(spark):
    rows = [("c", str(i), str(n)) for i in range(40) for n in (i - 1, i - 2) if n >= 0] + [("c", "0", None)]
    edges = spark.createDataFrame(rows, "conv string, call string, needs string")
    with pytest.raises(RuntimeError, match="did not settle"):
        chat._by_rounds(edges.selectExpr("conv", "0L at", "call", "needs", "cast(needs is not null as bigint) w"), rounds=3)


def test_arguments_of_every_type(spark):
    tools = {"t": {
        "n": {"type": "number", "most": 1e6}, "i": {"type": "integer"}, "b": {"type": "boolean"}, "o": {"type": "object"}, "a": {"type": "array", "most": 2},
        "e": {"type": "string", "one_of": ["x", "y"]},
    }}
    made = [
        '{"n": 1e5, "i": -0, "b": true, "o": {"z": [1.50], "a": null}, "a": [1, 2], "e": "x"}', '{"n": 100000.00}', '{"n": "1e999", "i": "1.5", "b": "yes", "o": "[]", "a": "{}", "e": "z"}',
        '{"a": [1,2,3], "n": 2e6}', '[1]', '{"n": 1, "n": 2}',
    ]
    calls = spark.createDataFrame([("c", str(k), "t", t) for k, t in enumerate(made)], "conv string, call string, tool string, j string")
    calls = calls.withColumn("args", chat.arguments(F.col("j"))).drop("j")
    nothing = spark.createDataFrame([], "conv string, call string, content string")
    edges = spark.createDataFrame([("c", str(k), None) for k in range(len(made))], "conv string, call string, needs string")
    got = {r.call: r for r in chat.formatted(calls, nothing, edges, tools).collect()}
    assert got["0"].valid and got["0"].json.startswith('{"arguments":{"a":[1,2],"b":true,"e":"x","i":0,"n":100000,"o":{"a":null,"z":[1.5]}}')
    assert got["1"].valid and '"n":100000}' in got["1"].json
    assert got["2"].problems == "a: not an array;b: not a boolean;e: not one of its values;i: not an integer;n: not a number;o: not an object"
    assert '"n":"1e999"' in got["2"].json and got["3"].problems == "a: above 2;n: above 1000000.0"
    assert got["4"].problems == got["5"].problems == "no tool or arguments"
    assert chat.formatted(calls.filter("false"), nothing, edges.filter("false"), tools).count() == 0


def test_links_problems_and_canonical_json(spark):
    calls = spark.createDataFrame(
        [("c", "1", "respond", {"turn": "3", "prompt": 'say "hi"\n\\'}), ("c", "2", "respond", {"turn": "x", "prompt": "", "more": "1"}), ("c", "3", "nope", {}), ("c", "4", "configure", None)],
        "conv string, call string, tool string, args map<string,string>",
    )
    results = spark.createDataFrame([("c", "1", "é"), ("c", "9", "orphan"), ("d", "2", "other")], "conv string, call string, content string")
    edges = spark.createDataFrame([("c", str(i), None) for i in range(1, 5)], "conv string, call string, needs string")
    got = {(r.conv, r.call): r for r in chat.formatted(calls, results, edges).collect()}
    assert got["c", "1"].status == "linked" and got["c", "1"].valid
    assert json.loads(got["c", "1"].json) == {"arguments": {"prompt": 'say "hi"\n\\', "turn": 3}, "call": "1", "result": "é", "tool": "respond"}
    assert got["c", "1"].json == json.dumps(json.loads(got["c", "1"].json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got["c", "2"].problems == "more: unknown;prompt: below 1;turn: not an integer" and not got["c", "2"].valid
    assert got["c", "3"].problems == "unknown tool" and got["c", "4"].problems == "no tool or arguments"
    assert got["c", "9"].status == "orphan" and got["c", "9"].valid is None and got["d", "2"].status == "orphan"


def test_turns_of_awkward_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, None, "c"), (2, 0, "assistant", "early"), (None, 0, "user", "x"), (3, None, "user", "x")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.call: r for r in chat.formatted(*chat.from_turns(turns)).collect()}
    assert got["1:0"].status == got["1:2"].status == "linked" and got["1:2"].level == 1 and not got["1:2"].valid
    assert got["2:-1"].status == "orphan" and len(got) == 3
    assert chat.formatted(*chat.from_turns(turns.filter("false"))).count() == 0


def plain_features(text):
    """Hashes of words, pairs, pairs with one between and triples, by whole numbers."""
    k = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
    size = 1 << 64
    h = [((zlib.crc32(w.encode()) + 1) * k[0]) % size for w in alnum_words(text)]
    h = [x ^ (x >> 29) for x in h]
    out = [x * k[1] for x in h]
    out += [(a * k[1] + b) * k[2] for a, b in zip(h, h[1:])] + [(a * k[2] + c) * k[3] for a, c in zip(h, h[2:])]
    out += [((a * k[1] + b) * k[3] + c) * k[2] for a, b, c in zip(h, h[1:], h[2:])]
    return {x % size >> 44 for x in out}


def test_training_equals_plain_ftrl():
    texts, y = labelled("toxic", 60)
    settings = toxicity.Settings(l1=1.0, epochs=2)
    model = toxicity.fit([t.encode() for t in texts], y, settings)
    order = np.random.default_rng(settings.seed).permutation(len(y))
    z, n, bias, bias_n = {}, {}, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 0.0

    def weight(i):
        v = z.get(i, 0.0)
        if abs(v) <= settings.l1:
            return 0.0
        return -(v - (1 if v > 0 else -1) * settings.l1) / ((settings.beta + n[i] ** 0.5) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for place, k in enumerate(order):
            if place % 5 == 4:  # held back for the calibration
                continue
            found = plain_features(texts[k])
            w = {i: weight(i) for i in found}
            g = 1 / (1 + np.exp(-(bias + sum(w.values())))) - y[k]
            for i in found:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / settings.alpha * w[i]
                n[i] = before + g * g
            bias_n += g * g
            bias -= settings.alpha * g / (settings.beta + bias_n**0.5)
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(model.at.tolist(), model.weight.tolist())).keys() == want.keys() and abs(model.bias - bias) < 1e-6
    assert all(abs(w - want[i]) < 1e-5 for i, w in zip(model.at.tolist(), model.weight.tolist()))


def test_compressed_sizes_equal_plain_compression():
    texts, y = labelled("quality", 200)
    model = quality.fit([t.encode() for t in texts], y)
    both = quality.Compressors(model.bad, model.good)
    long = words(3000, 8)
    for t in [*texts[:20], long, "", "x", "é" * 700]:
        raw = t.encode()
        cut = [raw[i : i + quality.BLOCK] for i in range(0, len(raw), quality.BLOCK)] or [b""]
        if len(cut) > 1 and len(cut[-1]) < quality.BLOCK // 2:
            cut[-2:] = [cut[-2] + cut[-1]]
        assert b"".join(cut) == raw
        sizes = []
        for d in (model.bad, model.good):
            plain = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append([len(plain.compress(b)) for b in cut])
        bad, good = map(sum, sizes)
        assert both.features(raw)[:2] == [(bad - good) / (bad + good), min((b - g) / (b + g) for b, g in zip(*sizes))]
        x = (np.array(both.features(raw)) - model.mean) / model.scale
        assert abs(quality.score_text(raw, both, model) - 1 / (1 + np.exp(-(model.weight[0] + x @ model.weight[1:])))) < 1e-12


def test_a_sample_is_bounded_and_the_same_again(spark):
    docs = documents(spark, [(i, f"text {i} " + "x" * (i % 50), *[None] * 9) for i in range(3000)])
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(3000)] + [(5, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 200, 1000)
    assert got == toxicity.labelled_sample(docs.repartition(7), labels, "toxic", 200, 1000)
    assert [sum(y == k for _, y in got) for k in (0, 1)] == [200, 200] and not any(t.startswith(b"text 5 ") for t, _ in got)
    few = toxicity.labelled_sample(docs, labels, "toxic", 200, 1000, most_bytes=2000)
    assert all(0 < sum(len(t) for t, y in few if y == k) <= 2000 for k in (0, 1))


def test_an_identifier_with_many_calls_and_results_gives_their_sum(spark):
    calls = spark.createDataFrame([("c", "hot", "respond", {"prompt": str(i), "turn": "1"}) for i in range(300)] + [("c", "one", "respond", {}), (None, "x", "respond", {})], "conv string, call string, tool string, args map<string,string>")
    results = spark.createDataFrame([("c", "hot", f"r{i % 250}") for i in range(500)] + [("c", "lost", "z"), (None, "x", "y"), ("c", "hot", None)], "conv string, call string, content string")
    edges = spark.createDataFrame([("c", "hot", None), ("c", "one", "hot")], "conv string, call string, needs string")
    got = chat.formatted(calls, results, edges).collect()
    status = {s: sum(r.status == s for r in got) for s in ("linked", "unanswered", "orphan", "surplus")}
    assert status == {"linked": 300, "unanswered": 2, "orphan": 2, "surplus": 250} and len(got) == 554
    assert {r.level for r in got if r.status == "linked"} == {0} and all(json.loads(r.json)["result"] == "r0" for r in got if r.status == "linked")
    assert {r.level for r in got if r.call == "one"} == {1} and {r.valid for r in got if r.status in ("orphan", "surplus")} == {None}
