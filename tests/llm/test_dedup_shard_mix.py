import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyspark.sql.functions as F
import xxhash
from corpora import documents, rows, space_words, words

from palimpsest.llm import decontam, mixing, sharding, simhash
from palimpsest.llm.common import join_by_key


def plain_fingerprint(t):
    w = space_words(t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[find(i)] for i in range(len(fps))]


def test_classes_equal_brute_force(spark):
    docs = documents(spark)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect())
    data = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in data]
    roots = plain_components(fps, [i for i, _ in data])
    assert got == Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(data, fps, roots))


def test_kept_leaves_one_row_of_each_component(spark):
    docs = documents(spark)
    data = [(r.doc_id, r.text) for r in docs.collect()]
    roots = plain_components([plain_fingerprint(t) for _, t in data], [i for i, _ in data])
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in roots if c is not None})


def test_every_key_width_and_tile_finds_the_same_components(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 6)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.choice(63, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = None
    for m, tile in ((1, 2048), (1, 16), (2, 64)):
        edges = simhash.links(frame, tile=tile, m=m)
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in edges.collect())
        assert edges.count() <= 15 * 40 * len(fps)
        tree = {r.node: r.root for r in simhash.components(edges).collect()}
        got = [tree.get(f, f) for f in fps]
        want = want or got
        assert got == want
    unsigned = [f & (2**64 - 1) for f in fps]
    brute = plain_components(unsigned, fps)
    assert got == brute


def test_long_chain_settles(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_shards_are_contiguous_even_and_gapless(spark):
    docs = documents(spark)
    laid, cuts = sharding.plan(docs, shards=4)
    rows = sharding.assigned(laid, cuts).collect()
    assert len(rows) == docs.count()
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r)
    total, biggest = sum(r.size for r in rows), max(r.size for r in rows)
    for k in range(4):
        assert sorted(r.slot for r in per[k]) == list(range(len(per[k])))
        assert abs(sum(r.size for r in per[k]) - total / 4) <= biggest + 0.02 * total
    assert all(r.crc == zlib.crc32(b"") for r in rows if r.size == 8)
    moved = docs.select("doc_id", "text", sharding.shard_of(cuts).alias("s")).collect()
    assert {(r.doc_id, r.text): r.s for r in moved} == {(d.doc_id, d.text): r.shard for d in docs.collect() for r in rows if (r.id, r.size - 8) == (d.doc_id, len((d.text or "").encode()))}


def test_a_row_that_ends_just_short_of_a_target_does_not_hold_it(spark):
    # Rows are laid out by the hash of their texts: the first ends a twenty-fourth of a byte short of the first target, the
    # second holds it.
    share = 100_000
    sizes = [share, 1_000, *[share] * 22, share - 999]
    texts = [None] * len(sizes)
    for n in set(sizes):
        at = [k for k, x in enumerate(sizes) if x == n]
        made = spark.range(400).select(F.rpad(F.col("id").cast("string"), n - 8, "x").alias("t")).select("t", F.xxhash64("t").alias("h")).orderBy("h").collect()
        for k in at:
            # Hashes of the k-th text lie in the k-th stretch of all hashes.
            texts[k] = next(r.t for r in made if (r.h + 2**63) * len(sizes) >> 64 == k)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    laid, cuts = sharding.plan(docs, shards=24)
    assert cuts.total == 24 * share + 1
    per = {r.shard: r.bytes for r in sharding.assigned(laid, cuts).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    assert len(per) == 24 and max(per.values()) <= share + 1_000


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.classes(none).count() == 0 and simhash.kept(none).count() == 0
    laid, cuts = sharding.plan(none)
    assert sharding.assigned(laid, cuts).count() == 0
    assert mixing.mixed(none).count() == 0


def test_targets_reshare_the_excess():
    got = mixing.targets([100, 10, 100], [3, 1, 2])
    assert abs(sum(got) - 1.5 * 210) < 1e-9 and got[1] == 20 and max(g / s for g, s in zip(got, [100, 10, 100])) <= 2
    assert mixing.targets([0, 5], [3, 1]) == [0, 7.5]


def test_flow_moves_words_between_overlapping_sources():
    flow = mixing.min_cost_flow([10, 10, 5], [[0], [0, 1], [1]], [12, 14])
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [12, 14]
    assert sum(max(0, sum(f.values()) - n) for f, n in zip(flow, [10, 10, 5])) == 1
    # The second source can only be met if the first gives up shared words.
    flow = mixing.min_cost_flow([4, 4], [[0, 1], [0]], [4, 4], copies=1)
    assert [sum(f.get(s, 0) for f in flow) for s in (0, 1)] == [4, 4]


def test_mix_meets_targets_and_reruns_agree(spark):
    import pyspark.sql.functions as F

    # Whole documents only: a source that is mostly one document cannot come nearer than that document allows.
    docs = documents(spark).filter("n_chars < 20000")
    rows = mixing.keyed(docs, F.array("source"))
    plan = mixing.plan(rows)
    taken = defaultdict(int)
    once = []
    for _ in range(2):
        got = sorted((str(r.doc_id), r["__size"], r["__copies"]) for r in mixing.copies_column(rows, plan).collect())
        once.append(got)
    assert once[0] == once[1] and all(0 <= c <= 2 for *_, c in once[0])
    for r in mixing.copies_column(rows, plan).collect():
        taken[r.source] += r["__size"] * r["__copies"]
    for s, t in plan.quota.items():
        assert abs(taken[s] - t) <= 130, (s, t, taken[s])
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() > 0


def test_a_very_long_document_passed_over_can_still_be_the_last(spark):
    # 550 words in small documents, one of 400, 50 more behind it: 900 are asked for; 1,000 are nearer than 600.
    sizes = [10] * 55 + [400] + [10] * 5
    rows = spark.createDataFrame([(["a"], n, i) for i, n in enumerate(sizes)], "__members array<string>, __size long, __rank long").repartition(3)
    for rest, want in ((900, 1000), (600, 600), (700, 600), (1000, 1000), (560, 560)):
        cut = mixing._cuts(spark, rows, [[["a"], 1000]], [0], [rest])[0]
        made = mixing.Plan([(["a"], cut)], {}, {}, [])
        got = mixing.copies_column(rows, made).collect()
        assert sum(r["__size"] * r["__copies"] for r in got) == want and max(r["__copies"] for r in got) == 1


def test_flow_equals_brute_force_on_small_cases():
    r = random.Random(3)
    for _ in range(80):
        members = [r.choice(([0], [1], [0, 1])) for _ in range(3)]
        supply, quota = [r.randrange(3) for _ in members], [r.randrange(7), r.randrange(7)]
        best = None
        options = [list(product(*(range(2 * n + 1) for _ in m))) for n, m in zip(supply, members)]
        for pick in product(*options):
            got, cost = [0, 0], 0
            for n, m, x in zip(supply, members, pick):
                if sum(x) > 2 * n:
                    break
                cost += max(0, sum(x) - n)
                for s, k in zip(m, x):
                    got[s] += k
            else:
                if got[0] <= quota[0] and got[1] <= quota[1]:
                    best = max(best or (-1, 0), (sum(got), -cost))
        flow = mixing.min_cost_flow(supply, members, quota)
        used = [sum(f.values()) for f in flow]
        met = [sum(f.get(s, 0) for f in flow) for s in (0, 1)]
        assert all(u <= 2 * n for u, n in zip(used, supply)) and all(a <= q for a, q in zip(met, quota))
        assert (sum(used), -sum(max(0, u - n) for u, n in zip(used, supply))) == best, (members, supply, quota)


def test_many_patterns_are_solved_quickly():
    n = 50_000
    began = time.time()
    flow = mixing.min_cost_flow([10] * n, [[k] for k in range(n)], [15] * n)
    assert all(sum(f.values()) == 15 for f in flow) and time.time() - began < 20


def clashing(spark):
    names = ["__size", "__rank", "__members", "__copies", "__own0", "__nth", "key", "th", "own", "scan", "__scan", "fp", "a.b", "x`y"]
    rows = [(i, words(40, i % 9), "ab"[i % 2], *[f"v{i}"] * len(names)) for i in range(30)]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *names])


def test_columns_named_like_working_columns_stay(spark):
    docs = clashing(spark)
    bench = spark.createDataFrame([("q", words(40, 3))], "item_id string, text string")
    for made in (simhash.kept(docs), decontam.clean(docs, bench), mixing.mixed(docs)):
        rows = made.collect()
        assert made.columns == docs.columns and rows
        assert all(set(r[3:]) == {f"v{r[0]}"} and r[1] == words(40, r[0] % 9) for r in rows)
    assert {r.doc_id for r in simhash.kept(docs).collect()} == set(range(9))


def test_kept_is_the_same_by_broadcast_and_by_shuffle(spark):
    docs = documents(spark).repartition(5)
    both = [sorted(str(tuple(r)) for r in simhash.kept(docs, most_marked=m).collect()) for m in (0, 1_000_000)]
    assert both[0] == both[1]
    plan = simhash.kept(documents(spark, rows()[:-1]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_a_dense_group_costs_passes_and_not_pairs():
    rng = np.random.default_rng(0)
    fps = np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(6000)], np.uint64))
    began = time.time()
    found = simhash._links(fps, np.zeros(len(fps), np.int8), [0], 0, 4)
    assert len(found) == len(fps) - 1 and time.time() - began < 10


def test_a_key_of_a_third_of_all_rows_is_not_shuffled(spark):
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(6000)], "k long, v long")
    table = rows.groupBy("k").agg(F.count("v").alias("n")).withColumn("t", F.col("k") * 2)
    got = join_by_key(rows, table, ["k"], 6000)
    assert got.columns == ["k", "v", "t"] and sorted((r.k, r.v, r.t) for r in got.collect()) == sorted((k, i, 2 * k) for i in range(6000) for k in [0 if i % 3 == 0 else i])
