"""Periodic runs against a plain search of every stretch, lag counts against plain counts."""

import random
import time
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import runs


def plain(w):
    """All runs by trying every lag at every place."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda x: (x[0], x[2]))


def samples():
    r = random.Random(4)
    for size in (1, 2, 3, 9):
        for _ in range(60):
            yield [r.randrange(size) for _ in range(r.randrange(90))]
    for _ in range(150):  # nested repetitions, with faults
        w = [r.randrange(3) for _ in range(r.randrange(1, 5))]
        for _ in range(r.randrange(1, 4)):
            w = w * r.randrange(1, 7) + [r.randrange(3) for _ in range(r.randrange(3))]
        w = [r.randrange(4) for _ in range(r.randrange(9))] + w[:400]
        yield w


@pytest.mark.parametrize("loud", [False, True])
def test_runs_equal_the_plain_search(loud, monkeypatch):
    if loud:  # short texts have no word that is frequent enough for an FFT of its own accord
        monkeypatch.setattr(runs.np, "sqrt", lambda x: 0.0)
    found = 0
    for w in samples():
        want = plain(w)
        assert runs.runs(np.array(w, np.int64)) == want, w
        found += len(want)
    assert found > 300


def test_lag_counts_are_exact_with_frequent_and_rare_words():
    r = random.Random(2)
    ids = np.array([r.choice([0, 0, 0, 1, 1, r.randrange(400)]) for _ in range(3000)], np.int64)
    assert (np.bincount(ids) > 700).any()
    assert runs.lag_counts(ids, 750).tolist() == [0] + [int((ids[:-q] == ids[q:]).sum()) for q in range(1, 751)]


def test_long_repetitive_texts_stay_cheap():
    """One word 400,000 times, and a loop of 900 words behind as much prose: the inside of a run is not scanned again."""
    began = time.process_time()
    assert runs.runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    prose = np.arange(100_000, dtype=np.int64)
    loop = np.tile(np.arange(100_000, 100_900), 111)
    assert runs.runs(np.concatenate([prose, loop])) == [(100_000, 900 * 111, 900)]
    assert time.process_time() - began < 60


def test_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b " * 6 + "c"), (1, "a b " * 6 + "c"), (None, "x " * 9), (2, None), (3, ""), (4, "a a a a a"), (5, "é é é é é é\x0bz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "name", "runs", "a.b")})
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic(docs).collect()), key=str)
    want = [(1, [(0, 12, 2)], "a b c")] * 2 + [(None, [(0, 9, 1)], "x"), (2, [], ""), (3, [], ""), (4, [], "a a a a a"), (5, [(0, 6, 1)], "é z")]
    assert got == sorted(want, key=str) and runs.periodic(docs.limit(0)).collect() == []


def test_the_query_plants_loops_and_digests_what_it_finds(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 7 + k) % (50 + i)}" for k in range(i % 97))) for i in range(400)] + [(400, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in runs.query(spark, str(tmp_path)).collect()}
    import hashlib

    for i, text in rows:
        w = (text or "").split()
        h, n = crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want = plain(w)
        drop = {k for s, m, q in want for k in range(s + q, s + m)}
        top = max(want, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.start) == (len(want), top and top[0]) and (top is None or (r.length, r.period, r.exponent_milli) == (top[1], top[2], 1000 * top[1] // top[2]))
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10
