"""The similarity join of shingle sets against all pairs compared plainly."""

import random

import numpy as np
import pytest
from corpora import documents, space_words, words
from pyspark.sql import functions as F

from palimpsest.llm import hashed, jaccard


def shingle_set(text, size=3):
    w = space_words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(texts, least=90, size=3):
    """Component (least index) of every text, by all pairs."""
    sets, up = [shingle_set(t, size) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= least * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    base, other = words(150, seed).split(), words(40, seed + 1).split()
    boiler = words(60, 77).split()
    texts = ["", None, " \n", "a", "A", "a b", "a  b", "a b c", "b a", "a b c d"]
    for k in range(60):  # around the threshold: each change breaks three shingles
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(5)}"
        texts.append(" ".join(w))
    for k in range(30):
        w = list(other) + ["tail"] * (k % 2)
        w[r.randrange(len(w))] = f"y{r.randrange(3)}"
        texts.append(" ".join(w))
    texts += [" ".join(boiler + words(3 + k % 5, 500 + k).split()) for k in range(40)]  # mostly one passage
    texts += [" ".join(base[k:] + base[:k]) for k in range(0, 12)] + [words(60, 900 + k) for k in range(20)] + [" ".join(base)] * 5
    texts += ["é𝐀 " * 50, "é𝐀 " * 51, "same " * 400, "same same same"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,tile,least,size", [(1, 1024, 90, 3), (2, 8, 90, 3), (3, 1024, 80, 5), (4, 16, 60, 1)])
def test_components_equal_all_pairs(spark, seed, tile, least, size):
    texts = corpus(seed)
    docs = documents(spark, [(i, t, None, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, size=size, least=least, tile=tile).collect()}
    want = plain(texts, least, size)
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 50


def test_chains_beyond_the_first_set_of_a_group_are_followed(spark, monkeypatch):
    """Without the turns that contract a group early, the comparison of tiles alone finds every link."""
    monkeypatch.setattr(jaccard, "LEADERS", 0)
    base = words(120, 5).split()
    texts = [" ".join(base[:k] + [f"z{i}" for i in range(k)] + base[k:]) for k in range(1, 40)]
    docs = documents(spark, [(i, t, None, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in jaccard.classes(docs, tile=8).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in plain(texts)]


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(7, words(30, 1)), (7, words(30, 1)), (None, words(30, 1)), (None, words(30, 2)), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "n", "a.b", "component_id", "id")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    assert got == sorted([(7, 28, 7), (7, 28, 7), (None, 28, 7), (None, 28, None), (9, 0, 9), (None, 0, None)], key=str)
    assert jaccard.classes(docs.limit(0)).collect() == []


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(hashed, "BLOCK", 64)
    text = (words(300, 3) + " " + "long" * 100 + " É𝐀 ÀB\x0bc").encode()
    plain_words = text.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    got, pieces, starts, ends = hashed.words(text)
    names = {}
    assert [text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())] == [w.lower() for w in plain_words]
    assert len(got) == len(plain_words) and not pieces.any()
    assert all(names.setdefault(h, w) == w for h, w in zip(got.tolist(), plain_words)) and len(names) == len(set(plain_words))
    _, pieces, _, _ = hashed.words(b"a b. c\n d", hashed.kinds(b".\n", b" "))
    assert pieces.tolist() == [0, 0, 1, 2]


def test_overlaps_by_products_equal_those_pair_by_pair():
    r = random.Random(8)
    tokens = [np.array(sorted(r.sample(range(9000), r.randrange(1, 9000))), np.uint64) for _ in range(60)]
    near = np.triu(np.ones((60, 60), bool), 1)
    many = list(jaccard._overlaps(near, tokens))
    assert len(many) == 1770 and all(both == len(np.intersect1d(tokens[i], tokens[j])) for i, j, both in many)
    few = near & (np.arange(60)[:, None] == 3)
    assert list(jaccard._overlaps(few, tokens)) == [x for x in many if x[0] == 3]
