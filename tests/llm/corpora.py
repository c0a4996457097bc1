"""Small tables with every awkward case, and plain versions of the operators to compare with."""

import random
import re

LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, score string, th string, _id long, shard string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()) + str(r.randrange(40)) for _ in range(n))


def rows():
    base = words(120, 1)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [base, base, near, words(80, 2), words(5, 3), "", None, " \n\t ", "one", "one two three", words(4000, 4), "Ünïcode Straße ÀÉ 𝐀 " + words(30, 5)]
    texts += [words(60, 100 + i) for i in range(30)] + [words(60, 100)] * 3
    out = [(i, t, "en" if i % 2 else None, [None, "a", "b", "é"][i % 4], len(t or ""), "x", "y", "z", "w", 7, "s") for i, t in enumerate(texts)]
    return out + [out[0], (None, "null id text", None, None, 12, None, None, None, None, None, None)]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def alnum_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
