"""Stylometric profiles of prose: burstiness, lexical variety, repeated contexts, markers.

Counts come from one Arrow pass that goes once over a text's words, whatever its length; measures and score are
Catalyst expressions over the counts. Scores are report-only. A text of under 60 words or 4 sentences has no profile.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import literals as lit
from .engine import once, sent_in_slices

#: A sentence ends behind . ! ? before white space, a closing mark or the end, and at a blank line.
BOUNDARY = regex.compile(r"(?<=[.!?])(?=[\p{White_Space}\")\]”])|(?<=\n)(?=\n)")
WORD = regex.compile(r"[\p{Alphabetic}'’]+")
WINDOW = 50
LEAST_WORDS, LEAST_SENTENCES = 60, 4
_MARKERS = frozenset(lit.DISCOURSE_MARKERS)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and apostrophes without outer apostrophes."""
    bare = (w.replace("’", "'").strip("'") for w in WORD.findall(text.lower()))
    return [w for w in bare if w]


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    ends = [m.start() for m in BOUNDARY.finditer(text)]
    return [w for a, b in zip([0, *ends], [*ends, len(text)]) if (w := words_of(text[a:b]))]


def distinct_in_windows(words: list[str], width: int = WINDOW) -> int:
    """Sum over all windows of ``width`` words (the whole, if shorter) of their different words."""
    now = Counter(words[:width])
    total = len(now)
    for out, new in zip(words, islice(words, width, None)):
        now[out] -= 1
        if not now[out]:
            del now[out]
        now[new] += 1
        total += len(now)
    return total


_COUNTS = ("n_words", "n_sentences", "distinct", "contexts", "markers")


def counted(text: str) -> dict:
    """Counts of one text; contexts are different runs of four words that a fifth follows."""
    sentences = sentences_of(text)
    words = [w for s in sentences for w in s]
    sizes = [float(len(s)) for s in sentences]
    mean = sum(sizes) / len(sizes) if sizes else 0.0
    runs = set(islice(zip(words, words[1:], words[2:], words[3:]), max(0, len(words) - 4)))
    counts = (len(words), len(sentences), distinct_in_windows(words), len(runs), sum(w in _MARKERS for w in words))
    return {"mean": mean, "squares": sum((x - mean) * (x - mean) for x in sizes), **dict(zip(_COUNTS, counts))}


def counts_column():
    """Arrow function of a text column: the counts."""

    @F.arrow_udf(", ".join(["mean double", "squares double", *(f"{c} long" for c in _COUNTS)]))
    def counts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("mean", pa.float64()), ("squares", pa.float64()), *((c, pa.int64()) for c in _COUNTS)])
        yield from sent_in_slices(texts, lambda t: counted(t or ""), kind)

    return once(counts)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the profile's columns, null where the text is too short. Narrow; repeated rows count each."""
    made = docs.select(F.col(f"`{id_col}`"), counts_column()(F.col(f"`{text_col}`")).alias("_c"))
    c = lambda name: F.col(f"_c.{name}")
    n, k = c("n_words"), c("n_sentences").cast("double")
    known = made.select(
        F.col(f"`{id_col}`"), n.alias("n_words"), c("n_sentences").alias("n_sentences"), c("mean").alias("mean_words"),
        F.try_divide(F.sqrt(F.try_divide(c("squares"), k)), c("mean")).alias("burstiness"),
        F.try_divide(c("distinct"), F.greatest(n - (WINDOW - 1), F.lit(1)) * F.least(n, F.lit(WINDOW))).alias("mattr"),
        F.when(n < 5, F.lit(0.0)).otherwise(F.try_divide(c("contexts"), n - 4)).alias("contexts"),
        F.try_divide(c("markers") * 100.0, n).alias("markers"),
    )
    score = (
        0.42 * _unit((0.62 - F.col("burstiness")) / 0.45)
        + 0.18 * _unit(1.0 - F.abs(F.col("mean_words") - 19.5) / 12.0)
        + 0.28 * _unit(F.col("markers") / 3.5)
        + 0.12 * _unit(1.0 - F.abs(F.col("mattr") - 0.78) / 0.22)
    )
    enough = (F.col("n_words") >= LEAST_WORDS) & (F.col("n_sentences") >= LEAST_SENTENCES)
    measures = {m: F.col(m) for m in ("mean_words", "burstiness", "mattr", "contexts", "markers")} | {"score": _unit(score)}
    return known.select(F.col(f"`{id_col}`"), "n_words", "n_sentences", *[F.when(enough, F.round(x, 6)).alias(name) for name, x in measures.items()])
