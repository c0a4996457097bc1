"""How much of a text's n-grams another version keeps: multiset differences, row by row in one narrow pass.

Windows of all texts are several times the size of the texts, so they are counted where the texts are and never
shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dialect
from .engine import once, sent_in_slices

#: A token is a run of letters, numbers and apostrophes, or any other single character that is no white space.
TOKEN = "[@ALNUM@'’]+|[^@SPACE@]"
_TOKEN = regex.compile(dialect(TOKEN, "python"))


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text, in Catalyst."""
    return F.transform(F.regexp_extract_all(text, F.lit(dialect(TOKEN, "java")), F.lit(0)), lambda w: F.translate(F.lower(w), "’", "'"))


def tokenised(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().replace("’", "'"))


def lost_windows(before: list[str], after: list[str], n: int) -> tuple[int, int]:
    """Windows of ``n`` tokens before, and how many of them have no copy left after."""
    one, two = (Counter(zip(*(t[k:] for k in range(n)))) for t in (before, after))
    return max(0, len(before) - n + 1), sum((one - two).values())


def disruption(pairs: DataFrame, id_col: str, before: str = "before", after: str = "after") -> DataFrame:
    """Per row: the id, tokens of both versions, 5-gram windows and those lost, and the shares of lost 5-grams and bigrams.

    A window that stands twice before needs two copies after. A null text is an empty one; shares of none are 0.
    """

    names = ("tokens_before", "tokens_after", "windows", "lost", "bigrams", "gone")

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def measure(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def one(a: str | None, b: str | None) -> dict:
            x, y = tokenised(a or ""), tokenised(b or "")
            return dict(zip(names, (len(x), len(y), *lost_windows(x, y, 5), *lost_windows(x, y, 2))))

        yield from sent_in_slices(pairs, one, pa.struct([(n, pa.int64()) for n in names]))

    made = pairs.select(F.col(f"`{id_col}`"), once(measure)(F.col(before), F.col(after)).alias("m")).select(id_col, "m.*")
    share = lambda x, t: F.coalesce(F.round(F.try_divide(F.col(x), F.col(t)), 6), F.lit(0.0))
    return made.select(id_col, *names[:4], share("lost", "windows").alias("lost_share"), share("gone", "bigrams").alias("bigram_share"))
