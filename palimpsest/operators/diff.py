"""Line differences between a text and its cleaned version: removed and added lines only, in order."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import once, sent_in_slices


def line_diff(before: str, after: str) -> list[str]:
    """Lines that went, marked ``-``, and lines that came, marked ``+``; common lines are left out."""
    a, b = before.split("\n"), after.split("\n")
    # Equal ends are cut first: most texts differ in a few lines.
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if a or b else []:
        if kind != "equal":
            out += ["-" + x for x in a[i:j]] + ["+" + x for x in b[k:m]]
    return out


def diffs(pairs: DataFrame, id_col: str, before: str, after: str) -> DataFrame:
    """``(id, pos, line)``: a row per changed line; a null text is an empty one."""

    @F.arrow_udf("array<string>")
    def diff(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from sent_in_slices(pairs, lambda a, b: line_diff(a or "", b or ""), pa.list_(pa.string()))

    return pairs.select(F.col(f"`{id_col}`"), F.posexplode(once(diff)(F.col(before), F.col(after))).alias("pos", "line"))
