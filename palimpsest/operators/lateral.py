"""The document engine in SQL text: table functions for LATERAL joins and scalar functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import engine
from . import rules as R


def _finder(packs: Sequence[R.Rule]) -> Callable[[str | None], engine.Detector]:
    """Detectors by level, built when a level is first asked for; ``packs`` are rules besides the built-in ones."""
    made: dict[int, engine.Detector] = {}

    def get(level: str | None) -> engine.Detector:
        top = engine.level_of(level or "standard")
        if top not in made:
            made[top] = engine.Detector(top, [*R.builtin(), *packs] if packs else None)
        return made[top]

    return get


def register(spark: SparkSession, packs: Sequence[R.Rule] = (), prefix: str = "") -> list[str]:
    """Names of the SQL functions that a session has from now on.

    ``findings(text, level)`` is a table function: a row for each finding of a text, with the columns of
    ``engine.findings`` but the document's own, to be joined laterally. ``cleaned(text, level)`` is one with a single row: the
    text as cleaned and what was done. A null text has no findings, and a row of nulls from ``cleaned``; a null level is
    ``standard``; an unknown one raises. ``packs`` are rules of the user's own, which run behind the built-in ones. Rules
    are compiled once a worker and level, not once a row.
    """
    fields = engine.findings(spark.createDataFrame([], "doc_id long, text string")).drop("doc_id").schema
    report = engine.cleaned(spark.createDataFrame([], "doc_id long, text string")).schema["report"].dataType
    names = [f.name for f in fields]

    class Findings:
        def __init__(self) -> None:
            self.detector = _finder(packs)

        def eval(self, text: str, level: str) -> Iterator[tuple]:
            if text is not None:
                for row in engine._rows(text, self.detector(level)):
                    yield tuple(row[n] for n in names)

    class Cleaned:
        def __init__(self) -> None:
            self.detector = _finder(packs)

        def eval(self, text: str, level: str) -> Iterator[tuple]:
            if text is None:
                yield (None,) * len(report.names)
            else:
                made = engine.clean_text(text, self.detector(level))
                yield tuple(dict(made[n]) if n in ("applied", "flagged") else made[n] for n in report.names)

    # Rows are pickled, a hundred at a time: Arrow would make a batch of its own for each text's few findings.
    out = []
    for name, function, kind in (("findings", Findings, fields), ("cleaned", Cleaned, report)):
        spark.udtf.register(prefix + name, udtf(function, returnType=kind, useArrow=False))
        out.append(prefix + name)
    return out
