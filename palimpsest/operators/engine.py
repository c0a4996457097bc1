"""Findings, conflict resolution, splicing and cleaning over whole tables.

Two tiers share one registry. ``native_*`` keeps single rules inside Catalyst: counts, spans and replacements from the
rule's pattern. ``cleaned`` and ``findings`` run all active rules over a text in one Arrow pass, without a shuffle: one
automaton over all literals and one search over all special characters tell which rules can match at all, so clean
prose costs two scans and not a hundred. Reports, joins and streams around it stay relational.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, sparse_spans
from . import rules as R

#: Rows and bytes of a batch that a worker turns into Python objects at a time; a larger row comes alone.
SLICE, SLICE_BYTES = 256, 1 << 22


def once(function):
    """An Arrow function that a plan evaluates once: filters that explode() implies would otherwise repeat it."""
    return function.asNondeterministic()


def sliced(batch: pa.Array, *others: pa.Array) -> Iterator[tuple[list, ...]]:
    """The values of a batch's columns, stretch by stretch: Arrow sends ten thousand rows at once, whatever their size, and
    Python's texts take up to four bytes a character. The first column is the one of texts."""
    sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and (at - start == SLICE or held + size > SLICE_BYTES):
            yield tuple(c.slice(start, at - start).to_pylist() for c in (batch, *others))
            start, held = at, 0
        held += size
    if len(batch) > start:
        yield tuple(c.slice(start).to_pylist() for c in (batch, *others))


def sent_in_slices(columns: Iterator[pa.Array | tuple[pa.Array, ...]], one, kind: pa.DataType) -> Iterator[pa.Array]:
    """``one`` of each row as Arrow arrays of ``kind``, each sent before the next stretch is made, so that a worker never
    holds a batch's results."""
    for batch in columns:
        for values in sliced(*(batch if isinstance(batch, tuple) else (batch,))):
            yield pa.array([one(*row) for row in zip(*values)], kind)


def level_of(level: str | int) -> int:
    """A level by number, name or alias."""
    return level if isinstance(level, int) else R.LEVELS[level.lower()]


def active(level: str | int, rules: Sequence[R.Rule] | None = None) -> list[tuple[int, R.Rule]]:
    """Rules that run at a level, with their place in the registry."""
    top = level_of(level)
    return [(k, r) for k, r in enumerate(rules if rules is not None else R.builtin()) if r.level <= top]


class Detector:
    """All active rules over one text.

    Rules name what a text with a finding must hold: literals, which one automaton looks for in the lower-cased text, or
    characters, which are looked up for each distinct character of the text. Only the rules so named are run.
    """

    def __init__(self, level: str | int, rules: Sequence[R.Rule] | None = None) -> None:
        self.level = level_of(level)
        self.by_order = dict(active(level, rules))
        self.always = [k for k, r in self.by_order.items() if not r.needles and not r.signs]
        self.ranges = [(*(p if isinstance(p, tuple) else (p, p)), k) for k, r in self.by_order.items() for p in r.signs]
        self.by_char: dict[str, tuple[int, ...]] = {}
        by_needle: dict[str, set[int]] = {}
        for k, r in self.by_order.items():
            for n in r.needles:
                by_needle.setdefault(n, set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for n, ks in by_needle.items():
            self.automaton.add_word(n, ks)
        if by_needle:
            self.automaton.make_automaton()
        self.literals = bool(by_needle)

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if self.literals:
            # The final-sigma rule of str.lower is not wanted: each capital is folded by itself.
            for _, ks in self.automaton.iter(text.replace("\u03a3", "\u03c3").lower()):
                found |= ks
        for c in set(text):
            ks = self.by_char.get(c)
            if ks is None:
                u = ord(c)
                ks = self.by_char[c] = tuple({k for lo, hi, k in self.ranges if lo <= u <= hi})
            if ks:
                found.update(ks)
        return sorted(found)

    def find(self, text: str) -> list[tuple[int, int, int, int, str | None]]:
        """(rule order, sequence, start, end, replacement) in rule order; a replacement with a line break only reports."""
        lower = text.translate(R.ASCII_LOWER)
        out = []
        for k in self.candidates(text):
            for n, (s, e, r) in enumerate(self.by_order[k].find(text, lower, self.level)):
                out.append((k, n, s, e, None if r is not None and ("\n" in r or "\r" in r) else r))
        return out


def resolved(edits: list[tuple[int, int, int, int, str | None]]) -> list[tuple[int, int, int, int, str | None]]:
    """Edits that apply: by start, longer first, then registry and emission order; one that starts inside the last kept
    one is dropped and reported nowhere."""
    kept, end = [], -1
    for edit in sorted(edits, key=lambda f: (f[2], -f[3], f[0], f[1])):
        if edit[2] >= end:
            kept.append(edit)
            end = edit[3]
    return kept


def spliced(text: str, kept: list[tuple[int, int, int, int, str | None]]) -> str:
    """The text with kept edits in place and every other character as it was."""
    out, at = [], 0
    for _, _, s, e, r in kept:
        out += [text[at:s], r]
        at = e
    return "".join([*out, text[at:]])


_CLEAN = (
    "cleaned string, changed boolean, edits_applied long, flags long, applied map<string,long>, flagged map<string,long>, error string"
)
_FINDINGS = (
    "array<struct<rule_id:string,rule_ord:int,seq:int,start:int,end:int,byte_start:int,byte_end:int,replacement:string,applied:boolean>>"
)


def _tally(names: Iterator[str]) -> list[tuple[str, int]]:
    count: dict[str, int] = {}
    for n in names:
        count[n] = count.get(n, 0) + 1
    return sorted(count.items())


def clean_text(text: str, detector: Detector) -> dict:
    """One text through detect, resolve, splice and the self-check that its lines stay as many."""
    found = detector.find(text)
    kept = resolved([f for f in found if f[4] is not None])
    flags = [f for f in found if f[4] is None]
    new = spliced(text, kept) if kept else text
    sound = text.count("\n") == new.count("\n")
    name = lambda f: detector.by_order[f[0]].id
    return {
        "cleaned": new if sound else None, "changed": bool(kept), "edits_applied": len(kept), "flags": len(flags),
        "applied": _tally(map(name, kept)), "flagged": _tally(map(name, flags)), "error": None if sound else "self-check: lines changed",
    }


def clean_column(level: str | int = "standard", rules: Sequence[R.Rule] | None = None):
    """Arrow function of a text column: the cleaned text and its report. A null text gives a null report."""

    @F.arrow_udf(_CLEAN)
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detector = Detector(level, rules)
        tally = pa.map_(pa.string(), pa.int64())
        kind = pa.struct(
            [("cleaned", pa.string()), ("changed", pa.bool_()), ("edits_applied", pa.int64()), ("flags", pa.int64()), ("applied", tally),
             ("flagged", tally), ("error", pa.string())]
        )
        yield from sent_in_slices(texts, lambda t: None if t is None else clean_text(t, detector), kind)

    return once(clean)


def cleaned(docs: DataFrame, level: str | int = "standard", text_col: str = "text", rules: Sequence[R.Rule] | None = None) -> DataFrame:
    """``docs`` with ``report`` (cleaned text, whether it changed, counts by rule): narrow, rows independent."""
    return docs.withColumn("report", clean_column(level, rules)(F.col(f"`{text_col}`")))


def findings_column(level: str | int = "standard", rules: Sequence[R.Rule] | None = None):
    """Arrow function of a text column: all findings in rule order, edits marked that the resolution applies."""

    @F.arrow_udf(_FINDINGS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        detector = Detector(level, rules)
        number = pa.int32()
        kind = pa.list_(
            pa.struct(
                [("rule_id", pa.string()), ("rule_ord", number), ("seq", number), ("start", number), ("end", number), ("byte_start", number),
                 ("byte_end", number), ("replacement", pa.string()), ("applied", pa.bool_())]
            )
        )
        yield from sent_in_slices(texts, lambda t: None if t is None else _rows(t, detector), kind)

    return once(find)


def _rows(text: str, detector: Detector) -> list[dict]:
    found = detector.find(text)
    kept = {f[:2] for f in resolved([f for f in found if f[4] is not None])}
    offset = {p: p for f in found for p in f[2:4]}
    if not text.isascii():
        at = total = 0
        for p in sorted(offset):
            total += len(text[at:p].encode())
            offset[p], at = total, p
    return [
        {"rule_id": detector.by_order[k].id, "rule_ord": k, "seq": n, "start": s, "end": e, "byte_start": offset[s], "byte_end": offset[e],
         "replacement": r, "applied": (k, n) in kept}
        for k, n, s, e, r in found
    ]


def findings(docs: DataFrame, level: str | int = "standard", id_col: str = "doc_id", text_col: str = "text", rules: Sequence[R.Rule] | None = None) -> DataFrame:
    """A row per finding: id, rule, place in code points and in UTF-8 bytes, replacement (null: report only), applied."""
    found = docs.select(F.col(f"`{id_col}`"), findings_column(level, rules)(F.col(f"`{text_col}`")).alias("f"))
    return found.select(id_col, F.inline("f"))


def report(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts by rule (and ``keys``) of applied edits and of reports; dropped edits count in neither."""
    return found.groupBy(*keys, "rule_id").agg(
        F.sum((F.col("applied")).cast("long")).alias("applied"), F.sum(F.col("replacement").isNull().cast("long")).alias("flagged")
    )


def report_of(made: DataFrame, keys: Sequence[str] = (), report_col: str = "report") -> DataFrame:
    """``report`` from ``cleaned`` documents: their tallies are one list of (rule, applied, flagged), so texts are cleaned once."""
    none = F.lit(0).cast("long")
    entries = lambda name: F.map_entries(F.coalesce(F.col(f"{report_col}.{name}"), F.create_map().cast("map<string,bigint>")))
    row = lambda rule, applied, flagged: F.struct(rule.alias("rule_id"), applied.alias("applied"), flagged.alias("flagged"))
    tallies = F.concat(
        F.transform(entries("applied"), lambda e: row(e["key"], e["value"], none)), F.transform(entries("flagged"), lambda e: row(e["key"], none, e["value"]))
    )
    return made.select(*keys, F.inline(tallies)).groupBy(*keys, "rule_id").agg(F.sum("applied").alias("applied"), F.sum("flagged").alias("flagged"))


# --- single rules as Catalyst expressions ----------------------------------------------------------------------------


def native_count(rule: R.Rule, text: Column) -> Column:
    """How often a patterned rule finds something."""
    return F.regexp_count(ascii_lower(text) if rule.ignore_case else text, F.lit(rule.java)).cast("long")


def native_spans(rule: R.Rule, text: Column) -> Column:
    return sparse_spans(ascii_lower(text) if rule.ignore_case else text, rule.java)


def native_clean(rule: R.Rule, text: Column) -> Column:
    """The text after one rule with a constant or mapped replacement."""
    if isinstance(rule.replace, str):
        if not rule.ignore_case:
            return F.regexp_replace(text, rule.java, rule.replace)
        return F.regexp_replace(text, "(?i)" + rule.java, rule.replace)
    out = text
    single = {c: t for c, t in rule.replace.items() if len(t) == 1}
    gone = [c for c, t in rule.replace.items() if not t]
    longer = {c: t for c, t in rule.replace.items() if len(t) > 1}
    if single or gone:
        out = F.translate(out, "".join([*single, *gone]), "".join(single.values()))
    for c, t in longer.items():
        out = F.replace(out, F.lit(c), F.lit(t))
    return out


def lexical_counts(docs: DataFrame, specs, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, rule_id, n)`` of report-only packs by Catalyst: per rule one alternation, boundaries checked afterwards.

    Meant for texts whose lower-casing keeps lengths; the Arrow path handles the others exactly.
    """
    from ..functions.text import any_of, dialect

    word = dialect("[@ALNUM@]", "java")
    lower = F.lower(F.col(f"`{text_col}`"))

    def outside(span: Column, t: Column) -> Column:
        is_word = lambda c: F.coalesce(F.rlike(c, F.lit(word)), F.lit(False))
        before = F.when(span["s"] > 0, F.substring(t, span["s"], F.lit(1))).otherwise("")
        after = F.substring(t, span["e"] + 1, F.lit(1))
        first, last = F.substring(span["m"], 1, 1), F.substring(span["m"], -1, 1)
        return ~(is_word(first) & is_word(before)) & ~(is_word(last) & is_word(after))

    base = docs.select(F.col(f"`{id_col}`"), lower.alias("_t"))
    counts = [
        F.struct(F.lit(s.id).alias("rule_id"), F.size(F.filter(sparse_spans(F.col("_t"), any_of(s.targets)), lambda x: outside(x, F.col("_t")))).cast("long").alias("n"))
        for s in specs
    ]
    return base.select(id_col, F.inline(F.array(*counts))).filter("n > 0")
