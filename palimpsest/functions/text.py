"""Text columns: character classes in two regular-expression dialects, spans of matches, newline kinds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and numbers of any script, as Java and as Python's ``regex`` write them.
ALNUM = {"java": r"\p{IsAlphabetic}\p{N}", "python": r"\p{Alphabetic}\p{N}"}
ALPHA = {"java": r"\p{IsAlphabetic}", "python": r"\p{Alphabetic}"}
#: White space as Unicode has it.
SPACE = {"java": r"\p{IsWhite_Space}", "python": r"\p{White_Space}"}

SPAN = "array<struct<s:int,e:int,m:string>>"


def dialect(pattern: str, name: str) -> str:
    """``pattern`` with @ALNUM@, @ALPHA@ and @SPACE@ (inside classes) written for ``java`` or ``python``."""
    return pattern.replace("@ALNUM@", ALNUM[name]).replace("@ALPHA@", ALPHA[name]).replace("@SPACE@", SPACE[name])


def chars(*parts: int | tuple[int, int] | str) -> str:
    """The inside of a character class: code points, ranges, or the characters of a string."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out += [_literal(ord(c)) for c in p]
        elif isinstance(p, tuple):
            out.append(f"{_literal(p[0])}-{_literal(p[1])}")
        else:
            out.append(_literal(p))
    return "".join(out)


def _literal(code: int) -> str:
    return f"\\x{code:02x}" if code < 0x80 else chr(code)


def quoted(text: str) -> str:
    """``text`` as a pattern that matches itself in Java, Python and RE2."""
    return "".join(c if c.isalnum() or ord(c) >= 0x80 or c in " _" else f"\\x{ord(c):02x}" for c in text)


def any_of(words: Iterable[str]) -> str:
    """An alternation that finds the longest of the words that start at a place: longer ones come first."""
    return "|".join(quoted(w) for w in sorted(dict.fromkeys(words), key=lambda w: (-len(w), w)))


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<s,e,m>>``: matches of a Java pattern from left to right, in code points, end exclusive.

    What stands between matches and the matches alternate, so positions are running sums of lengths. The pattern must
    not match the empty string. Quadratic in the number of matches of one text; for dense multi-rule work use the
    engine's Arrow path.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["hit"])
        more = F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), pair["hit"].alias("m")))).alias("out"))
        return F.when(pair["hit"].isNull(), acc).otherwise(more)

    # The gap after the last match has no match beside it.
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def sparse_spans(text: Column, pattern: str) -> Column:
    """``spans`` behind one cheap search, for patterns that few texts match."""
    return F.when(F.rlike(text, F.lit(pattern)), spans(text, pattern)).otherwise(F.array().cast(SPAN))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else, so that positions stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def newline_kind(text: Column) -> Column:
    """lf, crlf, cr or mixed; lf where there is none."""
    crlf = F.regexp_count(text, F.lit(r"\r\n"))
    lf = F.regexp_count(text, F.lit(r"\n")) - crlf
    cr = F.regexp_count(text, F.lit(r"\r")) - crlf
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(cr > 0, "cr").otherwise("lf")


def line_skeleton(text: Column) -> Column:
    """What must not change when a plain text is cleaned: its number of lines."""
    return F.concat(F.lit("lines="), F.size(F.split(text, "\n", -1)).cast("string"))


def byte_offset(text: Column, at: Column) -> Column:
    """The UTF-8 offset of a code-point offset."""
    return F.octet_length(F.substring(text, F.lit(1), at))
