"""The rule registry: every rule's identifier, level and what it finds, in registry order.

A rule is data wherever it can be: a pattern that Java and Python both read, and what replaces a match: nothing at all
(report only), a constant, a map of characters, or a function of the match. The few rules whose grammar a pattern
cannot state have a scanner. Plans take the pattern into Catalyst expressions; the engine runs all active rules over a
text at once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import regex

from ..functions.text import any_of, chars, dialect, quoted
from . import literals as lit

LIGHT, STANDARD, AGGRESSIVE = 0, 1, 2
LEVELS = {"light": LIGHT, "l": LIGHT, "standard": STANDARD, "std": STANDARD, "s": STANDARD, "aggressive": AGGRESSIVE, "aggr": AGGRESSIVE, "a": AGGRESSIVE}

#: (start, end, replacement) in code points; a replacement of None only reports.
Found = tuple[int, int, "str | None"]


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the shared dialect; ``replace`` None, a string, a map of characters or a function of the match;
    ``scan`` (text, level) instead of a pattern. A text with a finding holds one of ``needles`` when lower-cased or a
    character of ``signs`` (code points and ranges); with neither given, every text is tried."""

    id: str
    level: int
    pattern: str | None = None
    replace: str | dict[str, str] | Callable[[regex.Match], str] | None = None
    scan: Callable[[str, int], Iterator[Found]] | None = None
    needles: tuple[str, ...] = ()
    signs: tuple = ()
    ignore_case: bool = False
    words: tuple[str, ...] = field(default=(), compare=False)

    @cached_property
    def compiled(self) -> regex.Pattern:
        # ASCII-only folding: the text is lower-cased for A-Z before the match, as in the Catalyst path.
        return regex.compile(dialect(self.pattern, "python"))

    @property
    def java(self) -> str:
        return dialect(self.pattern, "java")

    @property
    def edits(self) -> bool:
        return self.replace is not None or self.id in EDITING_SCANNERS

    def find(self, text: str, lower: str, level: int) -> Iterator[Found]:
        """All findings in a text; ``lower`` is the text with A-Z lower-cased."""
        if self.scan is not None:
            yield from self.scan(text, level)
            return
        for m in self.compiled.finditer(lower if self.ignore_case else text):
            r = self.replace
            if isinstance(r, dict):
                r = r[m.group()]
            elif callable(r):
                r = r(m)
            yield m.start(), m.end(), r


ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

# --- fixed values: characters and what stands for them -------------------------------------------------------------

INVISIBLE = (
    0x200B, 0x2060, 0x00AD, 0xFEFF, 0x180E, 0x034F, (0x2061, 0x2065), (0x206A, 0x206F), (0xFFF0, 0xFFFB),
    (0x1BCA0, 0x1BCA3), (0x180B, 0x180D), 0x180F, (0x1D173, 0x1D182), (0x13430, 0x1343F),
)
NO_BREAK = (0x00A0, 0x202F)
DOUBLE_QUOTES = (0x201C, 0x201D, 0x00AB, 0x00BB, 0x201E, 0x201F, 0x2033, 0x2036, 0x02BA)
SINGLE_QUOTES = (0x2018, 0x2019, 0x201A, 0x201B, 0x2039, 0x203A, 0x02BC, 0x2032, 0x2035, 0x02B9, 0x00B4)
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
ELLIPSES = {0x2026: "...", 0x22EF: "...", 0x2025: ".."}
EM_DASHES = (0x2014, 0x2015, 0x2E3A, 0x2E3B, 0xFE58)
HYPHENS = (0x2010, 0x2011, 0x2012, 0x2043, 0xFE63)
CJK = {
    0x3001: ",", 0xFF64: ",", 0x3002: ".", 0xFF61: ".", 0x300C: '"', 0x300D: '"', 0x300E: '"', 0x300F: '"',
    0xFF62: '"', 0xFF63: '"', 0x301C: "~", 0x30FB: " ", 0xFF65: " ",
}
FILLERS = (0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0)
EXOTIC_SPACES = ((0x2000, 0x200A), 0x205F, 0x3000, 0x1680, 0x2028, 0x2029)
BIDI_OVERRIDES = (0x202D, 0x202E)
BIDI_CONTROLS = ((0x202A, 0x202C), (0x2066, 0x2069), 0x200E, 0x200F, 0x061C)
COMBINING = (
    (0x0300, 0x036F), (0x0483, 0x0489), (0x0591, 0x05BD), 0x05BF, (0x05C1, 0x05C2), (0x05C4, 0x05C7), (0x0610, 0x061A),
    (0x064B, 0x065F), 0x0670, (0x06D6, 0x06DC), 0x0E31, (0x0E34, 0x0E3A), (0x0E47, 0x0E4E), (0x1AB0, 0x1AFF),
    (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F),
)
LETTERLIKE = {
    0x2102: "C", 0x212D: "C", 0x210A: "g", 0x210B: "H", 0x210C: "H", 0x210D: "H", 0x210E: "h", 0x2110: "I", 0x2111: "I",
    0x2112: "L", 0x2113: "l", 0x2115: "N", 0x2119: "P", 0x211A: "Q", 0x211B: "R", 0x211C: "R", 0x211D: "R", 0x2124: "Z",
    0x2128: "Z", 0x212C: "B", 0x212F: "e", 0x2130: "E", 0x2131: "F", 0x2133: "M", 0x2134: "o",
}
NONCHARACTERS = ((0xFDD0, 0xFDEF), 0xFFFC, *((p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17)))

# --- classes built from them ----------------------------------------------------------------------------------------


def points(*parts: int | tuple[int, int]) -> list[str]:
    """The characters of code points and ranges."""
    return [chr(c) for p in parts for c in (range(p[0], p[1] + 1) if isinstance(p, tuple) else (p,))]


def math_ascii(c: str) -> str | None:
    """The ASCII letter or digit that a mathematical alphanumeric stands for: alphabets of 26 and 26, digits of 10."""
    u = ord(c)
    if 0x1D400 <= u < 0x1D6A4:
        k = (u - 0x1D400) % 52
        return chr(0x41 + k) if k < 26 else chr(0x61 + k - 26)
    if 0x1D7CE <= u <= 0x1D7FF:
        return chr(0x30 + (u - 0x1D7CE) % 10)
    return LETTERLIKE.get(u)


LATIN = chars((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))
MATH_POINTS = ((0x1D400, 0x1D6A3), (0x1D7CE, 0x1D7FF), *LETTERLIKE)
LOOKALIKES = ((0x370, 0x3FF), (0x400, 0x4FF), (0x530, 0x58F), (0x13A0, 0x13FF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), *MATH_POINTS)
SELECTORS = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
MATH, HOMOGLYPH, SELECTOR = chars(*MATH_POINTS), chars(*LOOKALIKES), chars(*SELECTORS)
#: From U+2190 on, without variation selectors: bases that a selector may style.
STYLED_BASE = chars((0x2190, 0xFDFF), (0xFE10, 0xE00FF), (0xE01F0, 0x10FFFF))
JOINER, HIDDEN = chars(0x200C, 0x200D), chars((0x200B, 0x200D), 0x2060, 0xFEFF)
PRIVATE = ((0xE000, 0xE1FF), (0xE300, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))
EM, EN = chars(*EM_DASHES), chr(0x2013)
EMOJI_POINTS = ((0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x2B00, 0x2BFF))
EMOJI = chars(*EMOJI_POINTS)
FULLWIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}


def _map(rule_id: str, level: int, mapping: dict[str, str]) -> Rule:
    return Rule(rule_id, level, "[" + "".join(quoted(c) for c in mapping) + "]", mapping, signs=tuple(map(ord, mapping)))


def _each(parts, to: str) -> dict[str, str]:
    return dict.fromkeys(points(*parts), to)


# --- scanners -------------------------------------------------------------------------------------------------------


def _dashes(which: str, tight: str, keep_ranges: bool):
    """A dash between spaces takes both and becomes a comma, any other becomes ``tight``; dashes may share a space."""
    find = regex.compile(f"[{which}]")

    def scan(text: str, level: int) -> Iterator[Found]:
        for m in find.finditer(text):
            i = m.start()
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if keep_ranges and before in _DIGITS and after in _DIGITS:
                continue
            if before == " " == after:
                yield i - 1, i + 2, ", "
            else:
                yield i, i + 1, tight

    return scan


_DIGITS = frozenset("0123456789")


def _independent(words: tuple[str, ...], distinct: bool = False):
    """Every word by itself, so that findings of several words may overlap; in order of place."""

    def scan(text: str, level: int) -> Iterator[Found]:
        lower = text.translate(ASCII_LOWER)
        found = []
        for w in words:
            at = lower.find(w)
            while at >= 0:
                found.append((at, at + len(w), None))
                at = lower.find(w, at + len(w))
        found.sort(key=lambda f: f[:2])
        yield from dict.fromkeys(found) if distinct else found

    return scan


def _controls(m: regex.Match) -> str | None:
    c = m.group()
    return None if c == "�" else " " if c in "\x0b\x0c\x85" else ""


def _confusables(text: str, level: int) -> Iterator[Found]:
    """Words that mix Latin with look-alike letters after the last letter of any other script."""
    for m in _WORDS.finditer(text):
        tail = _TAIL.search(m.group()).group()
        if _HAS_LATIN.search(tail) and _HAS_LOOKALIKE.search(tail):
            yield m.start(), m.end(), None


_WORD = f"[@ALNUM@{HOMOGLYPH}]+"
_WORDS = regex.compile(dialect(_WORD, "python"))
_TAIL = regex.compile(f"[{LATIN}{HOMOGLYPH}0-9]*$")
_HAS_LATIN, _HAS_LOOKALIKE = regex.compile(f"[{LATIN}]"), regex.compile(f"[{HOMOGLYPH}]")


def between(text: str, opener: str, closer: str) -> Iterator[tuple[int, int]]:
    """Stretches from an opener to the next closer, both included, each behind the one before. An opener without a closer
    ends the search, as no later one has any, so a text of openers is gone through once."""
    at = text.find(opener)
    while at >= 0 and (end := text.find(closer, at + len(opener))) >= 0:
        yield at, end + len(closer)
        at = text.find(opener, end + len(closer))


#: All listed tokens as one text, and lower-cased ones: what is a part of a listed token or equals one is not reported.
_LISTED = "\n".join((*lit.CHAT_TOKENS, *lit.TOOL_CALLS))
_LISTED_LOWER = frozenset(_LISTED.lower().split("\n"))
_ASCII_INNER = regex.compile(r"[A-Za-z0-9_.-]{1,64}")
_WIDE_INNER = regex.compile(r"(?=.*[▁_])[^\p{White_Space}\p{Cc}]{1,64}")


def _special_tokens(text: str, level: int) -> Iterator[Found]:
    """Token-shaped markers that no list knows; the search goes on behind a closer even if what it closed is none."""
    found = []
    for opener, closer, inner in (("<|", "|>", _ASCII_INNER), ("｜", "｜", _WIDE_INNER)):
        for s, e in between(text, opener, closer):
            # Two marks, 64 characters and no more.
            token = text[s:e] if e - s <= 70 else ""
            if inner.fullmatch(token[len(opener) : -len(closer)]) and token not in _LISTED and token.lower() not in _LISTED_LOWER:
                found.append((s, e, None))
    yield from sorted(found, key=lambda f: f[:2])


#: One citation identifier: a turn, a kind, a number, and lines of it. A kind or line that goes on is none.
_TURN = r"turn[0-9]+[a-z]{1,32}(?<![a-z]{33})[0-9]+(?:l[0-9]+(?:-l[0-9]+)?)?"
TURNS = rf"(?:{_TURN})+(?![A-Za-z0-9_])"
_TURNS_AT = regex.compile(rf"(?:(?<![a-z0-9_])(?:file)?cite|(?<![a-z0-9_]))({TURNS})")
_TURN_ID, _LINES = regex.compile(TURNS), regex.compile("l[0-9]+(?:-l[0-9]+)?")


def _turn_ranges(text: str) -> Iterator[tuple[int, int]]:
    covers = [_covered(text, a, b) for a, b in (("\ue200", "\ue201"), ("【", "】"))]
    for m in _TURNS_AT.finditer(text.translate(ASCII_LOWER)):
        if not any(inside(*m.span()) for inside in covers):
            yield m.span()


def _covered(text: str, opener: str, closer: str) -> Callable[[int, int], bool]:
    """Whether a range stands between the last opener before it and the first closer behind that opener."""
    opens, closes = ([m.start() for m in regex.finditer(c, text)] for c in (opener, closer))

    def inside(s: int, e: int) -> bool:
        k = bisect_right(opens, s - 1)
        j = bisect_left(closes, opens[k - 1]) if k else len(closes)
        return j < len(closes) and closes[j] >= e

    return inside


def _turn_citations(replace: str | None):
    def scan(text: str, level: int) -> Iterator[Found]:
        return ((s, e, replace) for s, e in _turn_ranges(text))

    return scan


def _openers(text: str, opener: str, closer: str) -> Iterator[tuple[int, int]]:
    """Every opener with the first closer behind it, -1 for none; closers are searched once."""
    end = text.find(closer)
    for m in regex.finditer(opener, text):
        if 0 <= end < m.start():
            end = text.find(closer, m.start())
        yield m.start(), end


def _bracket_citations(text: str, level: int) -> Iterator[Found]:
    for at, end in _openers(text, "【", "】"):
        inner = text[at + 1 : end].translate(ASCII_LOWER) if 0 <= end - at - 1 <= 512 else ""
        if "†" in inner or any(w in inner for w in ("source", "web", "turn", "cite")):
            yield at, end + 1, None


def _bracket_citations_strip(text: str, level: int) -> Iterator[Found]:
    for s, e in between(text, "【", "】"):
        if e - s <= 514 and _machine_made(text[s + 1 : e - 1].translate(ASCII_LOWER)):
            yield s, e, ""


def _machine_made(inner: str) -> bool:
    """A bare turn identifier, or a cite family with identifiers and at most a last line locator; never a dagger."""
    if "†" in inner:
        return False
    family, *parts = inner.split("|")
    if not parts:
        return bool(_TURN_ID.fullmatch(family))
    if family not in ("cite", "filecite"):
        return False
    ids = [bool(_TURN_ID.fullmatch(p)) for p in parts]
    return any(ids) and (all(ids) or all(ids[:-1]) and bool(_LINES.fullmatch(parts[-1])))


def _private_citations(strip: bool):
    def scan(text: str, level: int) -> Iterator[Found]:
        behind = 0
        for at, close in _openers(text, "\ue200", "\ue201"):
            if at < behind:
                continue
            whole = text[at : close + 1] if 0 <= close - at < 512 else ""
            ends = bool(whole) and len(whole.encode()) <= 512 and "\n" not in whole and "\r" not in whole
            behind = close + 1 if ends else at + 1
            if not strip:
                yield at, behind, None
            elif ends and _private_fits(whole[1:-1].split("\ue202")):
                yield at, behind, ""

    return scan


def _private_fits(parts: list[str]) -> bool:
    family, *ids = parts
    return family in ("cite", "filecite") and bool(ids) and all(_SOURCE_ID.fullmatch(p) for p in ids)


_SOURCE_ID = regex.compile("[A-Za-z0-9_-]+")


def _gemini(strip: bool):
    def scan(text: str, level: int) -> Iterator[Found]:
        for m in _GEMINI.finditer(text.translate(ASCII_LOWER)):
            s, e = m.span()
            if strip and m.group(1) and text[s - 1 : s] == " " and text[e : e + 1] in tuple(".,;:!?"):
                s -= 1
            yield s, e, "" if strip else None

    return scan


GEMINI = r"\[cite_start\]|\[cite_end\]|\[cite:(?=[ ,:-]*[0-9])([0-9 ,:-]{1,128})\]"
_GEMINI = regex.compile(GEMINI)


def _trailer_lines(text: str, level: int) -> Iterator[Found]:
    """Trailer lines, of 200 bytes at most, that name an agent and are not listed whole."""
    behind: dict[str, int] = {}
    for m in _TRAILER.finditer(text.translate(ASCII_LOWER)):
        start, line = m.start(), text[m.start() : m.end(1)].encode()[:200].decode(errors="ignore")
        if start < behind.get(m.group(2), 0):
            continue
        behind[m.group(2)] = start + len(line)
        low = line.translate(ASCII_LOWER)
        if any(n in low for n in lit.AGENT_NAMES) and not any(t in low for t in lit.AGENT_TRAILERS):
            yield start, start + len(line.rstrip()), None


_TRAILER = regex.compile(r"(?=((co-authored-by:|generated-by:|assisted-by:)[^\n]{0,200}+))")


def _reasoning_blocks(text: str, level: int) -> Iterator[Found]:
    lower, at = text.translate(ASCII_LOWER), 0
    while at < len(lower) and (m := _OPENER.search(lower, at)):
        end = _CLOSER.search(lower, m.end())
        at = end.end() if end else len(text)
        yield m.start(), at, None


_OPENER, _CLOSER = regex.compile(any_of(lit.REASONING_OPENERS)), regex.compile(any_of(lit.REASONING_CLOSERS))


def _provenance_frame(text: str, level: int) -> Iterator[Found]:
    """An invisible provenance frame of variation selectors, whole: its magic, a version of 1 or 2, a length."""
    for m in _FRAME.finditer(text):
        raw = bytes(ord(c) - 0xFE00 if ord(c) < 0xE0000 else ord(c) - 0xE0100 + 0x10 for c in m.group(1))
        if len(raw) >= 13 and raw.startswith(b"C2PATXT\0") and raw[8] in (1, 2):
            yield *m.span(), ""


_FRAME = regex.compile(f"\ufeff?([{SELECTOR}]+)")


def _provenance_blocks(strip: bool):
    def scan(text: str, level: int) -> Iterator[Found]:
        for s, e in between(text, BLOCK_BEGIN, BLOCK_END):
            inner = text[s + len(BLOCK_BEGIN) : e - len(BLOCK_END)].strip()
            if inner and len(inner.encode()) <= 262_144 and not (strip and ("\n" in text[s:e] or "\r" in text[s:e])):
                yield s, e, "" if strip else None

    return scan


BLOCK_BEGIN, BLOCK_END = "-----BEGIN C2PA MANIFEST-----", "-----END C2PA MANIFEST-----"


def _markdown_residue(text: str, level: int) -> Iterator[Found]:
    found = [(i, i + len(n), None) for n in ("**", "__", "~~", "```") for i in _places(text, n)]
    found += [(*m.span(1), None) for m in _HEADING.finditer(text)]
    yield from sorted(found, key=lambda f: f[:2])


_HEADING = regex.compile(r"(?m)^[^\S\n]*+(#{1,6})(?= )")


def _places(text: str, needle: str) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        yield at
        at = text.find(needle, at + len(needle))


def _placeholders(text: str, level: int) -> Iterator[Found]:
    lower = text.translate(ASCII_LOWER)
    found = []
    for s, e in between(lower, "[", "]"):
        inner = lower[s + 1 : e - 1] if e - s <= 66 else ""
        bare = inner.strip()
        if bare and not _BREAK.search(inner) and (bare.startswith(lit.PLACEHOLDER_OPENERS) or bare in lit.PLACEHOLDER_WHOLE):
            found.append((s, e, None))
    found += [(i, i + 11, None) for i in _places(lower, "lorem ipsum")]
    found += [(*m.span(), None) for m in _MASKED.finditer(text)]
    yield from sorted(found, key=lambda f: f[:2])


_BREAK, _MASKED = regex.compile(r"[\r\n]"), regex.compile("(?<=[0-9])[-/]XX+")


def _title_case(text: str, level: int) -> Iterator[Found]:
    bare = text.strip()
    if bare and len(bare.encode()) <= 120 and _is_title(bare):
        start = len(text) - len(text.lstrip())
        yield start, start + len(bare), None


def _is_title(line: str) -> bool:
    words = line.split()
    if "\n" in line or "\r" in line or line.endswith(tuple(".!?,;:")) or not 3 <= len(words) <= 12:
        return False
    significant = capital = 0
    for k, word in enumerate(words):
        letters = "".join(_ALPHABETIC.findall(word))
        if not letters:
            continue
        small = letters.lower() in lit.SMALL_WORDS
        if len(letters) < 2 and not small or len(letters) > 1 and not any(c.islower() for c in letters):
            return False
        if k == 0 or not small:
            significant += 1
            capital += letters[0].isupper()
    return significant >= 3 and capital * 5 >= significant * 4


_ALPHABETIC = regex.compile(r"\p{Alphabetic}")
#: A list line that opens with a bold label.
INLINE_HEADER = r"^[^\S\n]*+(?:(?:[-*•–—] |[0-9]+[.)] ))?\*\*((?:(?!\*\*)[^\r\n]){1,80})\*\*(?:$|[:. —-])"
_INLINE_HEADER = regex.compile(INLINE_HEADER)


def _inline_headers(text: str, level: int) -> Iterator[Found]:
    start, end, items, at = None, 0, 0, 0
    for line in text.split("\n"):
        if _INLINE_HEADER.search(line):
            start = at if start is None else start
            end, items = at + len(line.rstrip()), items + 1
        else:
            if items >= 3:
                yield start, end, None
            start, items = None, 0
        at += len(line) + 1
    if items >= 3:
        yield start, end, None


def _emoji_sentences(text: str, level: int) -> Iterator[Found]:
    """Sentences end behind ``.``, ``!`` or ``?`` with closing marks and white space, or at a line end: a documented
    approximation of the Unicode rule."""
    for m in _SENTENCE.finditer(text):
        if len(_ONE_EMOJI.findall(m.group())) >= 3:
            yield *m.span(), None


_ONE_EMOJI = regex.compile(f"[{EMOJI}]")
_SENTENCE = regex.compile(r"(?s)[^.!?\r\n\u2028\u2029\x85]*+(?:[.!?]++[\"')\]”’]*+\p{White_Space}*+|[\r\n\u2028\u2029\x85]|(?!.))(?<=.)")


def _literal(rule_id: str, level: int, words: tuple[str, ...], replace: str | None = None) -> Rule:
    lower = tuple(w.translate(ASCII_LOWER) for w in words)
    return Rule(rule_id, level, any_of(lower), replace, needles=tuple(w.lower() for w in words), ignore_case=True, words=lower)


def _scanned(rule_id: str, level: int, scan, needles: tuple[str, ...] = (), signs: tuple = ()) -> Rule:
    return Rule(rule_id, level, scan=scan, needles=needles, signs=signs)


#: Scanners whose findings replace text.
EDITING_SCANNERS = frozenset(
    {
        "markers.c2pa-text-manifest", "markers.c2pa-structured-manifest.strip", "typo.mojibake.repair", "typo.html-entities.decode",
        "typo.en-dash.to-hyphen", "typo.em-dash.to-comma", "markers.gemini-citations.strip", "markers.ai-tracking-urls.strip",
        "markers.private-use-citations.strip", "markers.turn-citations.strip", "markers.citation-brackets.strip",
    }
)

ANSI = (
    r"\x1b\[[\x20-\x3f]*+[\x40-\x7e]|\x1b[\]PX^_][^\x07\n\r\x1b]{0,4093}(?:\x07|\x1b\\)"
    r"|\x1b(?![\[\]PX^_])[\x20-\x2f]*+[\x30-\x7e]"
)
CONTROL_POINTS = ((0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F), *NONCHARACTERS, 0xFFFD)
CONTROLS = "[" + chars(*CONTROL_POINTS) + "]"
DETOKENIZER = "\u2581|(?<=[\\x21-\\x7e])[\u0120\u010A](?=[A-Za-z])"
SMUGGLED = f"[{chars((0xE0000, 0xE00FF), (0xE01F0, 0xE0FFF))}]|(?!\ufe0f\u20e3)(?<![{STYLED_BASE}])[{SELECTOR}]"
ZERO_WIDTH = f"(?<![{JOINER}])[{JOINER}](?:(?<=[A-Za-z0-9][{JOINER}])(?=[A-Za-z0-9])|(?<=[{HIDDEN}][{JOINER}])|(?=[{HIDDEN}]))"
STEGO = r"(?<=[^ \t\r\n])(?= *+\t)[ \t]++(?![^\r\n])"
STYLED = f"(?<![{MATH}{LATIN}])[{MATH}]{{2,}}+(?![{LATIN}])"
LEGACY = r"(?:(?:::)?contentreference)?(?:\[oaicite:[0-9]+\]|\(oaicite:[0-9]+\))(?:\{index=[0-9]+\}|(?!\{index=))"
DATE_LINE = r"(?:(?<=[\r\n])|(?<!.))Today(?:'s date is ([0-9]{4})/([0-9]{2})/([0-9]{2})|[’ʼʹ]s date is ([0-9]{4})(?:-([0-9]{2})-|/([0-9]{2})/)([0-9]{2}))\.(?![^\r\n])"
REPEATED = "[!?]{2,}"
DETOKENIZED = r"(?<=[@ALNUM@]) (?:[,!?;]|\.(?!\.)|:(?![0-9]))"
OPENER = "^[@SPACE@]*+([" + "".join(lit.DECORATION) + "])(?=[@SPACE@:|—\ufe0f-]|$(?!.))"


def _plain_date(m: regex.Match) -> str:
    return "Today's date is " + "-".join(g for g in m.groups() if g) + "."


def builtin() -> tuple[Rule, ...]:
    """All rules in registry order, the lexical pack last."""
    from . import lexicon, repair, urls

    quotes = {**_each(DOUBLE_QUOTES, '"'), **_each(SINGLE_QUOTES, "'")}
    L, S, A = LIGHT, STANDARD, AGGRESSIVE
    trail = tuple(ord(c) for c, b in repair.BYTE.items() if 0x80 <= b <= 0xBF)
    brackets, pills, heads = (0x3010,), (0xE200,), ("# ",)
    rules = (
        _scanned("markers.c2pa-text-manifest", L, _provenance_frame, signs=SELECTORS),
        _scanned("typo.mojibake.repair", S, repair.mojibake, signs=trail),
        _scanned("typo.html-entities.decode", S, repair.entities, ("&",)),
        _map("typo.invisibles.strip", L, {**_each(INVISIBLE, ""), **_each(NO_BREAK, " ")}),
        Rule("unicode.ansi.strip", L, ANSI, "", signs=(0x1B,)),
        Rule("unicode.controls.strip", L, CONTROLS, _controls, signs=CONTROL_POINTS),
        Rule("unicode.smuggled.strip", L, SMUGGLED, "", signs=(*SELECTORS, (0xE0000, 0xE00FF), (0xE01F0, 0xE0FFF))),
        _map("unicode.fillers.strip", S, _each(FILLERS, "")),
        _map("unicode.spaces.normalize", S, _each(EXOTIC_SPACES, " ")),
        _map("unicode.bidi.strip-overrides", S, _each(BIDI_OVERRIDES, "")),
        Rule("unicode.bidi.flag", A, f"[{chars(*BIDI_CONTROLS)}]", signs=BIDI_CONTROLS),
        Rule("unicode.private-use.flag", S, f"[{chars(*PRIVATE)}]+", signs=PRIVATE),
        Rule("unicode.private-use.strip", A, f"[{chars((0xE203, 0xE2FF))}]", "", signs=((0xE203, 0xE2FF),)),
        Rule("unicode.combining.flag", A, f"[{chars(*COMBINING)}]{{3,}}", signs=COMBINING),
        Rule("unicode.zero-width.flag", S, ZERO_WIDTH, signs=(0x200C, 0x200D)),
        Rule("unicode.zero-width.strip", A, ZERO_WIDTH, "", signs=(0x200C, 0x200D)),
        Rule("unicode.whitespace-stego.flag", S, STEGO, signs=(0x09,)),
        Rule("unicode.whitespace-stego.strip", A, STEGO, "", signs=(0x09,)),
        Rule("unicode.math-styled.flag", S, STYLED, signs=MATH_POINTS),
        Rule("unicode.math-styled.normalize", A, STYLED, lambda m: "".join(map(math_ascii, m.group())), signs=MATH_POINTS),
        _scanned("unicode.confusables.flag", A, _confusables, signs=LOOKALIKES),
        _map("typo.quotes.straighten", S, quotes),
        _map("typo.ligatures.expand", S, {chr(c): t for c, t in LIGATURES.items()}),
        _map("typo.ellipsis.expand", S, {chr(c): t for c, t in ELLIPSES.items()}),
        Rule("typo.hyphens.normalize", S, f"[{chars(*HYPHENS)}]|(?<=[0-9])\u2212|\u2212(?=[0-9])", "-", signs=(*HYPHENS, 0x2212)),
        _scanned("typo.en-dash.to-hyphen", S, _dashes(EN, "-", False), signs=(0x2013,)),
        _scanned("typo.em-dash.to-comma", A, _dashes(EM, "--", True), signs=EM_DASHES),
        _map("typo.fullwidth.normalize", A, FULLWIDTH),
        _map("typo.cjk-punctuation.normalize", A, {chr(c): t for c, t in CJK.items()}),
        Rule("typo.detokenizer.normalize", A, DETOKENIZER, " ", signs=(0x2581, 0x0120, 0x010A)),
        _literal("markers.chat-tokens", L, lit.CHAT_TOKENS),
        _scanned("markers.chat-tokens.pattern", L, _special_tokens, ("<|",), (0xFF5C,)),
        _literal("markers.citation-artifacts", L, lit.CITATION_ARTIFACTS),
        _scanned("markers.citation-brackets", L, _bracket_citations, signs=brackets),
        _scanned("markers.private-use-citations", L, _private_citations(False), signs=pills),
        _scanned("markers.turn-citations", L, _turn_citations(None), ("turn",)),
        _scanned("markers.gemini-citations", L, _gemini(False), ("[cite",)),
        _scanned("markers.gemini-citations.strip", A, _gemini(True), ("[cite",)),
        _scanned("markers.c2pa-structured-manifest", L, _provenance_blocks(False), ("begin c2pa manifest",)),
        _scanned("markers.c2pa-structured-manifest.strip", A, _provenance_blocks(True), ("begin c2pa manifest",)),
        _scanned("markers.ai-tracking-urls", L, urls.tracking(False), ("http",)),
        _scanned("markers.ai-tracking-urls.strip", A, urls.tracking(True), ("http",)),
        _scanned("markers.private-use-citations.strip", A, _private_citations(True), signs=pills),
        _scanned("markers.turn-citations.strip", A, _turn_citations(""), ("turn",)),
        _scanned("markers.citation-brackets.strip", A, _bracket_citations_strip, signs=brackets),
        Rule("markers.legacy-citations.strip", A, LEGACY, "", needles=("oaicite:",), ignore_case=True),
        Rule("markers.claude-prompt-fingerprint", L, DATE_LINE, _plain_date, needles=("s date is",)),
        _literal("markers.agent-trailers", L, lit.AGENT_TRAILERS),
        _scanned("markers.agent-trailer-lines", L, _trailer_lines, ("-by:", "ated-by:")),
        _literal("markers.tool-calls", L, lit.TOOL_CALLS),
        _scanned("markers.reasoning-block", S, _reasoning_blocks, lit.REASONING_OPENERS),
        _scanned("markers.reasoning-trace", S, _independent(lit.REASONING_TRACES), lit.REASONING_TRACES),
        _literal("markers.chat-tokens.strip", A, lit.CHAT_TOKENS_REMOVED, ""),
        _literal("markers.model-identifiers", A, lit.MODEL_IDENTIFIERS),
        _literal("markers.chat-ui-disclaimer", L, lit.UI_DISCLAIMERS),
        _literal("markers.chat-ui-residue", S, lit.UI_RESIDUE),
        _literal("markers.chat-ui-disclaimer.strip", A, lit.UI_DISCLAIMERS, ""),
        _scanned("markers.html-tags", S, _independent(lit.HTML_TAGS, True), lit.HTML_TAGS),
        Rule("style.emoji.opener", A, OPENER, signs=tuple(map(ord, lit.DECORATION))),
        _scanned("style.emoji.density", A, _emoji_sentences, signs=EMOJI_POINTS),
        _scanned("style.markdown.residue", A, _markdown_residue, ("**", "__", "~~", "```", *heads)),
        Rule("style.punctuation.repeated", A, REPEATED, needles=("!!", "!?", "?!", "??")),
        Rule("style.spacing.detokenized", A, DETOKENIZED, needles=(" ,", " .", " !", " ?", " ;", " :")),
        _scanned("style.placeholder.residue", S, _placeholders, ("[", "-xx", "/xx", "lorem ipsum")),
        _scanned("style.heading.title-case", A, _title_case),
        _scanned("style.list.inline-headers", A, _inline_headers, ("**",)),
    )
    return rules + lexicon.builtin_rules()
