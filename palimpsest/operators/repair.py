"""Encoding repair: UTF-8 that was read as Windows-1252, and character references."""

from __future__ import annotations

from collections.abc import Iterator

import regex

#: The characters of Windows-1252 outside Latin-1, by byte.
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡",
    0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘",
    0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜",
    0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
BYTE = {chr(b): b for b in range(0x100)} | {c: b for b, c in CP1252.items()}

#: Named character references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ",
    "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "copy": "©",
    "reg": "®", "trade": "™", "deg": "°", "times": "×", "divide": "÷", "plusmn": "±",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "sect": "§", "para": "¶", "dagger": "†",
    "Dagger": "‡", "larr": "←", "rarr": "→", "harr": "↔", "euro": "€", "pound": "£",
    "yen": "¥", "cent": "¢",
}

RUN = 64
REFERENCE = 16


def level_map(level: int) -> dict[str, str]:
    """What a repaired character becomes, so that the result is what the typographic rules would have made of it."""
    from . import rules as r

    out = {c: '"' for c in r.points(*r.DOUBLE_QUOTES)} | {c: "'" for c in r.points(*r.SINGLE_QUOTES)}
    out |= {"…": "...", "‥": ".."}
    out |= {c: "" for c in r.points(*r.INVISIBLE) if not 0x13430 <= ord(c) <= 0x1343F}
    out |= {c: " " for c in r.points(*r.NO_BREAK, *r.EXOTIC_SPACES)}
    if level >= r.STANDARD:
        out["–"] = "-"
    if level >= r.AGGRESSIVE:
        out |= {c: "--" for c in r.points(*r.EM_DASHES)} | r.FULLWIDTH | {chr(c): t for c, t in r.CJK.items()}
    return out


_MAPS: dict[int, dict[int, str]] = {}


def mapped(text: str, level: int) -> str:
    if level not in _MAPS:
        _MAPS[level] = {ord(c): t for c, t in level_map(level).items()}
    return text.translate(_MAPS[level])


def _comma(text: str, s: int, e: int, decoded: str, level: int) -> bool:
    """A decoded dash between spaces takes the comma that the typographic rules give it."""
    from . import rules as r

    dash = decoded == "–" and level >= r.STANDARD or len(decoded) == 1 and ord(decoded) in r.EM_DASHES and level >= r.AGGRESSIVE
    return dash and text[s - 1 : s] == " " and text[e : e + 1] == " "


def _layer(text: str) -> str | None:
    try:
        return bytes([BYTE[c] for c in text]).decode()
    except (KeyError, UnicodeDecodeError):
        return None


def _plausible(text: str) -> bool:
    bad = lambda v: v < 0x20 or 0x7F <= v <= 0x9F or 0xFDD0 <= v <= 0xFDEF or v & 0xFFFE == 0xFFFE or v == 0xFFFD
    return bool(text) and not any(bad(ord(c)) for c in text)


_LEAD = "".join(regex.escape(c) for c, b in BYTE.items() if 0xC2 <= b <= 0xF4)
_TRAIL = "".join(regex.escape(c) for c, b in BYTE.items() if 0x80 <= b <= 0xBF)
_HIGH = "".join(regex.escape(c) for c in BYTE if ord(c) >= 0x80)
DAMAGE = f"[{_LEAD}][{_TRAIL}]"
_DAMAGE, _DAMAGED_RUN = regex.compile(DAMAGE), regex.compile(f"[{_HIGH}]{{1,{RUN}}}")


def mojibake(text: str, level: int) -> Iterator[tuple[int, int, str]]:
    """The longest decodable stretch from each damaged place, decoded up to four times."""
    at = 0
    while m := _DAMAGE.search(text, at):
        s = m.start()
        run = _DAMAGED_RUN.match(text, s).group()
        raw = bytes(BYTE[c] for c in run)
        try:
            n = len(raw)
            raw.decode()
        except UnicodeDecodeError as e:
            n = e.start
        at = s + 1
        damaged = run[:n]
        decoded = _layer(damaged) if n else None
        if decoded is None:
            continue
        for _ in range(3):
            deeper = _layer(decoded)
            if deeper is None or deeper == decoded:
                break
            decoded = deeper
        if not _plausible(decoded) or decoded == damaged:
            continue
        e = s + n
        if _comma(text, s, e, decoded, level):
            yield s - 1, e + 1, ", "
            at = e + 1
            continue
        new = mapped(decoded, level)
        if new != damaged:
            yield s, e, new
            at = e


def referenced(body: str) -> str | None:
    """The character that ``&body;`` stands for."""
    if body in ENTITIES:
        return ENTITIES[body]
    m = _NUMERIC.fullmatch(body)
    if not m:
        return None
    v = int(m.group(2), 16) if m.group(2) else int(m.group(1))
    return chr(v) if v <= 0x10FFFF and not 0xD800 <= v <= 0xDFFF else None


_NUMERIC = regex.compile("#(?:([0-9]{1,8})|[xX]([0-9A-Fa-f]{1,8}))")


def entities(text: str, level: int) -> Iterator[tuple[int, int, str]]:
    """References once decoded; a doubly encoded one stays, as decoding it once would leave another."""
    at = text.find("&")
    while at >= 0:
        body, end = _body(text, at + 1)
        decoded = referenced(body) if body else None
        after = at + 1
        if decoded is not None:
            after = end + 1
            if not (decoded == "&" and _reference_follows(text, after)):
                if _comma(text, at, after, decoded, level):
                    yield at - 1, after + 1, ", "
                else:
                    new = mapped(decoded, level)
                    if new != text[at:after]:
                        yield at, after, new
        at = text.find("&", after)


def _body(text: str, at: int) -> tuple[str, int]:
    """What stands between ``at`` and the next semicolon, if at most REFERENCE bytes, and the semicolon's place."""
    end = text.find(";", at, at + REFERENCE + 1)
    body = text[at:end] if end >= 0 else ""
    return (body if len(body.encode()) <= REFERENCE else ""), end


def _reference_follows(text: str, at: int) -> bool:
    body, _ = _body(text, at)
    return bool(body) and referenced(body) is not None
