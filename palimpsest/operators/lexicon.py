"""Lexical packs: term lists that report, replace or delete, with word boundaries checked after the match.

Terms match on the lower-cased text, the longest of those that start leftmost, and what matched stays consumed even
if its boundary then fails: a longer term that fails does not give way to a shorter one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex

from ..functions.text import any_of, dialect
from .pack_core import PACK
from .rules import LEVELS, Rule

ACTIONS = ("flag", "replace", "delete")
CATEGORIES = ("lexical", "phrasal", "structural", "typographic", "encoding")
_WORD = regex.compile(dialect("[@ALNUM@]", "python"))


@dataclass(frozen=True)
class Spec:
    """One rule of a pack."""

    id: str
    level: int
    action: str = "flag"
    terms: tuple[str, ...] = ()
    replacement: str | None = None
    replacements: dict[str, str] = field(default_factory=dict)

    @property
    def targets(self) -> dict[str, str | None]:
        """Lower-cased term -> replacement; None reports."""
        if self.action == "replace":
            own = {k.lower(): v for k, v in self.replacements.items()}
            return own | ({t.lower(): self.replacement for t in self.terms if t.lower() not in own} if self.replacement else {})
        return dict.fromkeys((t.lower() for t in self.terms), "" if self.action == "delete" else None)


def surface_case(matched: str, new: str) -> str:
    """``new`` in the case of what it replaces: all capitals, a first capital, or as it is."""
    letters = [c for c in matched if c.isalpha()]
    if not new or not letters or not letters[0].isupper():
        return new
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new[0].upper() + new[1:]


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The lower-cased text and, if lengths differ, for each of its boundaries the boundary in ``text``.

    Each character is folded by itself (no final-sigma rule); a boundary inside one character's folding is its start.
    """
    lower = "".join(map(str.lower, text)) if not text.isascii() else text.lower()
    if len(lower) == len(text):
        return lower, None
    at = [0]
    for i, c in enumerate(text):
        at += [i] * (len(c.lower()) - 1) + [i + 1]
    return lower, at


def scanner(spec: Spec):
    targets = spec.targets
    find = regex.compile(any_of(targets))

    def scan(text: str, level: int) -> Iterator[tuple[int, int, str | None]]:
        lower, at = lowered(text)
        for m in find.finditer(lower):
            s, e = m.span() if at is None else (at[m.start()], at[m.end()])
            if s >= e:
                continue
            if _WORD.match(text, s) and s and _WORD.match(text, s - 1) or _WORD.match(text, e - 1) and _WORD.match(text, e):
                continue
            new = targets[m.group()]
            yield s, e, surface_case(text[s:e], new) if spec.action == "replace" and new is not None else new

    return scan


def rules_of(specs: list[Spec]) -> tuple[Rule, ...]:
    """A rule for each entry that has patterns; entries without are dropped."""
    return tuple(
        Rule(s.id, s.level, scan=scanner(s), needles=tuple(s.targets), words=tuple(s.targets))
        for s in specs
        if s.targets
    )


def builtin_specs() -> list[Spec]:
    return [Spec(i, LEVELS[level], terms=tuple(terms)) for i, level, terms in PACK]


def builtin_rules() -> tuple[Rule, ...]:
    return rules_of(builtin_specs())


class PackError(ValueError):
    """A pack that cannot be used, with the reason."""


def parse_pack(text: str) -> list[Spec]:
    """A pack from YAML or, if it opens with a brace, JSON; unknown keys are ignored, everything else is checked."""
    if text.lstrip().startswith("{"):
        pack = json.loads(text)
    else:
        import yaml

        pack = yaml.safe_load(text)
    if not isinstance(pack, dict) or pack.get("schema_version") != 1:
        raise PackError("schema_version must be 1")
    seen, out = set(), []
    for r in pack.get("rules") or []:
        name = r.get("id") or ""
        if not name or name in seen:
            raise PackError(f"rule id {name!r} is empty or not unique")
        seen.add(name)
        action, level = str(r.get("action", "flag")), str(r.get("level", "standard")).lower()
        if action not in ACTIONS:
            raise PackError(f"{name}: unknown action {action!r}")
        if level not in LEVELS:
            raise PackError(f"{name}: unknown level {level!r}")
        spec = Spec(name, LEVELS[level], action, tuple(r.get("terms") or ()), r.get("replacement"), dict(r.get("replacements") or {}))
        if action == "replace" and spec.replacement is None and not spec.replacements:
            raise PackError(f"{name}: replace needs a replacement")
        if any("\n" in v or "\r" in v for v in [spec.replacement or "", *spec.replacements.values()]):
            raise PackError(f"{name}: a replacement holds a line break")
        out.append(spec)
    return out
