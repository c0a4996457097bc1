"""Attribution parameters of chat providers in URLs."""

from __future__ import annotations

from collections.abc import Iterator

import regex

from . import literals as lit

#: A URL in prose, without closing punctuation; and the separators of its query.
URL = regex.compile(r"(?<![A-Za-z0-9_])(?i:https?)://[^\p{White_Space}<>\"'`()\[\]{}]*")
SEPARATOR = regex.compile(r"(&amp;|&)", regex.IGNORECASE)
NAMES = frozenset({"utm_source", "utm_medium", "utm_campaign", "utm_content", "ref", "referrer", "referer"})
PROVIDERS = frozenset(lit.PROVIDERS)


def is_attribution(parameter: str) -> bool:
    """The whole value names a provider: a generic campaign parameter is not an attribution."""
    name, sign, value = parameter.partition("=")
    return bool(sign) and name.lower() in NAMES and value.lower() in PROVIDERS


def cleaned_url(url: str) -> str | None:
    """The URL without attribution parameters, everything else as it stands; None if it has none."""
    head, mark, rest = url.partition("?")
    if not mark:
        return None
    query, hash_, tail = rest.partition("#")
    pieces = SEPARATOR.split(query)
    kept = [("" if i == 0 else pieces[i - 1], p) for i, p in enumerate(pieces) if i % 2 == 0 and not is_attribution(p)]
    if len(kept) == (len(pieces) + 1) // 2:
        return None
    joined = "".join((sep or "&") * (k > 0) + p for k, (sep, p) in enumerate(kept))
    return head + ("?" + joined if kept else "") + hash_ + tail


def found_urls(text: str) -> Iterator[tuple[int, int, str]]:
    for m in URL.finditer(text):
        url = m.group().rstrip(".,;:!")
        new = cleaned_url(url)
        if new is not None:
            yield m.start(), m.start() + len(url), new


def tracking(strip: bool):
    """A scanner that reports such URLs or, if ``strip``, rewrites them."""

    def scan(text: str, level: int) -> Iterator[tuple[int, int, str | None]]:
        return ((s, e, new if strip else None) for s, e, new in found_urls(text))

    return scan
