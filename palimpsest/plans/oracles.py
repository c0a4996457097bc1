"""What each rule finds, stated for DuckDB from the rules' meaning: RE2 has no look-around, so context is counted apart."""

from __future__ import annotations

from ..functions.text import any_of
from ..operators import literals as lit
from ..operators import repair
from ..operators import rules as R
from ..operators.lexicon import builtin_specs
from .injection import literal, sql

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = f"translate(t, '{_UP}', '{_LOW}')"


def re2(*parts) -> str:
    """The inside of an RE2 class."""
    one = lambda c: f"\\x{{{c:X}}}"
    return "".join(f"{one(p[0])}-{one(p[1])}" if isinstance(p, tuple) else one(p) for p in parts)


def count(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, {literal(pattern)}))"


def held(characters: str) -> str:
    """How many of the text's characters are among these."""
    return f"(length(t) - length(translate(t, {literal(characters)}, '')))"


def _mapped(mapping: dict[str, str]) -> tuple[str, str]:
    one = {c: s for c, s in mapping.items() if len(s) == 1}
    gone = "".join(c for c, s in mapping.items() if not s)
    new = f"translate(t, {literal(''.join(one) + gone)}, {literal(''.join(one.values()))})"
    for c, s in mapping.items():
        if len(s) > 1:
            new = f"replace({new}, {literal(c)}, {literal(s)})"
    return held("".join(mapping)), new


def _occurrences(words) -> str:
    """All occurrences of each word by itself."""
    return " + ".join(f"(length(l) - length(replace(l, {literal(w)}, ''))) // {len(w)}" for w in dict.fromkeys(words))


_SELECTOR = re2((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
#: The magic C2PATXT and a zero, byte by byte as variation selectors, a version of 1 or 2, four bytes of length or more.
FRAME_RE2 = r"\x{FEFF}?\x{E0133}\x{E0122}\x{E0140}\x{E0131}\x{E0144}\x{E0148}\x{E0144}\x{FE00}[\x{FE01}\x{FE02}]" + f"[{_SELECTOR}]{{4,}}"
BLOCK_RE2 = r"-----BEGIN C2PA MANIFEST-----\s*[^\s\r\n-][^\r\n]*?-----END C2PA MANIFEST-----"
#: Sequences of two to four bytes that were read as Windows-1252, side by side.
_TRAIL = re2((0xA0, 0xBF), 0x20AC, 0x201A, 0x192, 0x201E, 0x2026, 0x2020, 0x2021, 0x2C6, 0x2030, 0x160, 0x2039, 0x152, 0x17D, 0x2018, 0x2019, 0x201C, 0x201D,
             0x2022, 0x2013, 0x2014, 0x2DC, 0x2122, 0x161, 0x203A, 0x153, 0x17E, 0x178)
DAMAGED_RE2 = f"(?:[\\x{{C2}}-\\x{{DF}}][{_TRAIL}]|[\\x{{E0}}-\\x{{EF}}][{_TRAIL}]{{2}}|[\\x{{F0}}-\\x{{F4}}][{_TRAIL}]{{3}})+"
HEADER_RE2 = r"^[ \t\r]*(?:(?:[-*•–—] |[0-9]+[.)] ))?\*\*(?:[^*\r\n]|\*[^*\r\n]){1,80}\*\*(?:$|[:. —-])"
SENTENCE_RE2 = r"""[^.!?\r\n\x{2028}\x{2029}\x{85}]*(?:[.!?]+["')\]”’]*\s*|[\r\n\x{2028}\x{2029}\x{85}]|\z)"""
_SMALL = ", ".join(f"'{w}'" for w in lit.SMALL_WORDS)
_BARE = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')"
#: A short line of three to twelve words, most significant ones capitalised, none in capitals or of one letter.
TITLE = f"""(SELECT CASE WHEN strlen(b) BETWEEN 1 AND 120 AND NOT regexp_matches(b, '[\\r\\n]|[.!?,;:]$') AND len(w) BETWEEN 3 AND 12
  AND len(list_filter(g, lambda x: (length(x.l) < 2 AND NOT x.small) OR (length(x.l) > 1 AND NOT regexp_matches(x.l, '\\p{{Ll}}')))) = 0
  AND len(list_filter(g, lambda x: x.k = 1 OR NOT x.small)) >= 3
  AND 5 * len(list_filter(g, lambda x: (x.k = 1 OR NOT x.small) AND regexp_matches(x.l, '^\\p{{Lu}}'))) >= 4 * len(list_filter(g, lambda x: x.k = 1 OR NOT x.small))
  THEN 1 ELSE 0 END FROM (SELECT b, w, list_filter(list_transform(range(1, len(w) + 1), lambda k: {{'k': k, 'l': regexp_replace(w[k], '[^\\p{{L}}]', '', 'g'),
    'small': lower(regexp_replace(w[k], '[^\\p{{L}}]', '', 'g')) IN ({_SMALL})}}), lambda x: x.l <> '') AS g
  FROM (SELECT b, string_split_regex(b, '\\s+') AS w FROM (SELECT {_BARE} AS b))))"""


def rule_expressions() -> dict[str, tuple[str, str | None]]:
    """Rule id -> (expression of the number of findings, expression of the cleaned text if stated)."""
    from ..operators.rules import builtin

    out: dict[str, tuple[str, str | None]] = {}
    for r in builtin():
        if isinstance(r.replace, dict):
            out[r.id] = _mapped(r.replace)
        elif r.words and r.pattern:
            out[r.id] = (count(any_of(r.words), LOWER), None)
    cls = lambda p: f"[{re2(*p)}]"
    styled = re2((0x2190, 0xD7FF), (0xE000, 0xFDFF), (0xFE10, 0xE00FF), (0xE01F0, 0x10FFFF))
    sel, math, latin = re2(*R.SELECTORS), re2(*R.MATH_POINTS), re2((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))
    look = re2(*R.LOOKALIKES)
    em, entity = cls(R.EM_DASHES), "(?:" + "|".join(repair.ENTITIES) + "|#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,8});"
    word_tail = f"regexp_extract(w, {literal(f'[{latin}{look}0-9]*$')})"
    turns = r"(?:^|[^a-z0-9_])(?:(?:file)?cite)?(?:turn[0-9]+[a-z]{1,32}[0-9]+(?:l[0-9]+(?:-l[0-9]+)?)?)+(?:[^a-z0-9_]|$)"
    loose = f"regexp_replace(regexp_replace({LOWER}, {literal(r'\x{E200}[^\x{E201}]*\x{E201}')}, ' ', 'g'), {literal('【[^】]*】')}, ' ', 'g')"
    tracked = r"(?i)[?&](?:utm_source|utm_medium|utm_campaign|utm_content|ref|referrer|referer)=(?:" + any_of(lit.PROVIDERS) + r")(?:[&#]|$)"
    urls = f"regexp_extract_all(t, {literal(r'(?i)https?://[^\s<>"\'`()\[\]{}]*')})"
    spaced = f"regexp_replace(regexp_replace(t, ' \\.\\.', ' ' || chr(2), 'g'), ' :([0-9])', ' ' || chr(3) || '\\1', 'g')"
    joiners = (
        "len(list_filter(range(1, len(c) + 1), lambda i: c[i] IN (chr(8204), chr(8205)) AND NOT (i > 1 AND c[i - 1] IN (chr(8204), chr(8205))) AND "
        "((i > 1 AND regexp_full_match(c[i - 1], '[A-Za-z0-9]') AND regexp_full_match(coalesce(c[i + 1], ''), '[A-Za-z0-9]')) OR "
        f"(i > 1 AND regexp_full_match(c[i - 1], {literal(cls(((0x200B, 0x200D), 0x2060, 0xFEFF)))})) OR "
        f"regexp_full_match(coalesce(c[i + 1], ''), {literal(cls(((0x200B, 0x200D), 0x2060, 0xFEFF)))}))))"
    )
    known = "[" + ", ".join(literal(k.lower()) for k in (*lit.CHAT_TOKENS, *lit.TOOL_CALLS)) + "]"
    tokens = (
        f"len(list_filter(regexp_extract_all(t, {literal(r'(?s)<\|.*?\|>')}), lambda x: regexp_full_match(x, {literal(r'<\|[A-Za-z0-9_.-]{1,64}\|>')}) "
        f"AND len(list_filter({known}, lambda k: contains(k, lower(x)))) = 0)) + "
        f"len(list_filter(regexp_extract_all(t, '｜[^｜]{{1,64}}｜'), lambda x: regexp_matches(x, '[▁_]') AND NOT regexp_matches(x, '[\\s\\p{{Cc}}]') "
        f"AND len(list_filter({known}, lambda k: contains(k, lower(x)))) = 0))"
    )
    trailers, agents = (
        "(" + " OR ".join(f"contains(x, {literal(w)})" for w in words) + ")" for words in (lit.AGENT_TRAILERS, lit.AGENT_NAMES)
    )
    lines = f"regexp_extract_all({LOWER}, {literal('(?:co-authored-by:|generated-by:|assisted-by:)[^' + chr(10) + ']*')})"
    out |= {
        "unicode.ansi.strip": (count(r"\x1b\[[\x20-\x3f]*[\x40-\x7e]|\x1b[\]PX^_][^\x07\n\r\x1b]*(?:\x07|\x1b\\)|\x1b(?:[\x20-\x2f]+[\x30-\x7e]|[\x30-\x4f\x51-\x57\x59\x5a\x5c\x60-\x7e])"), None),
        "unicode.controls.strip": (count(cls(R.CONTROL_POINTS)), None),
        "unicode.smuggled.strip": (
            f"({count(f'[{re2((0xE0000, 0xE00FF), (0xE01F0, 0xE0FFF))}]')} + {count(f'[{sel}]')} - {count(f'[{styled}][{sel}]')} - {count(f'[^{styled}]' + r'\x{FE0F}\x{20E3}')})",
            None,
        ),
        "unicode.bidi.flag": (count(cls(R.BIDI_CONTROLS)), None),
        "unicode.private-use.flag": (count(cls(R.PRIVATE) + "+"), None),
        "unicode.private-use.strip": (count(cls(((0xE203, 0xE2FF),))), f"regexp_replace(t, {literal(cls(((0xE203, 0xE2FF),)))}, '', 'g')"),
        "unicode.combining.flag": (count(cls(R.COMBINING) + "{3,}"), None),
        "unicode.zero-width.flag": (joiners, None),
        "unicode.zero-width.strip": (joiners, None),
        "unicode.whitespace-stego.flag": (count(r"[^ \t\r\n][ \t]*\t[ \t]*(?:[\r\n]|$)"), None),
        "unicode.whitespace-stego.strip": (
            count(r"[^ \t\r\n][ \t]*\t[ \t]*(?:[\r\n]|$)"), f"regexp_replace(t, {literal(r'([^ \t\r\n])[ \t]*\t[ \t]*([\r\n]|$)')}, '\\1\\2', 'g')",
        ),
        "unicode.math-styled.flag": (f"len(list_filter(regexp_extract_all(t, {literal(f'[{latin}{math}]+')}), lambda w: regexp_full_match(w, {literal(f'[{math}]{{2,}}')})))", None),
        "unicode.confusables.flag": (
            f"len(list_filter(regexp_extract_all(t, {literal('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + look + ']+')}), lambda w: regexp_matches({word_tail}, {literal(f'[{latin}]')}) AND regexp_matches({word_tail}, {literal(f'[{look}]')})))",
            None,
        ),
        "typo.hyphens.normalize": (f"({held(''.join(R.points(*R.HYPHENS)))} + {count('[0-9]−')} + {count('−[0-9]')} - {count('[0-9]−[0-9]')})", None),
        "typo.en-dash.to-hyphen": (held("–"), "replace(replace(t, ' – ', ', '), '–', '-')"),
        "typo.em-dash.to-comma": (f"({count(em)} - {count(f'[0-9]{em}[0-9]')})", None),
        "typo.detokenizer.normalize": (f"({held('▁')} + {count(r'[\x21-\x7e][ĠĊ][A-Za-z]')})", None),
        "typo.html-entities.decode": (f"({count('&' + entity)} - {count('&amp;' + entity)})", None),
        "markers.chat-tokens.pattern": (tokens, None),
        "markers.citation-brackets": (f"len(list_filter(regexp_extract_all(t, '【[^】]*】'), lambda x: contains(x, '†') OR regexp_matches(lower(x), 'source|web|turn|cite')))", None),
        "markers.citation-brackets.strip": (count(r"【(?:(?:cite|filecite)(?:\|turn[0-9]+[a-z]{1,32}[0-9]+)+(?:\|l[0-9]+(?:-l[0-9]+)?)?|turn[0-9]+[a-z]{1,32}[0-9]+)】", LOWER), None),
        "markers.private-use-citations": (count(r"\x{E200}(?:[^\x{E201}\r\n]*\x{E201})?"), None),
        "markers.private-use-citations.strip": (count(r"\x{E200}(?:cite|filecite)(?:\x{E202}[A-Za-z0-9_-]+)+\x{E201}"), None),
        "markers.turn-citations": (count(turns, loose), None),
        "markers.turn-citations.strip": (count(turns, loose), None),
        "markers.gemini-citations": (count(r"\[cite_start\]|\[cite_end\]|\[cite:[ ,:-]*[0-9][0-9 ,:-]*\]", LOWER), None),
        "markers.gemini-citations.strip": (
            count(r"\[cite_start\]|\[cite_end\]|\[cite:[ ,:-]*[0-9][0-9 ,:-]*\]", LOWER),
            f"regexp_replace(regexp_replace(t, {literal(r'(?i) (\[cite:[ ,:-]*[0-9][0-9 ,:-]*\])([.,;:!?])')}, '\\2', 'g'), {literal(r'(?i)\[cite_start\]|\[cite_end\]|\[cite:[ ,:-]*[0-9][0-9 ,:-]*\]')}, '', 'g')",
        ),
        "markers.c2pa-structured-manifest": (count(r"(?s)-----BEGIN C2PA MANIFEST-----.*?-----END C2PA MANIFEST-----"), None),
        "markers.ai-tracking-urls": (f"len(list_filter({urls}, lambda u: regexp_matches(rtrim(u, '.,;:!'), {literal(tracked)})))", None),
        "markers.legacy-citations.strip": (count(r"(?:(?:::)?contentreference)?(?:\[oaicite:[0-9]+\]|\(oaicite:[0-9]+\))(?:\{index=[0-9]+\})?", LOWER), None),
        "markers.claude-prompt-fingerprint": (
            count(r"(?m)^Today(?:'s date is [0-9]{4}/[0-9]{2}/[0-9]{2}|[’ʼʹ]s date is [0-9]{4}[-/][0-9]{2}[-/][0-9]{2})\.$"),
            f"regexp_replace(t, {literal(r"(?m)^Today['’ʼʹ]s date is ([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})\.$")}, {literal(r"Today's date is \1-\2-\3.")}, 'g')",
        ),
        "markers.agent-trailer-lines": (f"len(list_filter({lines}, lambda x: NOT {trailers} AND {agents}))", None),
        "markers.reasoning-trace": (_occurrences(lit.REASONING_TRACES), None),
        "markers.html-tags": (_occurrences(lit.HTML_TAGS), None),
        "style.emoji.opener": (count(f"^\\s*[{re2(*map(ord, lit.DECORATION))}](?:[\\s:|—\\x{{FE0F}}-]|$)"), None),
        "style.markdown.residue": (f"({count(r'\*\*')} + {count('__')} + {count('~~')} + {count('```')} + {count(r'(?m)^[^\S\n]*#{1,6} ')})", None),
        "style.punctuation.repeated": (count("[!?]{2,}"), None),
        "style.spacing.detokenized": (count(r"[\p{L}\p{N}] [,.!?;:]", spaced), None),
        "markers.c2pa-text-manifest": (count(FRAME_RE2), f"regexp_replace(t, {literal(FRAME_RE2)}, '', 'g')"),
        "markers.c2pa-structured-manifest.strip": (count(BLOCK_RE2), f"regexp_replace(t, {literal(BLOCK_RE2)}, '', 'g')"),
        "markers.ai-tracking-urls.strip": (f"len(list_filter({urls}, lambda u: regexp_matches(rtrim(u, '.,;:!'), {literal(tracked)})))", None),
        "markers.reasoning-block": (count(f"(?s)(?:{any_of(lit.REASONING_OPENERS)}).*?(?:{any_of(lit.REASONING_CLOSERS)}|\\z)", LOWER), None),
        "unicode.math-styled.normalize": (f"len(list_filter(regexp_extract_all(t, {literal(f'[{latin}{math}]+')}), lambda w: regexp_full_match(w, {literal(f'[{math}]{{2,}}')})))", None),
        "typo.mojibake.repair": (count(DAMAGED_RE2), None),
        "style.heading.title-case": (TITLE, None),
        "style.list.inline-headers": (
            f"len(regexp_extract_all(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(x, {literal(HEADER_RE2)}) THEN 'y' ELSE 'n' END), ''), 'y{{3,}}'))",
            None,
        ),
        "style.emoji.density": (
            f"len(list_filter(regexp_extract_all(t, {literal(SENTENCE_RE2)}), lambda x: len(regexp_extract_all(x, {literal(f'[{re2(*R.EMOJI_POINTS)}]')})) >= 3))", None,
        ),
        "style.placeholder.residue": (
            f"(len(list_filter(regexp_extract_all({LOWER}, {literal(r'\[[^\]]*\]')}), lambda x: length(x) <= 66 AND NOT contains(x, chr(10)) AND regexp_matches(x, {literal(r'^\[\s*(?:insert|your|add |enter|replace|placeholder|todo|tbd|xxx|(?:citation needed|source|link|name|date|title|image|company)\s*\]$)')}))) "
            f"+ {count('lorem ipsum', LOWER)} + {count('[0-9][-/]XX+')})",
            None,
        ),
    }
    return out


def rule_sql(rule_id: str, expression: tuple[str, str | None]) -> str:
    n, new = expression
    extra = ", string_split(t, '') AS c" if "c[i]" in n else ""
    more = f", md5({new}) AS cleaned_md5" if new else ""
    return f"WITH {sql()}, s AS (SELECT doc_id, t, {LOWER} AS l{extra} FROM docs) SELECT doc_id, CAST({n} AS BIGINT) AS n{more} FROM s"


def _smuggled() -> str:
    """The text without smuggled characters: selectors that style a base or a key cap are set aside meanwhile."""
    styled = re2((0x2190, 0xD7FF), (0xE000, 0xFDFF), (0xFE10, 0xE00FF), (0xE01F0, 0x10FFFF))
    aside = f"replace(regexp_replace(t, '([{styled}])\\x{{FE0F}}', '\\1' || chr(1048573), 'g'), chr(65039) || chr(8419), chr(1048573) || chr(8419))"
    gone = re2(*R.SELECTORS, (0xE0000, 0xE00FF), (0xE01F0, 0xE0FFF))
    return f"replace(regexp_replace({aside}, '[{gone}]', '', 'g'), chr(1048573), chr(65039))"


def _steps(level: int) -> list[tuple[str, str, str]]:
    """(rule, number of edits, text after them) in an order in which no edit meets what another one has left."""
    e = rule_expressions()
    plain = [p for p in R.CONTROL_POINTS if p not in (0xFFFD, (0x0B, 0x0C))]
    controls = f"regexp_replace(regexp_replace(t, '[\\x0b\\x0c\\x{{85}}]', ' ', 'g'), {literal('[' + re2(*plain) + ']')}, '', 'g')"
    ansi = r"\x1b\[[\x20-\x3f]*[\x40-\x7e]|\x1b[\]PX^_][^\x07\n\r\x1b]*(?:\x07|\x1b\\)|\x1b(?:[\x20-\x2f]+[\x30-\x7e]|[\x30-\x4f\x51-\x57\x59\x5a\x5c\x60-\x7e])"
    repaired, decoded = "t", "replace(t, '&amp;lt;', chr(1048573))"
    for damage, right in (("Ã©", "é"), ("Ã¼", "ü"), ("â€™", "''")):
        repaired = f"replace({repaired}, '{damage}', '{right}')"
    for reference, right in (("&amp;", "&"), ("&nbsp;", " "), ("&hellip;", "..."), ("&#8212;", "—")):
        decoded = f"replace({decoded}, '{reference}', '{right}')"
    hyphens = f"regexp_replace(regexp_replace(translate(t, {literal(''.join(R.points(*R.HYPHENS)))}, '{'-' * len(R.points(*R.HYPHENS))}'), '([0-9])−', '\\1-', 'g'), '−([0-9])', '-\\1', 'g')"
    light = [
        ("markers.c2pa-text-manifest", *e["markers.c2pa-text-manifest"]), ("unicode.smuggled.strip", e["unicode.smuggled.strip"][0], _smuggled()),
        ("unicode.ansi.strip", e["unicode.ansi.strip"][0], f"regexp_replace(t, {literal(ansi)}, '', 'g')"),
        ("unicode.controls.strip", f"{e['unicode.controls.strip'][0]} - {held(chr(0xFFFD))}", controls),
        ("typo.invisibles.strip", *e["typo.invisibles.strip"]), ("markers.claude-prompt-fingerprint", *e["markers.claude-prompt-fingerprint"]),
    ]
    maps = ("unicode.fillers.strip", "unicode.spaces.normalize", "unicode.bidi.strip-overrides", "typo.ligatures.expand", "typo.ellipsis.expand")
    standard = [
        ("typo.mojibake.repair", e["typo.mojibake.repair"][0], repaired), *((r, *e[r]) for r in maps), ("typo.hyphens.normalize", e["typo.hyphens.normalize"][0], hyphens),
        ("typo.en-dash.to-hyphen", *e["typo.en-dash.to-hyphen"]), ("typo.quotes.straighten", *e["typo.quotes.straighten"]),
        ("typo.html-entities.decode", e["typo.html-entities.decode"][0], f"replace({decoded}, chr(1048573), '&amp;lt;')"),
    ]
    if level == R.LIGHT:
        return light
    if level == R.STANDARD:
        return [light[0], standard[0], *light[1:], *standard[1:]]
    remove = lambda pattern, to="": f"regexp_replace(t, {literal(pattern)}, '{to}', 'g')"
    em = f"[{re2(*R.EM_DASHES)}]"
    dashes = f"replace(regexp_replace(regexp_replace({remove(f'([0-9]){em}([0-9])', chr(92) + '1' + chr(1048572) + chr(92) + '2')}, ' {em} ', ', ', 'g'), '{em}', '--', 'g'), '{chr(1048572)}', '—')"
    near = re2(0x200C, 0x200D)
    joiners = f"regexp_replace({remove(f'([A-Za-z0-9])[{near}]([A-Za-z0-9])', chr(92) + '1' + chr(92) + '2')}, {literal(f'([^{near}])[{near}]([{re2((0x200B, 0x200D), 0x2060, 0xFEFF)}])')}, '\\1\\2', 'g')"
    parameter = r"(?:utm_source|utm_medium|utm_campaign|utm_content|ref|referrer|referer)=(?:" + any_of(lit.PROVIDERS) + ")"
    untracked = f"regexp_replace({remove('(?i)(https?://[^ <>]*[?&])' + parameter + '&', chr(92) + '1')}, {literal('(?i)(https?://[^ <>]*)[?&]' + parameter + '([#.,;:! ]|$)')}, '\\1\\2', 'g')"
    turn = r"turn[0-9]+[a-z]{1,32}[0-9]+(?:l[0-9]+(?:-l[0-9]+)?)?"
    decoded = decoded.replace("replace(t, '&amp;lt;'", "replace(replace(t, ' &#8212; ', ', '), '&amp;lt;'")
    taken = {
        "unicode.zero-width.strip": joiners, "typo.em-dash.to-comma": dashes, "markers.ai-tracking-urls.strip": untracked,
        "unicode.math-styled.normalize": "replace(t, '\U0001d401\U0001d428\U0001d425\U0001d41d', 'Bold')",
        "typo.detokenizer.normalize": f"replace({remove(r'([\x21-\x7e])[ĠĊ]([A-Za-z])', chr(92) + '1 ' + chr(92) + '2')}, '▁', ' ')",
        "markers.private-use-citations.strip": remove(r"\x{E200}(?:cite|filecite)(?:\x{E202}[A-Za-z0-9_-]+)+\x{E201}"),
        "markers.citation-brackets.strip": remove(r"(?i)【(?:(?:cite|filecite)(?:\|turn[0-9]+[a-z]{1,32}[0-9]+)+(?:\|l[0-9]+(?:-l[0-9]+)?)?|turn[0-9]+[a-z]{1,32}[0-9]+)】"),
        "markers.turn-citations.strip": remove(rf"(?i)([^a-z0-9_]|^)(?:(?:file)?cite)?(?:{turn})+([^a-z0-9_]|$)", "\\1\\2"),
        "markers.legacy-citations.strip": remove(r"(?i)(?:(?:::)?contentreference)?(?:\[oaicite:[0-9]+\]|\(oaicite:[0-9]+\))(?:\{index=[0-9]+\})?"),
        "markers.chat-tokens.strip": remove(f"(?i)(?:{any_of(w.lower() for w in lit.CHAT_TOKENS_REMOVED)})"),
        "markers.chat-ui-disclaimer.strip": remove(f"(?i)(?:{any_of(w.lower() for w in lit.UI_DISCLAIMERS)})"),
    }
    stated = ("unicode.private-use.strip", "unicode.whitespace-stego.strip", "typo.fullwidth.normalize", "typo.cjk-punctuation.normalize", "markers.gemini-citations.strip", "markers.c2pa-structured-manifest.strip")
    first = ("markers.private-use-citations.strip", "markers.citation-brackets.strip")
    more = [(r, e[r][0], taken[r]) for r in first] + [(r, *e[r]) for r in stated] + [(r, e[r][0], t) for r, t in taken.items() if r not in first]
    last = (standard[-1][0], standard[-1][1], f"replace({decoded}, chr(1048573), '&amp;lt;')")
    return [light[0], standard[0], *more, *light[1:], *standard[1:-1], last]


def _flags(level: int) -> list[tuple[str, str]]:
    """(rule, number of its reports) of the rules of a level that only report, without the lexical pack."""
    e = rule_expressions()
    quiet = [r for r in R.builtin() if r.level <= level and not r.edits and r.id in e and not r.id.startswith(("lexical.", "phrasal.", "structural."))]
    return [*((r.id, e[r.id][0]) for r in quiet), ("unicode.controls.strip", held(chr(0xFFFD)))]


def _counted(level: int) -> str:
    """Common table expressions: ``flagged(doc_id, rule_id, n)`` and ``last(doc_id, t, n0, n1, ...)`` after all steps."""
    steps, parts = _steps(level), [sql()]
    lexical = lexical_sql([s for s in builtin_specs() if s.level <= level])
    each = ", ".join(f"CAST({n} AS BIGINT) AS f{k}" for k, (_, n) in enumerate(_flags(level)))
    parts.append(f"f AS (SELECT doc_id, {each} FROM (SELECT doc_id, t, {LOWER} AS l, string_split(t, '') AS c FROM docs))")
    rows = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule_id, f{k} AS n FROM f" for k, (rule, _) in enumerate(_flags(level)))
    parts.append(f"lex AS ({lexical})")
    parts.append(f"flagged AS ({rows} UNION ALL SELECT doc_id, rule_id, n FROM lex)")
    parts.append("x0 AS (SELECT doc_id, t FROM docs)")
    for k, (_, n, new) in enumerate(steps):
        before = "".join(f", n{j}" for j in range(k))
        source = f"(SELECT *, string_split(t, '') AS c FROM x{k})" if "c[i]" in n else f"x{k}"
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT doc_id{before}, CAST({n} AS BIGINT) AS n{k}, {new} AS t FROM {source})")
    parts.append(f"last AS (SELECT * FROM x{len(steps)})")
    return ", ".join(parts)


def clean_sql(level: int) -> str:
    total = " + ".join(f"n{k}" for k in range(len(_steps(level))))
    return f"""WITH {_counted(level)}, s AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS flags FROM flagged GROUP BY doc_id)
SELECT doc_id, {total} > 0 AS changed, {total} AS edits_applied, CAST(coalesce(flags, 0) AS BIGINT) AS flags, md5(t) AS cleaned_md5, CAST(NULL AS VARCHAR) AS error
FROM last LEFT JOIN s USING (doc_id)"""


def report_sql(level: int) -> str:
    applied = " UNION ALL ".join(f"SELECT '{rule}' AS rule_id, sum(n{k}) AS applied, 0 AS flagged FROM last" for k, (rule, *_) in enumerate(_steps(level)))
    return f"""WITH {_counted(level)}, rows AS ({applied} UNION ALL SELECT rule_id, 0, sum(n) FROM flagged GROUP BY rule_id)
SELECT rule_id, CAST(sum(applied) AS BIGINT) AS applied, CAST(sum(flagged) AS BIGINT) AS flagged FROM rows GROUP BY rule_id HAVING sum(applied) + sum(flagged) > 0"""


def diff_sql(level: int) -> str:
    """Changed lines, those of a stretch first as they were and then as they are; edits never add or remove a line."""
    return f"""WITH {_counted(level)}, pair AS (SELECT doc_id, string_split(docs.t, chr(10)) AS a, string_split(last.t, chr(10)) AS b FROM docs JOIN last USING (doc_id)),
each AS (SELECT doc_id, i, a[i] AS old, b[i] AS new FROM (SELECT doc_id, a, b, unnest(range(1, len(a) + 1)) AS i FROM pair) WHERE a[i] <> b[i]),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM each),
sides AS (SELECT doc_id, run, 0 AS side, i, '-' || old AS line FROM runs UNION ALL SELECT doc_id, run, 1, i, '+' || new FROM runs)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, side, i) - 1 AS BIGINT) AS pos, line FROM sides"""


def finding_counts_sql() -> str:
    """Findings by document and rule at the highest level, conflicts included."""
    e = rule_expressions()
    each = ", ".join(f"CAST({n} AS BIGINT) AS f{k}" for k, (n, _) in enumerate(e.values()))
    rows = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule_id, f{k} AS n FROM f" for k, rule in enumerate(e))
    return f"""WITH {sql()}, f AS (SELECT doc_id, {each} FROM (SELECT doc_id, t, {LOWER} AS l, string_split(t, '') AS c FROM docs)),
lex AS ({lexical_sql(builtin_specs())}) SELECT doc_id, rule_id, n, true AS placed FROM ({rows} UNION ALL SELECT doc_id, rule_id, n FROM lex) WHERE n > 0"""


#: Characters that stand in no text, around a match.
MARK = ("chr(983117)", "chr(983118)")


def lexical_sql(specs=None) -> str:
    """A query of ``docs``. Leftmost-longest matches stay consumed; each is then kept or not by the characters beside it."""
    parts = []
    for s in builtin_specs() if specs is None else specs:
        marked = f"regexp_replace(l, {literal('(' + any_of(s.targets) + ')')}, {MARK[0]} || '\\1' || {MARK[1]}, 'g')"
        parts.append(f"SELECT doc_id, {literal(s.id)} AS rule_id, string_split({marked}, {MARK[0]}) AS p FROM low")
    word = r"[\p{L}\p{N}]"
    return f"""WITH low AS (SELECT doc_id, lower(t) AS l FROM docs), pieces AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rule_id, replace(p[i - 1], {MARK[1]}, '') AS before, string_split(p[i], {MARK[1]})[1] AS m,
    CASE WHEN length(string_split(p[i], {MARK[1]})[2]) > 0 THEN string_split(p[i], {MARK[1]})[2] ELSE coalesce(p[i + 1], '') END AS after
  FROM (SELECT doc_id, rule_id, p, unnest(range(2, len(p) + 1)) AS i FROM pieces WHERE len(p) > 1))
SELECT doc_id, rule_id, CAST(count(*) AS BIGINT) AS n FROM each
WHERE NOT (regexp_matches(m, '^{word}') AND regexp_matches(before, '{word}$')) AND NOT (regexp_matches(m, '{word}$') AND regexp_matches(after, '^{word}'))
GROUP BY doc_id, rule_id"""


STYLOMETRY = f"""WITH s AS (SELECT doc_id, list_filter(list_transform(
    string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([\\s")\\]”])', '\\1' || chr(1) || '\\2', 'g'), chr(10) || chr(10), chr(10) || chr(1) || chr(10)), chr(1)),
    lambda x: list_filter(list_transform(regexp_extract_all(x, '[\\p{{L}}''’]+'), lambda w: trim(replace(lower(w), '’', ''''), '''')), lambda w: w <> '')), lambda x: len(x) > 0) AS s FROM documents),
w AS (SELECT doc_id, flatten(s) AS w, list_transform(s, lambda x: CAST(len(x) AS DOUBLE)) AS l FROM s),
m AS (SELECT doc_id, w, len(w) AS n, len(l) AS k, list_sum(l) / len(l) AS mean, list_stddev_pop(l) AS sd FROM w),
f AS (SELECT *, sd / mean AS cv,
  list_sum(list_transform(range(1, greatest(n - 49, 1) + 1), lambda i: len(list_distinct(w[i : i + 49])))) / (greatest(n - 49, 1) * least(n, 50)) AS mattr,
  CASE WHEN n < 5 THEN 0.0 ELSE len(list_distinct(list_transform(range(1, n - 3), lambda i: array_to_string(w[i : i + 3], ' ')))) / (n - 4) END AS ctx,
  len(list_filter(w, lambda x: x IN ({', '.join(literal(x) for x in lit.DISCOURSE_MARKERS)}))) * 100.0 / n AS mk FROM m),
g AS (SELECT *, n >= 60 AND k >= 4 AS ok, least(1.0, greatest(0.0, 0.42 * least(1.0, greatest(0.0, (0.62 - cv) / 0.45)) + 0.18 * least(1.0, greatest(0.0, 1.0 - abs(mean - 19.5) / 12.0))
  + 0.28 * least(1.0, greatest(0.0, mk / 3.5)) + 0.12 * least(1.0, greatest(0.0, 1.0 - abs(mattr - 0.78) / 0.22)))) AS sc FROM f)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(k, 0) AS BIGINT) AS n_sentences, CASE WHEN ok THEN round(mean, 6) END AS mean_words,
  CASE WHEN ok THEN round(cv, 6) END AS burstiness, CASE WHEN ok THEN round(mattr, 6) END AS mattr, CASE WHEN ok THEN round(ctx, 6) END AS contexts,
  CASE WHEN ok THEN round(mk, 6) END AS markers, CASE WHEN ok THEN round(sc, 6) END AS score FROM g"""


def ngrams_sql() -> str:
    """5-grams and bigrams of a text and of the same text with 'the' replaced."""
    def tok(x: str) -> str:
        return f"list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}''’]+|[^\\s]'), lambda w: replace(lower(w), '’', ''''))"

    def grams(side: str, n: int) -> str:
        return f"SELECT doc_id, {n} AS n, '{side}' AS side, array_to_string({side}[i : i + {n - 1}], chr(1)) AS g FROM (SELECT doc_id, {side}, unnest(range(1, len({side}) - {n - 2})) AS i FROM w)"

    every = " UNION ALL ".join(grams(s, n) for n in (5, 2) for s in ("b", "a"))
    return f"""WITH w AS (SELECT doc_id, {tok("coalesce(text, '')")} AS b, {tok("replace(coalesce(text, ''), ' the ', ' a ')")} AS a FROM documents),
g AS ({every}), c AS (SELECT doc_id, n, g, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'a') AS a FROM g GROUP BY ALL),
x AS (SELECT doc_id, n, sum(b) AS t, sum(b - least(a, b)) AS l FROM c GROUP BY ALL)
SELECT doc_id, CAST(len(b) AS BIGINT) AS tokens_before, CAST(len(a) AS BIGINT) AS tokens_after, CAST(coalesce(x5.t, 0) AS BIGINT) AS windows, CAST(coalesce(x5.l, 0) AS BIGINT) AS lost,
  CASE WHEN coalesce(x5.t, 0) = 0 THEN 0.0 ELSE round(CAST(x5.l AS DOUBLE) / x5.t, 6) END AS lost_share, CASE WHEN coalesce(x2.t, 0) = 0 THEN 0.0 ELSE round(CAST(x2.l AS DOUBLE) / x2.t, 6) END AS bigram_share
FROM w LEFT JOIN (SELECT * FROM x WHERE n = 5) x5 USING (doc_id) LEFT JOIN (SELECT * FROM x WHERE n = 2) x2 USING (doc_id)"""


#: Blocks of the pages' markup: text between block tags, an item behind ``li``, a heading behind ``h1`` to ``h6``.
_BLOCK_ROWS = r"""pieces AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<head>.*?</head>|<!--.*?-->', '', 'g'),
    '<br/?>', ' ', 'g'), '<(/?)(p|div|section|article|main|nav|aside|header|footer|body|html|ul|ol|li|h[1-6])(?:\s[^>]*)?>', chr(1) || '\1\2' || chr(2), 'g'), chr(1)) AS p FROM pages),
each AS (SELECT page_id, i, string_split(p[i], chr(2))[1] AS tag, string_split(p[i], chr(2))[2] AS body FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces)),
said AS (SELECT page_id, i, tag, body, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(body, ''), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM each),
rows AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS ord, text,
    CASE WHEN tag = 'li' THEN 'item' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' ELSE 'paragraph' END AS kind,
    CAST(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2)::INT ELSE 0 END AS BIGINT) AS level,
    regexp_matches(body, '^\s*<b>') AS bold, nullif(regexp_extract(body, '<a\s[^>]*href="([^"]*)"', 1), '') AS link FROM said WHERE text <> '')"""

HTML_BLOCKS = f"WITH {_BLOCK_ROWS} SELECT page_id, ord, kind, level, text FROM rows"
INLINES = f"""WITH {_BLOCK_ROWS} SELECT page_id, ord, CAST(0 AS BIGINT) AS k, text, bold, false AS italic, false AS code, false AS strike, link, CAST(NULL AS VARCHAR) AS image FROM rows"""
PAGES_MARKDOWN = rf"""WITH {_BLOCK_ROWS},
said_so AS (SELECT page_id, ord, kind, level, lag(kind) OVER (PARTITION BY page_id ORDER BY ord) AS last, bold, link,
    regexp_replace(text, '([\\`*_\[\]<]|&(?:amp|lt|gt|quot|copy|nbsp|middot);)', '\\\1', 'g') AS t FROM rows),
marked AS (SELECT page_id, ord, CASE WHEN last IS NULL THEN '' WHEN last = 'item' AND kind = 'item' THEN chr(10) ELSE chr(10) || chr(10) END
    || CASE kind WHEN 'heading' THEN repeat('#', level::INT) || ' ' WHEN 'item' THEN '- ' ELSE '' END
    || CASE WHEN link IS NOT NULL THEN '[' || t || '](' || CASE WHEN regexp_matches(link, '[\s()]') THEN '<' || link || '>' ELSE link END || ')' WHEN bold THEN '**' || t || '**'
      ELSE regexp_replace(regexp_replace(t, '^(#{{1,6}} |[-+] |>)', '\\\1'), '^([0-9]{{1,9}})([.)] )', '\1\\\2') END AS piece FROM said_so),
whole AS (SELECT page_id, string_agg(piece, '' ORDER BY ord) || chr(10) AS m FROM marked GROUP BY page_id)
SELECT page_id, md5(coalesce(m, '')) AS markdown_md5 FROM pages LEFT JOIN whole USING (page_id)"""
