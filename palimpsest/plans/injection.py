"""Deterministic additions to natural texts, so that every rule has something to find on both sides of a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.pack_core import PACK

#: An invisible provenance frame: variation selectors that stand for a magic, a version and a length.
FRAME = "\ufeff" + "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in b"C2PATXT\0\x01\0\0\0\x05hello")

#: One of these is appended to a text, by its id modulo their number; the first adds nothing.
SNIPPETS = (
    "",
    " “smart” ‘quotes’ «guillemets» 5′ 6″",
    " wait​ing so­ft no break end﻿",
    " oﬃce ﬁne ﬂow",
    " and so on… then‥ or⋯",
    " dash — spaced, tight—dash, range 1914—1918 and ⸺.",
    " en – spaced, 2019–2024.",
    " non‑breaking ‐ hyphen, 5−3 and a−b",
    " Ｆｕｌｌ（width）！",
    " 、。「quoted」〜・",
    " sentence▁piece wordĠnext Ġname",
    " \x1b[31mred\x1b[0m \x1b]0;title\x07 bad\x1b",
    " soh\x01 vt\x0b del\x7f bad� obj￼ nel\x85",
    " tag\U000e0041\U000e0042 a️ heart❤️ #️⃣",
    " fillerㅤ⠀xᅟ",
    " em space　ideo sep",
    " rtl‮abc‭ mark‎⁧x",
    " pua  chat",
    " zalgó̂̃̄ é",
    " zw a‍b c‌‍ d",
    " trailing tab \t\nnext\t \n",
    " \U0001d401\U0001d428\U0001d425\U0001d41d x\U0001d401\U0001d401",
    " pаypal and Ωmega",
    " <|im_start|>user <|foo_bar|> [INST]",
    " 【45†L75-L83】 oaicite 【cite|turn0search1】",
    " citeturn0search11 citeturn0search0 ::contentReference[oaicite:0]{index=0}",
    " claim [cite: 1, 2]. [cite_start]x[cite_end]",
    " see https://ex.am/p?x=1&utm_source=chatgpt.com&y=2#f, and http://ex.am/q?ref=kimi",
    "\nToday’s date is 2026/05/01.\nToday's date is 2026-05-01.",
    "\nCo-Authored-By: Claude <noreply@ex.am>\nCo-authored-by: Qwen Bot <x@ex.am>\nCo-authored-by: Jane Doe <j@ex.am>",
    " <tool_call> and <think>hmm, let me think</think>",
    " ChatGPT can make mistakes. Check important info. I am gpt-4o",
    ' <div class="x">para</div><br>',
    "\n- **One:** a\n- **Two:** b\n- **Three:** c",
    " wow!! really?! ok?",
    " hello , world . 12 :30 wait ...",
    " [insert name here] lorem ipsum 2026-XX-XX [link]",
    " **bold** __x__ ~~y~~\n## head",
    " We delve into the rich tapestry; not only aboutx, Furthermore it is a testament. DELVES",
    " Tom &amp; Jerry&nbsp;&hellip; &amp;lt; &#8212; itâ€™s",
    " \U0001f680 launch \U0001f680\U0001f680\U0001f680 yes.",
    " -----BEGIN C2PA MANIFEST----- x -----END C2PA MANIFEST-----",
    "\n-----BEGIN C2PA MANIFEST-----\nhttps://ex.am/m\n-----END C2PA MANIFEST----- and -----BEGIN C2PA MANIFEST-----",
    " framed" + FRAME + " text",
    " caf\u00c3\u00a9 it\u00e2\u20ac\u2122s \u00c3\u00bcber \u00c3 x",
    " <scratchpad> never closed. Hmm, the user wants",
    " ```thinking\nplan\n``` and `code` and <thinker",
    " \uff5cbegin_of\u2581x\uff5c \uff5cplain\uff5c <|bad token|> <| x |> <|im_start|",
    " \U0001f525 a \U0001f525 b \U0001f525! One \U0001f525. two \u2728\u2728",
    "\n1. **First** a\n2) **Second:** b\n\u2022 **Third**\n- **Fourth:** d\nplain\n- **Fifth:** e",
    " [cite: ] [cite_x] turnsearch0 turn0search [cite: 12]! \u3010\u65e5\u672c\u3011 \ue200cite\ue202turn1news2\ue201 \ue200open",
    " utm_source=chatgpt.com alone; http://ex.am/?utm_source=newsletter https://ex.am/a?ref=perplexity",
    " a \u2014 b\u2014c 3\u20144; x \u2013 y\u2013z",
    " (oaicite:3){index=2} contentReference[oaicite:x] oaicite:4",
    *(f" {terms[0]}; x{terms[0]}y, {terms[-1].upper()} and {terms[len(terms) // 2]}" for _, _, terms in PACK),
)

#: Every 53rd text starts with one of these; every 61st is one of the texts below and nothing else.
PREFIXES = ("\U0001f680 launch ", "\u2728", "x \U0001f680 ", "  \U0001f525: hot ", "\U0001f4a1\ufe0f idea ", "\U0001f680\U0001f680 ")
WHOLE = (
    "The Quick Brown Fox Jumps", "the quick brown fox jumps", "Only Two", " A Tale of Two Cities and a Dog\t", "NASA Was Here Today", "It Is Not A Title.",
    "Rise of the B Machines", "Title Case Words 2026 Again", "", "  ", "\U0001f680",
)


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def injected(doc_id: Column, text: Column) -> Column:
    k = F.coalesce(doc_id, F.lit(0)).cast("long")
    before = F.when(F.pmod(k, F.lit(53)) == 7, _pick(PREFIXES, F.floor(k / 53))).otherwise("")
    return F.when(F.pmod(k, F.lit(61)) == 9, _pick(WHOLE, F.floor(k / 61))).otherwise(F.concat(before, F.coalesce(text, F.lit("")), _pick(SNIPPETS, k)))


def literal(text: str) -> str:
    """A SQL string literal of any text; control characters by number."""
    out, plain = [], ""
    for c in text:
        if ord(c) < 0x20 or ord(c) == 0x7F:
            out += [f"'{plain}'"] * bool(plain) + [f"chr({ord(c)})"]
            plain = ""
        else:
            plain += "''" if c == "'" else c
    return " || ".join([*out, f"'{plain}'"] if plain or not out else out)


def sql() -> str:
    """The table ``docs(doc_id, t)`` as a common table expression."""
    cases = lambda key, values: f"(CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {literal(s)}" for k, s in enumerate(values)) + " END)"
    k = "coalesce(doc_id, 0)"
    before = f"(CASE WHEN {k} % 53 = 7 THEN {cases(f'({k} // 53)', PREFIXES)} ELSE '' END)"
    whole = f"CASE WHEN {k} % 61 = 9 THEN {cases(f'({k} // 61)', WHOLE)} ELSE {before} || coalesce(text, '') || {cases(k, SNIPPETS)} END"
    return f"docs AS (SELECT doc_id, {whole} AS t FROM documents)"
