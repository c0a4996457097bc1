"""Cleaning by format: rules run over a document's spans, edits go back into its source, structure must stay.

Container findings (metadata that declares how a document was made) are reported at every level and never removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markup import FRONT_MATTER, READERS, html_tokens, markdown_links, markdown_skeleton
from . import literals as lit
from .engine import Detector, _tally, once, resolved, sent_in_slices
from .rules import BLOCK_BEGIN, BLOCK_END, between
from .urls import cleaned_url

def skeleton(source: str, kind: str) -> str:
    """What cleaning must keep: the number of lines; of HTML every tag as it stands, of Markdown every mark."""
    if kind == "markdown":
        return markdown_skeleton(source)
    lines = f"lines={source.count(chr(10)) + 1}"
    if kind != "html":
        return lines
    return lines + "".join(source[s:e] for k, s, e, _ in html_tokens(source) if k == "tag")


def clean_source(source: str, kind: str, detector: Detector) -> dict:
    """Detect per span, resolve per span, splice into the source; a changed structure gives an error and no text."""
    edits, applied, flagged = [], [], []
    name = lambda f: detector.by_order[f[0]].id
    for span in READERS[kind](source):
        found = detector.find(span.text)
        if not found:
            continue
        kept = resolved([f for f in found if f[4] is not None])
        applied += map(name, kept)
        flagged += [name(f) for f in found if f[4] is None]
        for _, _, s, e, r in kept:
            edits += span.source_edits(s, e, escaped(r) if kind == "html" else r)
    out, at = [], 0
    for s, e, r in sorted(edits):
        out += [source[at:s], r]
        at = e
    new = "".join([*out, source[at:]])
    sound = not edits or skeleton(source, kind) == skeleton(new, kind)
    return {
        "cleaned": new if sound else None, "changed": bool(edits), "edits_applied": len(applied), "flags": len(flagged), "applied": _tally(iter(applied)),
        "flagged": _tally(iter(flagged)), "container": containers(source, kind), "error": None if sound else "self-check: structure changed",
    }


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


# --- container findings ----------------------------------------------------------------------------------------------

_ATTRIBUTE = regex.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_FENCED = regex.compile(r"^\s*+(?:```|~~~)")
_LABELLED = regex.compile(r"^\s*+(?:[-*+] |[0-9]++[.)] )\*\*(?=[^*]*\S)((?:(?!\*\*)[^`]){1,80})\*\*(?=$|[:. \u2014-])")
#: What a provenance block may hold, behind marks of comment lines.
_PAYLOAD = ("data:application/c2pa", "https://", "http://", "urn:c2pa:")
_LINE_COMMENT = regex.compile(r"^\s*+#*+(?://)*+(?:--)*+\**+\s*+")

#: Keys and openings that declare provenance, keys that name a tool, openings of a generator's comment.
META_DECLARES = frozenset(("ai-generated", "ai_generated", "ai-content-declaration", "ai-model", "llm-model", "c2pa", "c2pa:manifest", "dcterms:provenance"))
META_NAMES = frozenset(("generator", "author", "creator"))
FRONT_NAMES = frozenset(("generator", "author", "created_by", "created-by", "tool", "source"))
COMMENT_DECLARES = ("ai-generated", "c2pa:")
COMMENT_STARTS = ("generated by ", "generated with ", "created by ", "created with ", "exported from ")
MANIFEST_TYPES = frozenset(("application/c2pa", "application/x-c2pa-manifest-store"))


def containers(source: str, kind: str) -> list[dict]:
    """Document-level findings as rows of rule and message."""
    out: list[tuple[str, str]] = []
    if kind == "markdown":
        front = FRONT_MATTER.match(source)
        out += [("container.markdown-frontmatter", m) for line in (front.group().splitlines() if front else []) if (m := _front_line(line))]
        out += [(TRACKED, "a link's target carries a provider's parameter") for url in markdown_links(source) if cleaned_url(url) is not None]
        source = source[front.end() :] if front else source
        out += _markdown_habits(source)
    if kind == "html":
        for k, _, _, m in html_tokens(source):
            if k == "tag" and m.group(2) and not m.group(1):
                attrs = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(m.group(3))}
                out += _TAGS.get(m.group(2).lower(), lambda _: ())(attrs)
    if kind in ("html", "markdown"):
        comments = (source[s + 4 : e - 3].strip() for s, e in between(source, "<!--", "-->"))
        out += [("container.html-ai-metadata", m) for c in comments if (m := _comment(c))]
    out += [("container.c2pa-manifest", "structured provenance block") for s, e in between(source, BLOCK_BEGIN, BLOCK_END) if _is_payload(source[s + len(BLOCK_BEGIN) : e - len(BLOCK_END)])]
    return [{"rule_id": rule, "message": message} for rule, message in out]


TRACKED = "markers.ai-tracking-urls.container"


def _is_payload(inner: str) -> bool:
    """A locator or embedded manifest, perhaps within comment lines; prose between the two lines is none."""
    bare = inner.strip()
    if not 0 < len(bare.encode()) <= 262_144:
        return False
    return "".join(_LINE_COMMENT.sub("", line).strip() for line in bare.splitlines()).startswith(_PAYLOAD)


def _markdown_habits(source: str) -> Iterator[tuple[str, str]]:
    """Trailing white space that holds a tab, and three or more list items in a row that open with a bold label; no code."""
    fenced, items = False, 0
    for line in [*source.split("\n"), ""]:
        line = line.rstrip("\r")
        fence = bool(_FENCED.match(line))
        if fence or fenced or not _LABELLED.match(line):
            if items >= 3:
                yield "style.list.inline-headers", f"{items} list items in a row with a bold label"
            items = 0
        else:
            items += 1
        if not fenced and line.strip() and "\t" in line[len(line.rstrip(" \t")) :]:
            yield "unicode.whitespace-stego", "trailing white space with a tab"
        fenced ^= fence


def _front_line(line: str) -> str | None:
    bare = line.strip()
    key, sign, value = bare.partition(":") if ":" in bare else bare.partition("=")
    key, value = key.strip().strip("\"'").lower(), value.strip().strip("\"' ").lower()
    if not sign or bare.startswith("#"):
        return None
    if key in lit.PROVENANCE_KEYS and value not in ("false", "no"):
        return f"{key} declares provenance"
    tool = _named(value, lit.FRONT_MATTER_TOOLS) if key in FRONT_NAMES else None
    return f"{key} names {tool}" if tool else None


def _named(text: str, tools) -> str | None:
    return next((t for t in tools if t in text), None)


def _meta(attrs: dict[str, str]) -> Iterator[tuple[str, str]]:
    keys, content = [attrs[a].lower() for a in ("name", "property", "itemprop") if a in attrs], attrs.get("content", "").lower()
    tool = _named(content, lit.HTML_TOOLS)
    for key in keys[:1]:
        tests = ((key in META_DECLARES, "declares provenance"), ("trainedalgorithmicmedia" in content, "carries a digital source type"), (tool and key in META_NAMES, f"names {tool}"))
        yield from [("container.html-ai-metadata", f"{key} {what}") for holds, what in tests if holds][:1]


def _link(attrs: dict[str, str]) -> Iterator[tuple[str, str]]:
    if "c2pa-manifest" in attrs.get("rel", "").lower().split():
        yield "container.c2pa-manifest", "link to a provenance manifest"


def _script(attrs: dict[str, str]) -> Iterator[tuple[str, str]]:
    if attrs.get("type", "").lower() in MANIFEST_TYPES:
        yield "container.c2pa-manifest", "embedded provenance manifest"


def _anchor(attrs: dict[str, str]) -> Iterator[tuple[str, str]]:
    if cleaned_url(attrs.get("href", "")) is not None:
        yield TRACKED, "a link's target carries a provider's parameter"


_TAGS = {"meta": _meta, "link": _link, "script": _script, "a": _anchor}


def _comment(inner: str) -> str | None:
    low = inner.lower()
    if not 0 < len(inner.encode()) <= 280:
        return None
    tool = _named(low, lit.HTML_TOOLS) if low.startswith(COMMENT_STARTS) else None
    return "comment declares provenance" if low.startswith(COMMENT_DECLARES) else f"comment names {tool}" if tool else None


_REPORT = (
    "cleaned string, changed boolean, edits_applied long, flags long, applied map<string,long>, flagged map<string,long>, "
    "container array<struct<rule_id:string,message:string>>, error string"
)


def clean_files(files: DataFrame, level: str | int = "standard", text_col: str = "text", format_col: str = "format") -> DataFrame:
    """``files`` with ``report``; a null text or a format without spans gives a null report. Narrow."""

    @F.arrow_udf(_REPORT)
    def clean(files: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        detector = Detector(level)
        tally = pa.map_(pa.string(), pa.int64())
        note = pa.list_(pa.struct([("rule_id", pa.string()), ("message", pa.string())]))
        kind = pa.struct(
            [("cleaned", pa.string()), ("changed", pa.bool_()), ("edits_applied", pa.int64()), ("flags", pa.int64()), ("applied", tally), ("flagged", tally),
             ("container", note), ("error", pa.string())]
        )
        yield from sent_in_slices(files, lambda t, k: clean_source(t, k, detector) if t is not None and k in READERS else None, kind)

    return files.withColumn("report", once(clean)(F.col(f"`{text_col}`"), F.col(f"`{format_col}`")))


def container_findings(files: DataFrame, id_col: str, text_col: str = "text", format_col: str = "format") -> DataFrame:
    """A row per container finding."""

    @F.arrow_udf("array<struct<rule_id:string,message:string>>")
    def scan(files: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        note = pa.list_(pa.struct([("rule_id", pa.string()), ("message", pa.string())]))
        yield from sent_in_slices(files, lambda t, k: containers(t, k) if t is not None else [], note)

    return files.select(F.col(f"`{id_col}`"), F.explode(once(scan)(F.col(f"`{text_col}`"), F.col(f"`{format_col}`"))).alias("f")).select(id_col, "f.rule_id", "f.message")


def prose_spans(files: DataFrame, text_col: str = "text", format_col: str = "format", out: str = "spans") -> DataFrame:
    """``files`` with ``out``: the texts of the editable spans in order; null where ``clean_files`` gives no report."""

    @F.arrow_udf("array<string>")
    def read(files: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from sent_in_slices(files, lambda t, k: [s.text for s in READERS[k](t)] if t is not None and k in READERS else None, pa.list_(pa.string()))

    return files.withColumn(out, once(read)(F.col(f"`{text_col}`"), F.col(f"`{format_col}`")))


def joined_prose(files: DataFrame, text_col: str = "text", format_col: str = "format", out: str = "prose") -> DataFrame:
    """``files`` with ``out``: all prose of a document as one text, a line for each span."""
    return prose_spans(files, text_col, format_col, out).withColumn(out, F.array_join(out, "\n"))
