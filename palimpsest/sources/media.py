"""Metadata of PNG, JPEG, WebP and SVG bytes that declares how a picture was made; reported, never removed."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import regex

from ..operators import literals as lit

PNG = b"\x89PNG\r\n\x1a\n"
#: Bytes of Exif data that are searched.
EXIF_BYTES = 32_768
_TOOLS = regex.compile("(?<![a-z0-9])(?:" + "|".join(regex.escape(t) for t in lit.MEDIA_GENERATORS) + ")(?![a-z0-9])")
_MANIFEST = ("c2pa:", "http://c2pa.org", "https://c2pa.org", "dcterms:provenance", "contentcredentials")
_NAMING = ("creatortool", "softwareagent", "dc:creator", "ai-generated", "xmp:")


def kind_of(content: bytes) -> str | None:
    """png, jpeg, webp, svg or none, by the first bytes."""
    if content.startswith(PNG):
        return "png"
    if content.startswith(b"\xff\xd8\xff"):
        return "jpeg"
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return "webp"
    head = content[:2048].decode("utf-8", errors="replace").lstrip("﻿ \t\r\n")
    if regex.match(r"<svg[\s>]", head) or head.startswith(("<?xml", "<!DOCTYPE svg", "<!--")) and "<svg" in head.lower():
        return "svg"
    return None


def png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        if at + 12 + size > len(content):
            return
        yield name, content[at + 8 : at + 8 + size]
        at += 12 + size


def jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Markers with a length up to the start of the scan."""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xDA:
            return
        if marker == 0xFF or 0xD0 <= marker <= 0xD9 or marker == 0x01:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if size < 2 or at + 2 + size > len(content):
            return
        yield marker, content[at + 4 : at + 2 + size]
        at += 2 + size


def webp_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(content):
        name, size = struct.unpack("<4sI", content[at : at + 8])
        if at + 8 + size > len(content):
            return
        yield name, content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


#: Names of the boxes of a provenance store, and what follows each in its box's identifier.
BOXES = {
    b"c2pa": "store", b"c2ma": "manifest", b"c2md": "update manifest", b"c2as": "assertions", b"c2cl": "claim", b"c2cs": "signature", b"c2vc": "credentials", b"c2db": "data",
}
BOX_TAIL = bytes.fromhex("00110010800000AA00389B71")
#: Boxes within boxes.
NESTING = 16


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[str]:
    """Kinds of provenance boxes, those within others included; a box whose length does not fit ends the walk."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end and depth < NESTING:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        stop = end if size == 0 else at + size
        if stop > end or stop < at + head:
            return
        if name == b"jumb":
            yield from boxes(data, at + head, stop, depth + 1)
        elif name == b"jumd" and data[at + head + 4 : at + head + 16] == BOX_TAIL and (kind := BOXES.get(data[at + head : at + head + 4])):
            yield kind
        at = stop


def _boxed(data: bytes, where: str) -> tuple[str, str]:
    inside = list(dict.fromkeys(boxes(data)))
    return "container.c2pa-manifest", f"{where} with {', '.join(inside)}" if inside else f"{where} that holds no known box"


EXTENDED = b"http://ns.adobe.com/xmp/extension/\0"


def extended_packets(parts: list[bytes]) -> Iterator[bytes]:
    """XMP that is spread over segments: by identifier (32 bytes), each part with the whole length and its place."""
    whole: dict[bytes, bytearray] = {}
    for part in parts:
        name, rest = part[:32], part[32:]
        if len(rest) >= 8:
            size, at = struct.unpack(">II", rest[:8])
            if size <= EXTENDED_BYTES and at + len(rest) - 8 <= size:
                whole.setdefault(name, bytearray(size))[at : at + len(rest) - 8] = rest[8:]
    yield from map(bytes, whole.values())


#: Bytes of XMP that segments may add up to.
EXTENDED_BYTES = 16 << 20


def _packet(raw: bytes) -> tuple[str, str] | None:
    """What an XMP packet declares: a manifest, or a generator or source type."""
    low = raw.decode("utf-8", errors="replace").lower()
    tool = _TOOLS.search(low)
    if any(m in low for m in _MANIFEST):
        return "container.c2pa-manifest", "XMP refers to a provenance manifest"
    if "algorithmicmedia" in low or "digitalsourcetype" in low and tool:
        return "container.image-ai-metadata", "XMP carries a digital source type"
    if tool and any(n in low for n in _NAMING):
        return "container.image-ai-metadata", f"XMP names {tool.group()}"
    return None


def _exif(raw: bytes) -> tuple[str, str] | None:
    low = bytes(b if 0x20 <= b < 0x7F else 0x20 for b in raw[:EXIF_BYTES]).decode().lower()
    tool = _TOOLS.search(low)
    if "trainedalgorithmicmedia" in low:
        return "container.image-ai-metadata", "Exif carries a digital source type"
    return ("container.image-ai-metadata", f"Exif names {tool.group()}") if tool else None


def _png_text(name: bytes, data: bytes) -> tuple[str, str] | None:
    keyword, mark, rest = data.partition(b"\0")
    if not mark:
        return None
    if name == b"iTXt":
        if len(rest) < 2 or rest[0]:
            return None
        rest = rest[2:].split(b"\0", 2)[-1]
    key, low = keyword.decode("latin-1").lower(), rest.decode("utf-8", errors="replace").lower()
    if key == "xml:com.adobe.xmp":
        return _packet(rest)
    if key == "parameters" and any(s in low for s in ("steps:", "negative prompt:", "sampler:")):
        return "container.image-ai-metadata", "generation parameters"
    if key in ("prompt", "workflow") and any(s in low for s in ('"class_type"', '"ksampler"', '"inputs"')):
        return "container.image-ai-metadata", "generation graph"
    tool = _TOOLS.search(low)
    if key in ("software", "comment", "description", "source", "author", "ai-generated") and tool:
        return "container.image-ai-metadata", f"{key} names {tool.group()}"
    return None


def findings(content: bytes) -> list[dict]:
    """Findings of one picture, each once, in order; other bytes have none, truncated ones what precedes the damage."""
    kind, found = kind_of(content), []
    if kind == "png":
        for name, data in png_chunks(content):
            if name == b"caBX":
                found.append(_boxed(data, "manifest chunk"))
            elif name in (b"tEXt", b"iTXt"):
                found.append(_png_text(name, data))
            elif name == b"eXIf":
                found.append(_exif(data))
    elif kind == "jpeg":
        parts, box = [], b""
        for marker, data in jpeg_segments(content):
            if marker == 0xEB and data[:2] == b"JP":
                # A box that goes on repeats its head in each segment: common mark, box number, packet number, box head.
                box += data[8:] if not box else data[16:]
            elif marker == 0xE1 and data.startswith(EXTENDED):
                parts.append(data[len(EXTENDED) :])
            elif marker == 0xE1 and data.startswith(b"Exif\0\0"):
                found.append(_exif(data))
            elif marker == 0xE1:
                found.append(_packet(data))
        found += map(_packet, extended_packets(parts))
        if any(True for _ in boxes(box)):
            found.append(_boxed(box, "manifest segments"))
    elif kind == "webp":
        for name, data in webp_chunks(content):
            found.append(_boxed(data, "manifest chunk") if name == b"C2PA" else _exif(data) if name == b"EXIF" else _packet(data) if name == b"XMP " else None)
    elif kind == "svg":
        found += [_packet(m.encode()) for m in regex.findall(r"(?is)<metadata.*?</metadata>|<x:xmpmeta.*?</x:xmpmeta>", content.decode("utf-8", errors="replace"))]
        if b"c2pa:manifest" in content:
            found.append(("container.c2pa-manifest", "embedded manifest"))
    return [{"rule_id": r, "message": m} for r, m in dict.fromkeys(f for f in found if f)]


def dimensions(content: bytes) -> tuple[int, int] | None:
    """Width and height in pixels that a picture's head states."""
    kind = kind_of(content)
    if kind == "png" and content[12:16] == b"IHDR" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if kind == "jpeg":
        for marker, data in jpeg_segments(content):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(data) >= 5:
                high, wide = struct.unpack(">HH", data[1:5])
                return wide, high
    if kind == "webp":
        for name, data in webp_chunks(content):
            if name == b"VP8X" and len(data) >= 10:
                return int.from_bytes(data[4:7], "little") + 1, int.from_bytes(data[7:10], "little") + 1
            if name == b"VP8 " and data[3:6] == b"\x9d\x01\x2a" and len(data) >= 10:
                wide, high = struct.unpack("<HH", data[6:10])
                return wide & 0x3FFF, high & 0x3FFF
            if name == b"VP8L" and data[:1] == b"\x2f" and len(data) >= 5:
                bits = int.from_bytes(data[1:5], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None
