"""File names: formats by extension, formats by content, and names of outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by format, and families of extensions that mean the same.
FORMATS = {
    "markdown": ("md", "markdown", "mdown", "mkd"),
    "text": ("txt", "text"),
    "docx": ("docx",),
    "pdf": ("pdf",),
    "html": ("html", "htm", "xhtml"),
    "image": ("png", "jpg", "jpeg", "webp", "svg"),
}
FAMILIES = {"markdown": "md", "mdown": "md", "mkd": "md", "text": "txt", "htm": "html", "xhtml": "html", "jpeg": "jpg"}
KNOWN = tuple(e for exts in FORMATS.values() for e in exts)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased characters behind the last dot; empty without one and for hidden names with no other dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def format_of(path: Column) -> Column:
    """The format of a path by its extension, null if it has none that is supported."""
    ext, out = extension(path), F.lit(None).cast("string")
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def media_of(content: Column) -> Column:
    """png, jpeg, webp or svg by a binary's first bytes, else null."""
    head = lambda at, text: F.substring(content, at, len(text) // 2) == F.unhex(F.lit(text))
    start = F.lower(F.decode(F.translate(F.substring(content, 1, 2048).cast("string"), "�", ""), "UTF-8"))
    return (
        F.when(head(1, "89504E470D0A1A0A"), "png")
        .when(head(1, "FFD8FF"), "jpeg")
        .when(head(1, "52494646") & head(9, "57454250"), "webp")
        .when(F.contains(start, F.lit("<svg")), "svg")
    )


def family(ext: Column) -> Column:
    out = ext
    for name, same in FAMILIES.items():
        out = F.when(ext == name, same).otherwise(out)
    return out


def with_extension(path: Column, expected: str) -> Column:
    """The path with a truthful extension: kept if it means ``expected``, replaced if it claims a known other format,
    appended otherwise."""
    want = expected.strip().lstrip(".").lower()
    if not want:
        return path
    name, ext = file_name(path), extension(path)
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    bare = name.isin("", ".", "..")
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    new = (
        F.when(bare, f"cleaned.{want}")
        .when((ext == "") & F.endswith(name, F.lit(".")), F.concat(name, F.lit(want)))
        .when(ext == "", F.concat(name, F.lit(f".{want}")))
        .when(family(ext) == FAMILIES.get(want, want), name)
        .when(ext.isin(*KNOWN), F.concat(stem, F.lit(f".{want}")))
        .otherwise(F.concat(name, F.lit(f".{want}")))
    )
    return F.concat(folder, new)


def cleaned_path(path: Column, expected: str) -> Column:
    """Where the cleaned version of a file goes: ``<stem>.cleaned.<extension>`` beside it."""
    name = file_name(path)
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    stem = F.when(stem == "", F.when(name == "", "cleaned").otherwise(name)).otherwise(stem)
    stem = F.when(F.endswith(stem, F.lit(".cleaned")), stem).otherwise(F.concat(stem, F.lit(".cleaned")))
    return F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), stem, F.lit("." + expected.strip().lstrip(".").lower()))
