"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, each text scanned once.

Texts and items become lower-cased words of letters and digits. A window is ``width`` consecutive words of an item, or
the whole of a shorter item. The automaton's alphabet is word numbers, not characters, in a few digits each, so that no
node has many successors to look through: a match ends at a word's position and maps to the original text without search,
and stretches of words that no item has are not looked at. Its entries are
the items' stretches of ``(width + 1) // 2`` words, end to end: whichever window a text holds, it holds a whole stretch of
it, and there the text's windows around it are looked up among the benchmark's distinct windows. That takes one node a
word, not one for each word of each window. The benchmark is measured before it is sent: items are dealt to blocks of
bounded bytes, each block is one automaton and one scan, and a worker never holds two; usual benchmarks are one block, and
then documents are never shuffled. For more blocks the rows are written once with a number, each block's pass reads their
texts and writes numbers and matches of the rows that it hits, and one join brings these together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, SLICE_ROWS, alnum_words, free_names, own_columns, quoted, read_table, written

WIDTH = 13
#: Bytes of benchmark text in one automaton.
BLOCK_BYTES = 8 << 20
#: Bits of one digit of a word's number.
DIGIT_BITS = 6

_RUN = "array<struct<first:int,last:int>>"
_SCAN = f"n_words long, n_hit long, runs {_RUN}, places array<struct<start:int,end:int>>, items array<string>"


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items as lists of (id as text, UTF-8 text), each list of about ``block_bytes`` at most; at least one list.

    A null id is the empty string, a null text has no words and takes no part. A block is collected by itself; an item
    is never split, so a single item larger than a block makes a block of its own size.
    """
    items = benchmark.select(
        F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("id"), F.col(quoted(text_col)).alias("text")
    ).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    where = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for k in range(n):
        rows = (items.filter(where == k) if n > 1 else items).select("id", F.col("text").cast("binary")).collect()
        yield [(r["id"], bytes(r["text"])) for r in rows]


class Windows:
    """The automaton of one block of items, and their distinct windows with the sets of items that hold them.

    Both are interned: equal windows are one class with one place to compare with, equal sets of items are one set. So a
    scan's cost follows the text and the items that it returns, however often items or texts repeat a passage.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH) -> None:
        self.width, self.step, self.names = width, (width + 1) // 2, [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        stretches: set[tuple[int, ...]] = set()
        short: dict[tuple[int, ...], set[int]] = {}
        flat: list[int] = []
        begin, size, owner = [], [], []
        for k, (_, text) in enumerate(items):
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(text)]
            if len(ids) >= width:
                stretches.update(tuple(ids[at : at + self.step]) for at in range(0, len(ids) - self.step + 1, self.step))
                begin.append(len(flat))
                size.append(len(ids) - width + 1)
                owner.append(k)
                flat += ids
            elif ids:
                short.setdefault(tuple(ids), set()).add(k)
        self.flat = np.array(flat, np.int32)
        self._intern(np.array(begin, np.int64), np.array(size, np.int64), np.array(owner, np.int32))
        self.digits = max(1, -(-len(self.number).bit_length() // DIGIT_BITS))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        entries = stretches | short.keys()
        for entry in entries:
            held = self._set_number(np.array(sorted(short[entry]), np.int32)) if entry in short else -1
            self.automaton.add_word(self._symbols(np.array(entry, np.int32)), (len(entry), entry in stretches, held))
        self.least = min(map(len, entries), default=0)
        if self.least:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; runs of hit words (first and last, counted from 0, disjoint and in order); item ids."""
        words = alnum_words(text)
        if not self.least or len(words) < self.least:
            return len(words), [], set()
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int32, len(words))
        runs: list[tuple[int, int]] = []
        sets: set[int] = set()
        found: list[int] = []
        for first, end, is_stretch, held in self._matches(ids):
            if held >= 0:
                runs.append((first, end))
                sets.add(held)
            if is_stretch:
                found.append(first)
        if found:
            starts, kinds = self._occurring(ids, np.array(found, np.int64))
            cut = np.flatnonzero(np.diff(starts) > self.width) + 1
            if len(starts):
                runs += zip(starts[np.r_[0, cut]].tolist(), (starts[np.r_[cut - 1, len(starts) - 1]] + self.width - 1).tolist())
            sets.update(np.unique(self.held_by[kinds]).tolist())
        members = np.unique(np.concatenate([self.sets[k] for k in sets])).tolist() if sets else []
        return len(words), merged(runs), {self.names[k] for k in members}

    def _intern(self, begin: np.ndarray, size: np.ndarray, owner: np.ndarray) -> None:
        """Classes of equal windows in order of their hash (``hashes``, ``at``: a place of it, ``held_by``: its set)."""
        self.sets: list[np.ndarray] = []
        self._numbers: dict[bytes, int] = {}
        before = np.cumsum(size) - size
        places = np.arange(size.sum()) - np.repeat(before - begin, size)
        owners = np.repeat(owner, size)
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        while True:
            self.hashes, first, kind = np.unique(self._hashes(self.flat, places), return_index=True, return_inverse=True)
            self.at = places[first]
            # Different windows of one hash would be one class: another factor is taken until there are none.
            if all((self.flat[places + k] == self.flat[self.at[kind] + k]).all() for k in range(self.width)):
                break
            self.factor = np.uint64((int(self.factor) * 6364136223846793005 + 2) % (1 << 64))
        pairs = np.unique(kind.astype(np.int64) * max(1, len(self.names)) + owners)
        kinds, members = pairs // max(1, len(self.names)), (pairs % max(1, len(self.names))).astype(np.int32)
        edges = np.searchsorted(kinds, np.arange(len(self.hashes) + 1))
        self.held_by = np.fromiter(
            (self._set_number(members[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())), np.int32, len(self.hashes)
        )

    def _set_number(self, members: np.ndarray) -> int:
        number = self._numbers.setdefault(members.tobytes(), len(self.sets))
        if number == len(self.sets):
            self.sets.append(members)
        return number

    def _hashes(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(self.width):
            out = out * self.factor + ids[starts + k].astype(np.uint64)
        return out

    def _occurring(self, ids: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and classes of the benchmark's windows among those of the text around the stretches at ``found``.

        Every window is looked up once, whatever the number of stretches in it, and compared word by word.
        """
        near = np.zeros(len(ids), bool)
        for back in range(self.width - self.step + 1):
            near[found[found >= back] - back] = True
        starts = np.flatnonzero(near[: max(0, len(ids) - self.width + 1)])
        wanted = self._hashes(ids, starts)
        kinds = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        same = self.hashes[kinds] == wanted
        for k in range(self.width):
            same &= self.flat[self.at[kinds] + k] == ids[starts + k]
        return starts[same], kinds[same]

    def _symbols(self, ids: np.ndarray) -> tuple[int, ...]:
        """Word numbers as digits; each place has digits of its own, so entries match whole words only."""
        places = [(ids >> DIGIT_BITS * k & (1 << DIGIT_BITS) - 1) + (k << DIGIT_BITS) for k in range(self.digits)]
        return tuple(np.stack(places, axis=1).ravel().tolist())

    def _matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, bool, int]]:
        """(first word, last word, is a stretch, set of short items or -1) of each entry in the text, stretch by stretch
        of known words."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        begin, stop = edge[::2], edge[1::2]
        long = stop - begin >= self.least
        for lo, hi in zip(begin[long].tolist(), stop[long].tolist()):
            for at, (size, is_stretch, held) in self.automaton.iter(self._symbols(ids[lo:hi])):
                end = lo + at // self.digits
                yield end - size + 1, end, is_stretch, held


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs as disjoint ones in order; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of the original text that runs of words cover, end exclusive."""
    at = [m.span() for m in _WORD.finditer(text)] if runs else []
    return [(at[a][0], at[b][1]) for a, b in runs]


_KIND = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
    ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
])


def _as_row(text: bytes | None, n_words: int, runs: list[tuple[int, int]], items: set[str]) -> dict:
    places = original_spans(text.decode("utf-8", "replace"), runs) if runs else []
    return {
        "n_words": n_words, "n_hit": sum(b - a + 1 for a, b in runs), "runs": [{"first": a, "last": b} for a, b in runs],
        "places": [{"start": a, "end": b} for a, b in places], "items": sorted(items),
    }


def scan_column(items: list[tuple[str, bytes]], width: int = WIDTH):
    """Arrow function of a binary text column: the scan."""

    @F.arrow_udf(_SCAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = Windows(items, width)
        for texts in batches:
            parts = (texts.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(texts), SLICE_ROWS))
            yield pa.array([_as_row(t, *windows.scan(t)) for part in parts for t in part], _KIND)

    return scan


def united_column():
    """Arrow function of a binary text column and of the runs and items of all blocks (null where none hit): the scan."""

    @F.arrow_udf(_SCAN)
    def united(texts: pa.Array, runs: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), SLICE_ROWS):
            for text, found, names in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in (texts, runs, items))):
                out.append(_as_row(text, len(alnum_words(text)), merged([(r["first"], r["last"]) for r in found or ()]), set(names or ())))
        return pa.array(out, _KIND)

    return united


def scanned(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, out: str = "__scan"
) -> DataFrame:
    """``docs`` with ``out`` (n_words, n_hit, runs, places, items): words, hit words, runs of hit words, their places in
    code points of the text as it stands, and sorted ids of items with occurring windows.

    One block: one narrow pass. Several: rows are written once under a number of their own, so repeated rows and null
    ids need no care; each block writes only what it finds, and one join by number unites that. A benchmark without words
    hits nothing. Bytes that are not UTF-8 belong to words and count as replacement characters.
    """
    blocks = blocks_of(benchmark, block_bytes=block_bytes)
    items, following = next(blocks), next(blocks, None)
    text = F.col(quoted(text_col)).cast("binary")
    if following is None:
        return docs.withColumn(out, scan_column(items, width)(text))
    row, runs, names = free_names(docs, "row", "runs", "names")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = None
    for items in itertools.chain((items, following), blocks):
        scan = rows.select(row, scan_column(items, width)(text).alias("scan"))
        hit = written(scan.filter("scan.n_hit > 0").select(row, "scan.runs", "scan.items"))
        hits = hit if hits is None else hits.union(hit)
    one = hits.groupBy(row).agg(F.flatten(F.collect_list("runs")).alias(runs), F.flatten(F.collect_list("items")).alias(names))
    return rows.join(one, row, "left").select(*own_columns(docs), united_column()(text, F.col(runs), F.col(names)).alias(out))


def is_contaminated(scan: Column) -> Column:
    """The contract's rule: a twentieth of the words or more are hit."""
    return (scan["n_hit"] > 0) & (20 * scan["n_hit"] >= scan["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, columns unchanged; null and empty texts stay."""
    (scan,) = free_names(docs, "scan")
    return scanned(docs, benchmark, text_col, out=scan).filter(~is_contaminated(F.col(scan))).drop(scan)


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, end, passage)``: every stretch of a text that stands in the benchmark, as it stands in the text."""
    found = scanned(docs.select(quoted(id_col), quoted(text_col)), benchmark, text_col, out="__scan")
    each = found.select(quoted(id_col), F.col(quoted(text_col)).alias("__text"), F.inline("__scan.places"))
    return each.select(quoted(id_col), "start", "end", F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start")).alias("passage"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: hit words and items of every document."""
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    scan = F.col("__scan")
    return scanned(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        scan["n_words"].alias("n_words"),
        scan["n_hit"].alias("n_hit"),
        F.size(scan["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(scan["items"], ","), 256).alias("items_sha256"),
        is_contaminated(scan).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{ALNUM_WORD}')"


ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_sql_words('text')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_sql_words('text')} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM starts),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
grams AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM places),
hits AS (SELECT r, n, i, item FROM grams JOIN win USING (n, g)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN names USING (r)
"""
