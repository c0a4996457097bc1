"""Periodic runs of words in whole texts: stretches that repeat a period at least four times over.

Lags are counted before any place is looked at. At lag q a text has as many matches as there are pairs of equal words q
apart: for frequent words these are read off an autocorrelation by FFT (exact after rounding), for rare words from the
differences of their places. A run of period q brings at least ``max(6 - q, 3 q)`` matches in a row, so only lags with
enough matches are scanned for islands, in ascending order; a stretch with a smaller period is found there first. Where a
run of smaller period d is known, no run of period q overlaps it by d + q words or more, so its inside is scanned no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sliced

#: A run has at least this many words, and its period this many times.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Numbers that one autocorrelation of several words holds at a time; places paired at a time.
FFT_CELLS = 1 << 22


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """For each lag up to ``most`` the number of pairs of equal values that far apart; cell 0 is unused."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    place = order.astype(np.int64)
    sizes = np.bincount(ids)
    ends = np.cumsum(sizes)
    total = np.zeros(most + 1, np.int64)
    width = 1 << (n + most).bit_length()
    # A value of c places costs an FFT of the text's length, or up to c^2 / 2 differences.
    heavy = sizes > max(24, int(np.sqrt(width * np.log2(width + 1)) / 2))
    spectrum = np.zeros(width // 2 + 1)
    loud = np.flatnonzero(heavy).tolist()
    step = max(1, FFT_CELLS // width)
    for lo in range(0, len(loud), step):
        marks = np.zeros((min(step, len(loud) - lo), width))
        for row, value in enumerate(loud[lo : lo + step]):
            marks[row, place[ends[value] - sizes[value] : ends[value]]] = 1
        waves = np.fft.rfft(marks)
        spectrum += (waves.real**2 + waves.imag**2).sum(axis=0)
    if loud:
        total += np.rint(np.fft.irfft(spectrum, width)[: most + 1]).astype(np.int64)
    quiet = ~heavy[ids[order]]
    place, value = place[quiet], ids[order][quiet]
    at = np.arange(len(place))
    k = 1
    while len(at := at[at + k < len(place)]):  # the k-th next place of the same value, while any is near enough
        gap = np.where(value[at + k] == value[at], place[at + k] - place[at], most + 1)
        near = gap <= most
        at = at[near]
        total += np.bincount(gap[near], minlength=most + 1)
        k += 1
    total[0] = 0
    return total


def _open(found: list[tuple[int, int, int]], q: int, n: int) -> list[tuple[int, int]]:
    """Stretches of the text that may hold a run of period ``q``: the insides of longer runs of smaller periods cut it."""
    parts, at = [], 0
    for start, length, d in sorted(x for x in found if x[1] >= x[2] + q):
        parts.append((at, start + d + q - 1))
        at = max(at, start + length - d - q + 1)
    parts.append((at, n))
    return [(a, min(b, n)) for a, b in parts if min(b, n) - a >= max(LEAST_WORDS, LEAST_TIMES * q)]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period. A run's period is its smallest, its length at least
    six words and four periods, and it goes as far either way as its period does."""
    n = len(ids)
    most = n // LEAST_TIMES
    if n < LEAST_WORDS:
        return []
    counts = lag_counts(ids, most)
    lags = np.arange(most + 1)
    enough = np.flatnonzero(counts >= np.maximum(LEAST_WORDS - lags, (LEAST_TIMES - 1) * lags))
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    for q in enough[enough > 0].tolist():
        # Matches at this lag inside longer runs whose period divides it: a new run has less than d of them at either end.
        inside = sum(length - q for _, length, d in found if q % d == 0 and length >= d + q)
        if q > 1 and counts[q] - inside < 2 * q:
            continue
        for low, high in _open(found, q, n):
            same = np.zeros(high - low - q + 2, np.int8)
            same[1:-1] = ids[low : high - q] == ids[low + q : high]
            turns = np.flatnonzero(np.diff(same))
            starts, lengths = turns[::2] + low, turns[1::2] - turns[::2] + q
            for k in np.flatnonzero(lengths >= max(LEAST_WORDS, LEAST_TIMES * q)).tolist():
                start, length = int(starts[k]), int(lengths[k])
                if (start, length) not in known:
                    known.add((start, length))
                    found.append((start, length, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    names: dict[bytes, int] = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without what runs repeat: of each run only its first period stays, unless another run drops that too."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        gone[start + q] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", looped: bool = False) -> DataFrame:
    """Per row: the id, ``runs`` (array of start, length, period) and the text without repetitions, its words joined by a
    space (``collapsed``).

    Null and empty texts and texts of less than six words have no runs; nothing but words is kept of a text. Rows stay as
    many as they are; columns besides the two named are not read. ``looped`` first plants a loop in a tenth of the
    texts, by their id (see ``query``).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                out, texts = [], []
                for part in sliced(iter([some.select(["name", "text"])])):
                    for name, text in zip(*part):
                        words = (text or b"").split()
                        if looped:
                            words = with_loop(words, name)
                        found = runs(numbered(words))
                        out.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                        texts.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, run_type), pa.array(texts, pa.binary())], names=["id", "runs", "text"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{id_col}`").cast("string").cast("binary").alias("name"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, text binary")
    return found.select(F.col("id").alias(id_col), "runs", F.col("text").cast("string").alias("collapsed"))


def with_loop(words: list[bytes], name: bytes | None) -> list[bytes]:
    """The words, for a tenth of all names with a stretch that repeats to the end of the text; null is no name."""
    h, n = crc32(name or b""), len(words)
    if name is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document's runs and what collapsing them leaves, as digests."""
    found = periodic(read_table(spark, sf_dir, "documents"), looped=True)
    # The greatest length / period: length * 2^k / period would round, so ratios are compared by cross products.
    beats = lambda a, b: (b.length * a.period > a.length * b.period) | ((b.length * a.period == a.length * b.period) & (F.struct(b.start, b.period) < F.struct(a.start, a.period)))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(beats(a, b), b).otherwise(a))
    top = F.when(F.size("runs") > 0, best)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


ORACLE = r"""
WITH named AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h
  FROM documents
), sized AS (
  SELECT doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM named
), looped AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] ELSE w[1 + i] END)
    ELSE w END AS w FROM sized
), words AS (
  SELECT doc_id, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM looped
), matches AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length
), best AS (
  SELECT a.* FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.doc_id = a.doc_id AND (b.length * a.period > a.length * b.period
    OR (b.length * a.period = a.length * b.period AND (b.start < a.start OR (b.start = a.start AND b.period < a.period)))))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id
)
SELECT l.doc_id, coalesce(r.n_runs, 0) AS n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period AS exponent_milli,
  sha256(coalesce(r.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM looped l LEFT JOIN lines r USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
