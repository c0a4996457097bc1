"""Words and word shingles of whole texts as 64-bit hashes, by array operations over the bytes of a text.

A word's hash is a polynomial over values drawn for its bytes, read off from running sums, so its cost is some array
operations a byte and no Python step a word. Two different words share a hash with a probability of about 2^-64.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes of a text that are hashed at a time; a longer word is hashed whole.
BLOCK = 1 << 20

#: Kinds of bytes: part of a word, between words, between pieces of text.
WORD, GAP, BREAK = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled one to one, so that all its bits depend on all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _values() -> np.ndarray:
    """A value for each byte, those of A-Z like a-z."""
    v = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    v[0x41:0x5B] = v[0x61:0x7B]
    return v


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2^64."""
    base = 0xD1342543DE82EF95
    pair = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        pair.append(np.multiply.accumulate(steps))
    return pair[0], pair[1]


@cache
def kinds(breaks: bytes = b"", gaps: bytes = b" \t\n\x0b\x0c\r") -> np.ndarray:
    """Table of the kind of each byte."""
    table = np.zeros(256, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


def words(text: bytes | None, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a text, A-Z lower-cased, the number of the piece in which each stands, its start and end."""
    raw = np.frombuffer(text or b"", np.uint8)
    kind = (kinds() if table is None else table)[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == WORD
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        span = int(ends[upto - 1] - low)
        power, inverse = _powers(BLOCK if span <= BLOCK else 1 << span.bit_length())
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum(_values()[raw[low : low + span]] * power[:span], out=sums[1:])
        a, b = starts[at:upto] - low, ends[at:upto] - low
        out[at:upto] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = upto
    pieces = np.cumsum(kind == BREAK)[starts] if (kind == BREAK).any() else np.zeros(len(starts), np.int64)
    return mixed(out), pieces, starts, ends


def joined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` words in a row; sizes do not clash with one another."""
    n = len(hashes) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of ``size`` words in ascending order; a shorter text is one, no words are none."""
    found = words(text)[0]
    return np.unique(joined(found, min(size, len(found)))) if len(found) else found
