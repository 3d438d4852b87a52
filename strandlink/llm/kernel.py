"""Vectorised work on the UTF-8 bytes of a batch of texts.

Words are maximal runs of bytes other than space and 0x09-0x0D. Hashes are
polynomials modulo 2**64 taken from prefix sums, so that any span of a batch is
hashed in constant time, then mixed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; kept for the next batch."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and their n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def prefix(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal bytes have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


#: Bytes from which a word is hashed by itself: polynomials modulo 2**64 of strings that are built up from halves
#: and their complements agree from 1,024 bytes on.
LONG = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, by BLAKE2 where they are long."""
    out = spans(prefix(data), starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of the texts' words among them; ``outside`` marks bytes of no word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~outside[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' word n-grams, and their offsets; a text of fewer words is one n-gram."""
    counts = np.diff(offsets)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    places = np.concatenate([[0], np.cumsum(grams)])
    doc = np.repeat(np.arange(len(grams)), grams)
    start = offsets[:-1][doc] + np.arange(places[-1]) - places[:-1][doc]
    out = np.zeros(len(start), np.uint64)
    length = np.minimum(counts, n)[doc]
    for j in range(n):
        step = np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        here = length > j
        if here.all():
            out += hashes[start + j] * step
        else:
            out[here] += hashes[start[here] + j] * step
    return mix(out), places


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's sorted distinct hashes, their counts, and new offsets."""
    h = hashes.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(h)]] = True
    kept = np.flatnonzero(fresh)
    places = np.searchsorted(kept, offsets)
    return h[kept], np.diff(np.append(kept, len(h))), places


def shingle_sets(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text (A-Z lower-cased), and offsets."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, by_doc = words(data, offsets)
    sets, _, places = distinct(*ngrams(word_hashes(data, starts, ends), by_doc, n))
    return sets, places


def set_keys(sets: np.ndarray, places: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; None for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets), dtype=np.uint64)])
    other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64)])
    keys = np.stack([np.diff(total[places]), np.diff(other[places])], 1).astype(">u8")
    return [k.tobytes() if n else None for k, n in zip(keys, np.diff(places).tolist(), strict=True)]
