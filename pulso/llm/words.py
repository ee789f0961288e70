"""Vectorised words and hashes over Arrow string batches.

A batch of texts is one UTF-8 byte buffer plus offsets, so splitting into words
and hashing them are a few array passes over the bytes, never a loop over
characters. Both word definitions used here separate words by ASCII bytes only,
so working on UTF-8 bytes gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20            # bytes hashed or sliced at a time
_MUL = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A byte of a word, by definition: anything but ASCII white space; or ASCII
#: letters (lower-cased first), digits and everything outside ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_MUL ** i`` and its inverse mod 2**64 for i < n, kept and grown."""
    if not _POW or len(_POW[0]) < n:
        n = max(n, CHUNK + (CHUNK >> 3))
        out = []
        for base in (_MUL, pow(_MUL, -1, 1 << 64)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _POW[:] = out
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; null counts as ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or
                             pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (one row at least)."""
    offs = flat(batch.column(batch.schema.get_field_index(column)))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return _LOWER[data]


def bounds(low: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (and the
    count after the last). ``word``: which bytes belong to words."""
    n = len(low)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = word[low]
    edge = offs[(offs > 0) & (offs < n)]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[edge - 1] = w[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hash_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, wherever it stands. Words must be in
    order and apart; memory is bounded by CHUNK and the longest word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        hi = int(ends[j - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[low[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def hash_bytes(word: bytes) -> int:
    """The hash that ``hash_words`` gives one word."""
    a = np.frombuffer(word, np.uint8)
    return int(hash_words(a, np.array([0]), np.array([len(a)]))[0])


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within one text, and the index of its
    first word. ``first`` as from ``bounds``."""
    total = len(h)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        key += h[j:total - n + 1 + j] * np.uint64(pow(_MUL, j + 1, 1 << 64))
    ok = np.ones(total - n + 1, bool)
    inner = first[(first > 0) & (first < total)]
    for j in range(1, n):                     # a run may not reach over a text's start
        k = inner - j
        ok[k[(k >= 0) & (k < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(key[at]), at
