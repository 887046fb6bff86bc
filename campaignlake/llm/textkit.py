"""Word and shingle hashing over whole Arrow text columns with numpy; no loop over documents or words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

MASK48 = np.uint64((1 << 48) - 1)
SLICE_BYTES = 1 << 20
SLICE_DOCS = 1 << 15

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [np.uint64(x) for x in (_rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1))]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (public-domain splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table, True where a byte belongs to a word; `ranges` are the inclusive ranges of separators."""
    keep = np.ones(256, bool)
    for a, b in ranges:
        keep[a : b + 1] = False
    return keep


#: Words [^\x20\x09-\x0D]+ and words of letters and digits, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower case.
SPACED = separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE_BYTES, which bound the memory that the arrays below take."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1
        j = max(i + 1, min(j, i + SLICE_DOCS, n))
        yield i, j
        i = j


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..size-1."""
    out = []
    for base in (_BASE, _INVERSE):
        steps = np.full(size, np.uint64(base), np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; tables of the usual size are kept, of larger ones nothing is."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    return _powers(size) if size <= 2 * SLICE_BYTES else _powers.__wrapped__(size)


def word_edges(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of each word, and the index of each text's first word (one more at the end)."""
    k = keep[data]
    first, last = k.copy(), k.copy()
    first[1:] &= ~k[:-1]
    last[:-1] &= ~k[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = k[inner]
    last[inner - 1] = k[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z read as a-z. Bytes are taken in chunks that end at a word's end."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        n = hi - lo
        pw, inv = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * pw[:n], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        a = b
    return mixed(out)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of k words; a text of fewer words, but not none, is one shingle."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - k + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += words[j : j + n] * _STEP[j]
        whole = np.arange(n) + k <= bounds[1:][text[:n]]
        texts, hashes = text[:n][whole], h[whole]
    else:
        texts, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            there = counts[short] > j
            s[there] += words[bounds[short[there]] + j] * _STEP[j]
        s += counts[short].astype(np.uint64) * _STEP[k]
        texts, hashes = np.concatenate([texts, short]), np.concatenate([hashes, s])
    return texts, mixed(hashes)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of each text, ascending within a text, and their bounds (for at most 2^15 texts)."""
    starts, ends, bounds = word_edges(data, offsets, keep)
    texts, hashes = shingle_hashes(word_hashes(data, starts, ends), bounds, k)
    keys = np.sort((texts.astype(np.uint64) << np.uint64(48)) | (hashes & MASK48))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    n = len(offsets) - 1
    edges = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))
    return keys & MASK48, edges


def packed(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers of `width` bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    n = len(raw) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)
