"""Vectorised word splitting and hashing of Arrow string columns (NumPy, no per-word Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes, so that memory stays bounded.
SLICE_BYTES = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambling."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        made = []
        for x in (_BASE, _INVERSE):
            step = np.full(max(n, SLICE_BYTES + 65536), x, dtype=np.uint64)
            step[0] = 1
            made.append(np.cumprod(step))
        _POWERS = (made[0], made[1])
    return _POWERS


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: Bytes that end a word: blank and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes outside of letters, digits and non-ASCII characters.
NOT_WORD = np.zeros(256, dtype=bool)
NOT_WORD[:128] = True
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) for runs of rows of about `most` bytes; a longer text is a run of its own."""
    raw, off = buffer_of(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def split(raw: np.ndarray, off: np.ndarray, ends_word: np.ndarray = SPACE):
    """Word starts, word ends (bytes) and n+1 word offsets by text. No word spans two texts."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~ends_word[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, ASCII letters folded to lower case."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    n = len(raw)
    p, inverse = _powers(n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[raw]] * p[:n], out=s[1:])
    return mix((s[ends] - s[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and n+1 offsets by text; a text of fewer words is one run of its own."""
    n = len(words)
    counts = np.diff(off)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_off = np.zeros(len(off), np.int64)
    np.cumsum(made, out=out_off[1:])
    if n == 0:
        return np.zeros(0, np.uint64), out_off
    full = max(n - k + 1, 0)
    h = np.zeros(full, np.uint64)
    for j in range(k):
        h = mix(h * _BASE + words[j : j + full])
    doc = np.repeat(np.arange(len(counts)), made)
    at = off[doc] + (np.arange(out_off[-1]) - out_off[doc])
    short = np.flatnonzero((counts > 0) & (counts < k))
    out = np.zeros(out_off[-1], np.uint64)
    long_rows = counts[doc] >= k
    out[long_rows] = h[at[long_rows]]
    for d in short:
        x = np.full(1, 0x5851F42D + int(counts[d]), np.uint64)
        for w in words[off[d] : off[d + 1]]:
            x = mix(x * _BASE + w)
        out[out_off[d]] = x[0]
    return out, out_off


def shingle_sets(col: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every text."""
    for a, raw, off in slices(col):
        starts, ends, woff = split(raw, off)
        h, hoff = shingle_hashes(word_hashes(raw, starts, ends), woff, k)
        for d in range(len(off) - 1):
            x = np.sort(h[hoff[d] : hoff[d + 1]])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
            yield a + d, x
