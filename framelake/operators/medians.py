"""Medians of square windows over a block: compare-exchange networks for small ones, sums of ranks for large ones."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Windows up to this size go through a network.
NETWORK_SIZE = 5
#: Rows are worked on in strips of about so many pixels, whose values stay in a core's cache.
STRIP = 4096
#: Windows of this size or more go by ranks, in squares of SQUARE places whose ranks make so many groups.
RANKED_SIZE, SQUARE, GROUPS = 15, 64, 64


@lru_cache(maxsize=16)
def network(n: int, wanted: int) -> tuple[tuple[int, int, bool, bool], ...]:
    """Exchanges (i, j, whether the lesser at i is needed, whether the greater at j is) that bring the value of rank `wanted`
    among n to that place: Batcher's odd-even merge sort, less what that place doesn't depend on."""
    pairs, p = [], 1
    while p < n:
        k = p
        while k:
            pairs += [(j + i, j + i + k) for j in range(
                k % p, n - k, 2 * k,
            ) for i in range(min(k, n - j - k)) if (i + j) // (2 * p) == (i + j + k) // (2 * p)]
            k //= 2
        p *= 2
    needed, kept = {wanted}, []
    for i, j in reversed(pairs):
        if i in needed or j in needed:
            kept.append((i, j, i in needed, j in needed))
            needed |= {i, j}
    return tuple(reversed(kept))


def by_network(block: np.ndarray, rows: int, cols: int, size: int) -> np.ndarray:
    """Medians without NaN in the block."""
    out, step = np.empty((rows, cols)), max(1, STRIP // cols)
    exchanges = network(size * size, size * size // 2)
    for a in range(0, rows, step):
        n = min(step, rows - a)
        values = [block[a + y : a + y + n, x : x + cols] for y in range(size) for x in range(size)]
        for i, j, less, more in exchanges:
            low, high = values[i], values[j]
            if less:
                values[i] = np.minimum(low, high)
            if more:
                values[j] = np.maximum(low, high)
        out[a : a + n] = values[size * size // 2]
    return out


def by_partition(block: np.ndarray, rows: int, cols: int, size: int) -> np.ndarray:
    """Medians of windows gathered one by one; NaN counts as the greatest value."""
    out, middle = np.empty((rows, cols)), size * size // 2
    step = max(1, (8 << 20) // (cols * size * size * 8))
    for a in range(0, rows, step):
        b = min(a + step, rows)
        v = np.lib.stride_tricks.sliding_window_view(block[a : b + size - 1, : cols + size - 1], (size, size))
        out[a:b] = np.partition(v.reshape(b - a, cols, size * size), middle, axis=2)[:, :, middle]
    return out


def _box_sums(inside: np.ndarray, size: int) -> np.ndarray:
    """Numbers of marked pixels in all windows."""
    down = np.zeros((inside.shape[0] + 1, inside.shape[1]), np.int32)
    np.cumsum(inside, axis=0, out=down[1:])
    down = down[size:] - down[:-size]
    across = np.zeros((down.shape[0], down.shape[1] + 1), np.int32)
    np.cumsum(down, axis=1, out=across[:, 1:])
    return across[:, size:] - across[:, :-size]


def _by_ranks(sub: np.ndarray, size: int) -> np.ndarray:
    middle, width = size * size // 2, sub.shape[1]
    order = np.argsort(sub, axis=None, kind="stable")
    values, step = sub.reshape(-1)[order], -(-sub.size // GROUPS)
    group = np.empty(sub.size, np.uint8)
    group[order] = np.arange(sub.size) // step
    group = group.reshape(sub.shape)
    rows, cols = sub.shape[0] - size + 1, width - size + 1
    upto, out = np.zeros((rows, cols), np.int32), np.empty((rows, cols))
    missing = rows * cols
    for g in range(GROUPS):
        n = _box_sums(group == g, size)
        here = (upto <= middle) & (upto + n > middle)
        qy, qx = np.nonzero(here)
        if len(qy):
            missing -= len(qy)
            left = middle - upto[qy, qx]
            py, px = np.divmod(order[g * step : (g + 1) * step].astype(np.int32), np.int32(width))
            most = max(1, (1 << 19) // step)
            for a in range(0, len(qy), most):
                y, x = qy[a : a + most, None].astype(np.int32), qx[a : a + most, None].astype(np.int32)
                # one comparison a side: a difference below 0 is a large unsigned number
                inside = ((py - y).view(np.uint32) < size) & ((px - x).view(np.uint32) < size)
                rank = np.argmax(np.cumsum(inside, axis=1, dtype=np.int16 if step < 1 << 15 else np.int32) > left[a : a + most, None], axis=1)
                out[qy[a : a + most], qx[a : a + most]] = values[g * step + rank]
            if not missing:
                break
        upto += n
    return out


def by_ranks(block: np.ndarray, rows: int, cols: int, size: int) -> np.ndarray:
    """Medians by ranks; NaN counts as the greatest value.

    Of every square of SQUARE places, the pixels are ranked and the ranks put into groups. Sums over windows, moved by row
    and column, tell for each place how many pixels of each group its window has, and so the group of the median; of that
    group the pixels inside the window are counted in order of rank."""
    out = np.empty((rows, cols))
    for y in range(0, rows, SQUARE):
        for x in range(0, cols, SQUARE):
            h, w = min(SQUARE, rows - y), min(SQUARE, cols - x)
            out[y : y + h, x : x + w] = _by_ranks(np.ascontiguousarray(block[y : y + h + size - 1, x : x + w + size - 1]), size)
    return out


def median(block: np.ndarray, rows: int, cols: int, size: int) -> np.ndarray:
    """Medians of the windows of size x size that begin at each of rows x cols places of a block; the upper middle of an even
    number of values, NaN counting as the greatest."""
    if size >= RANKED_SIZE:
        return by_ranks(block, rows, cols, size)
    if size > NETWORK_SIZE or np.isnan(block).any():
        return by_partition(block, rows, cols, size)
    return by_network(block, rows, cols, size)
