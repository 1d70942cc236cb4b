"""Tiles on the move: where pixels go, and one exchange that cuts tiles at the lines of a new grid."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from framelake.errors import FrameError
from framelake.frames import Frames
from framelake.tiles import PART_SCHEMA, TILE_SCHEMA, Tile, map_tiles, merge_parts


@dataclass(frozen=True)
class Placement:
    """Where the pixel y, x goes: to row sy * (x if swap else y) + oy and column sx * (y if swap else x) + ox, if that lies in
    a frame of height x width; else it is left out."""

    height: int
    width: int
    oy: int = 0
    ox: int = 0
    sy: int = 1
    sx: int = 1
    swap: bool = False

    def then(self, after: Placement) -> Placement:
        """Both in one: what `after` makes of the frames that self makes."""
        sy, oy, sx, ox = (self.sx, self.ox, self.sy, self.oy) if after.swap else (self.sy, self.oy, self.sx, self.ox)
        return Placement(
            after.height, after.width, after.sy * oy + after.oy, after.sx * ox + after.ox, after.sy * sy, after.sx * sx,
            self.swap != after.swap,
        )

    @property
    def shifts(self) -> bool:
        """Whether it is a crop and nothing else."""
        return not self.swap and self.sy == self.sx == 1

    def keeps_grid(self, tile: int) -> bool:
        """Whether every tile of a grid goes whole, or cut at the frame's new edges, to one tile of the new grid."""
        return all((o if s > 0 else o + 1) % tile == 0 for s, o in ((self.sy, self.oy), (self.sx, self.ox)))

    def move(self, tile: Tile) -> tuple[int, int, np.ndarray]:
        """Row and column of a tile's first pixel in its new place, and the tile as it lies there (a view)."""
        y0, x0, a = tile[5], tile[6], tile[7]
        if self.swap:
            y0, x0, a = x0, y0, a.T
        h, w = a.shape
        y = y0 + self.oy if self.sy > 0 else self.oy - (y0 + h - 1)
        x = x0 + self.ox if self.sx > 0 else self.ox - (x0 + w - 1)
        return y, x, a[:: self.sy, :: self.sx]


def stay(frames: Frames) -> Placement:
    return Placement(frames.height, frames.width)


def is_tiled(frames: Frames) -> bool:
    if "pixels" in frames.df.columns and not frames.tile:
        raise FrameError("the tile size of a tile table is needed")
    return "pixels" in frames.df.columns


def _cells(first: int, length: int, radius: int, start: int, n: int, size: int) -> Iterator[tuple[int, int, int]]:
    """Of pixels first to first + length - 1 on one axis, the run (begin, end) that each cell (number) of a grid takes.

    The grid has cells of `size` on n pixels from `start`, each taking `radius` pixels more on both sides."""
    end = first + length
    for t in range(max((first - radius - start) // size, 0), min((end - 1 + radius - start) // size, (n - 1) // size) + 1):
        a = max(first, start + t * size - radius)
        b = min(end, start + min((t + 1) * size, n) + radius)
        if a < b:
            yield t, a, b


def deal(frames: Frames, place: Placement, window: Placement, size: int, radius: int = 0) -> Callable[[Tile], Iterator[Tile]]:
    """Parts of a tile, moved by `place` and cut for the cells (of `size`, with `radius` pixels around) of a grid over the
    window, which is a crop of the moved frame. ty and tx are those of the cell, y0 and x0 lie in the moved frame."""
    top, left = -window.oy, -window.ox

    def parts(tile: Tile) -> Iterator[Tile]:
        y, x, a = place.move(tile)
        # what `place` leaves out stays out
        cut_y, cut_x = max(0, -y), max(0, -x)
        a = a[cut_y : max(cut_y, place.height - y), cut_x : max(cut_x, place.width - x)]
        if not a.size:
            return
        y, x = y + cut_y, x + cut_x
        for ty, y1, y2 in _cells(y, a.shape[0], radius, top, window.height, size):
            for tx, x1, x2 in _cells(x, a.shape[1], radius, left, window.width, size):
                yield (*tile[:3], ty, tx, y1, x1, a[y1 - y : y2 - y, x1 - x : x2 - x])

    return parts


def assemble(group: list[Tile], top: int, left: int, shape: tuple[int, int], fill: float = np.nan) -> np.ndarray:
    """The block of a shape at top, left from its parts."""
    block = np.full(shape, fill)
    for *_, y, x, a in group:
        block[y - top : y - top + a.shape[0], x - left : x - left + a.shape[1]] = a
    return block


def covered(group: list[Tile], rows: int, cols: int) -> bool:
    return sum(t[-1].size for t in group) == rows * cols


def retile(frames: Frames, place: Placement, size: int | None = None) -> Frames:
    """Frames moved by a placement, on whole tiles of the new grid (of `size`, the old one's by default).

    Where the grid stays, tiles are turned and cut where they are; else parts of tiles go through one shuffle. A tile with a
    missing or a repeated part raises."""
    size = size or frames.tile
    parts = deal(frames, place, Placement(place.height, place.width), size)
    done = frames.with_(frames.df, height=place.height, width=place.width, tile=size)
    if size == frames.tile and place.keeps_grid(size):
        return done.with_(map_tiles(frames.df, parts, TILE_SCHEMA))
    if frames.df.isStreaming:
        raise FrameError("tiles of a stream can be moved only where the grid stays: a new tile's parts may come apart")
    height, width = place.height, place.width

    def tile_of(group: list[Tile]) -> Tile:
        key, (y, x) = group[0][:5], (group[0][3] * size, group[0][4] * size)
        rows, cols = min(size, height - y), min(size, width - x)
        if not covered(group, rows, cols):
            raise FrameError(f"a tile at {y}, {x} of frame {key[1]} lacks pixels or has some twice")
        return (*key, y, x, assemble(group, y, x, (rows, cols)))

    return done.with_(merge_parts(map_tiles(frames.df, parts, PART_SCHEMA), tile_of))


def _mirrored_positions(first: int, length: int, n: int) -> np.ndarray:
    """Positions first to first + length - 1 mirrored into 0 to n - 1, edge pixels twice."""
    m = np.arange(first, first + length) % (2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def on_blocks(
    frames: Frames, radius: int, mirrored: bool, fill: float, kernel: Callable[[np.ndarray, int, int], np.ndarray],
    before: Placement | None = None, after: Placement | None = None,
) -> Frames:
    """kernel(block, rows, cols) on every tile with `radius` pixels around; edges of frames are mirrored or filled.

    before: a placement that moves the frames first. after: a crop of the result; what isn't kept is neither shuffled nor
    computed, and what lies around it still counts as neighbour. All of it is one shuffle of tiles and strips."""
    before = before or stay(frames)
    after = after or Placement(before.height, before.width)
    height, width, tile = before.height, before.width, frames.tile
    top, left = -after.oy, -after.ox

    def tile_of(group: list[Tile]) -> Tile:
        key = group[0][:5]
        y, x = top + key[3] * tile, left + key[4] * tile
        rows, cols = min(tile, after.height - key[3] * tile), min(tile, after.width - key[4] * tile)
        block = assemble(group, y - radius, x - radius, (rows + 2 * radius, cols + 2 * radius), fill)
        if mirrored and (y < radius or x < radius or y + rows + radius > height or x + cols + radius > width):
            down, right = (
                _mirrored_positions(p - radius, n + 2 * radius, full) - (p - radius) for p, n,
                full in ((y, rows, height), (x, cols, width))
            )
            block = block[np.ix_(down, right)]
        return (*key, key[3] * tile, key[4] * tile, kernel(block, rows, cols))

    parts = map_tiles(frames.df, deal(frames, before, after, tile, radius), PART_SCHEMA)
    return frames.with_(merge_parts(parts, tile_of), height=after.height, width=after.width)


