"""Tile rows in Arrow batches: tiles as NumPy views, runs of rows of one key, and batches of tiles made anew."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEYS = ["dataset_id", "frame_no", "channel", "ty", "tx"]
PLACE = ["y0", "x0", "h", "w"]
_HEAD = "dataset_id string, frame_no long, channel int, ty int, tx int, y0 int, x0 int, h int, w int"
TILE_SCHEMA = f"{_HEAD}, pixels array<double>"
#: Parts of tiles on their way through a shuffle carry their pixels as bytes, which Spark copies and never looks into.
PART_SCHEMA = f"{_HEAD}, pixels binary"
_TYPES = [pa.string(), pa.int64(), *[pa.int32()] * 7]
#: A batch is sent on when it has so many pixels.
BATCH_PIXELS = 1 << 21

#: dataset_id, frame_no, channel, ty, tx, y0, x0 and pixels (rows by columns) of a tile.
Tile = tuple[str, int, int, int, int, int, int, np.ndarray]


def flat_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays (or of their bytes) and the n+1 offsets of its rows; a null value is NaN."""
    if pa.types.is_binary(column.type):
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return raw[off[0] : off[-1]].view(np.float64) if len(column) else np.zeros(0), (off - off[0]) // 8
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def views(batch: pa.RecordBatch, name: str = "pixels") -> Iterator[np.ndarray]:
    """The pixels of each row as rows by columns, without a copy."""
    flat, off = flat_values(batch.column(name))
    for at, h, w in zip(off[:-1].tolist(), batch.column("h").to_pylist(), batch.column("w").to_pylist(), strict=True):
        yield flat[at : at + h * w].reshape(h, w)


def rows_of(batch: pa.RecordBatch) -> Iterator[Tile]:
    """The tiles of a batch."""
    yield from zip(*[batch.column(c).to_pylist() for c in [*KEYS, "y0", "x0"]], views(batch), strict=True)


def lists(arrays: Sequence[np.ndarray], binary: bool = False) -> pa.Array:
    """Arrays as a column of arrays, or of their bytes."""
    flat = np.concatenate([a.reshape(-1) for a in arrays]) if len(arrays) else np.zeros(0)
    off = np.concatenate(([0], np.cumsum([a.size for a in arrays], dtype=np.int64)))
    if binary:
        flat = flat.astype(np.float64, copy=False)
        return pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(flat)])
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))


def with_pixels(batch: pa.RecordBatch, flat: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    """The columns `names` of a batch with other values in place of its pixels."""
    off = batch.column("pixels").offsets
    made = pa.ListArray.from_arrays(off, pa.array(flat))
    return pa.RecordBatch.from_arrays([made if c == "pixels" else batch.column(c) for c in names], names=list(names))


def batches_of(tiles: Iterable[Tile], binary: bool = False) -> Iterator[pa.RecordBatch]:
    """Tiles in batches of about BATCH_PIXELS."""
    held: list[Tile] = []
    size = 0
    for t in tiles:
        held.append(t)
        size += t[-1].size + 64
        if size >= BATCH_PIXELS:
            yield _batch(held, binary)
            held, size = [], 0
    if held:
        yield _batch(held, binary)


def _batch(tiles: list[Tile], binary: bool) -> pa.RecordBatch:
    *head, pixels = zip(*tiles, strict=True)
    shape = [[p.shape[i] for p in pixels] for i in (0, 1)]
    columns = [pa.array(v, t) for v, t in zip([*head, *shape], _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, lists(pixels, binary)], names=[*KEYS, *PLACE, "pixels"])


def map_tiles(df: DataFrame, fn: Callable[[Tile], Iterable[Tile]], schema: str = TILE_SCHEMA) -> DataFrame:
    """Any number of tiles (or parts, by the schema) for each tile of df; narrow."""
    binary = schema == PART_SCHEMA

    def task(batches):
        yield from batches_of((out for batch in batches for tile in rows_of(batch) for out in fn(tile)), binary)

    return df.select(*KEYS, *PLACE, "pixels").mapInArrow(task, schema)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[Tile]]:
    held: list[Tile] = []
    for batch in batches:
        for tile in rows_of(batch):
            if held and held[0][:5] != tile[:5]:
                yield held
                held = []
            # a view would keep its whole batch in memory
            held.append((*tile[:-1], tile[-1].copy()) if len(batch) > 1 else tile)
    if held:
        yield held


def merge_parts(parts: DataFrame, fn: Callable[[list[Tile]], Tile]) -> DataFrame:
    """One tile for all parts of one key (dataset_id, frame_no, channel, ty, tx): one shuffle by the key; a task sorts its
    parts and reads them as a stream, so that it holds the parts of one tile, and tiles share batches."""
    dealt = parts.repartition(*KEYS).sortWithinPartitions(*KEYS)

    def task(batches):
        yield from batches_of(fn(group) for group in _groups(batches))

    return dealt.mapInArrow(task, TILE_SCHEMA)
