"""Frame tables. Pixels: dataset_id, frame_no, y, x, channel, value. Tiles: dataset_id, frame_no, channel, ty, tx, y0, x0, h, w, pixels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.tiles import Tile, flat_values, map_tiles, with_pixels

PIXELS = ["dataset_id", "frame_no", "y", "x", "channel", "value"]
FRAME = ["dataset_id", "frame_no"]
TILE = 512


@dataclass(frozen=True)
class Frames:
    """A stack of equal frames: its pixel (or tile) table and the frame size, which steps compute and never count.

    tile is the tile size of a tile table whose tiles are whole and lie on the grid of that size. counts are the lengths of
    the frame axes, where they are known; dtype is the pixel type of the source, metadata and warnings go with the stack."""

    df: DataFrame
    height: int
    width: int
    channels: int = 1
    tile: int | None = None
    axes: tuple[str, ...] = ("frame", "y", "x")
    counts: tuple[int, ...] | None = None
    dtype: str = "float64"
    metadata: Mapping[str, Any] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()

    def with_(self, df: DataFrame, **changed: Any) -> Frames:
        return replace(self, df=df, **changed)

    @property
    def shape(self) -> tuple[int, ...] | None:
        """Lengths of all axes; None where those of the frame axes aren't known."""
        tail = (self.height, self.width, self.channels) if self.axes[-1] == "channel" else (self.height, self.width)
        return None if self.counts is None else (*self.counts, *tail)


def check_axes(axes: Sequence[str]) -> tuple[str, ...]:
    """Axes end in y, x or y, x, channel; names are lower-case words and differ."""
    axes = tuple(axes)
    if any(not re.fullmatch(r"[a-z][a-z0-9_]*", a) for a in axes) or len(set(axes)) != len(axes):
        raise FrameError(f"axes {axes} are not different lower-case names")
    if axes[-2:] != ("y", "x") and axes[-3:] != ("y", "x", "channel"):
        raise FrameError(f"axes {axes} don't end in y, x or y, x, channel")
    return axes


def frame_axes(axes: Sequence[str]) -> tuple[str, ...]:
    return tuple(a for a in check_axes(axes) if a not in ("y", "x", "channel"))


def from_array_column(df: DataFrame, frame_no: str, array: str, width: int, dataset_id: Column) -> DataFrame:
    """Pixels of a column of row-major arrays, one frame each."""
    exploded = df.select(dataset_id.alias("dataset_id"), F.col(frame_no).cast("long").alias("frame_no"), F.posexplode(array).alias("i", "v"))
    return exploded.select(
        "dataset_id", "frame_no", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"),
        F.lit(0).alias("channel"), F.col("v").cast("double").alias("value"),
    )


def tiles_from_array_column(df: DataFrame, frame_no: str, array: str, height: int, width: int, dataset_id: Column, size: int = TILE) -> Frames:
    """Tiles of a column of row-major arrays of height * width values, one frame each; narrow, no pixel becomes a row."""
    whole = df.select(
        dataset_id.alias("dataset_id"),
        F.col(frame_no).cast("long").alias("frame_no"),
        *[F.lit(n).alias(c) for c, n in (("channel", 0), ("ty", 0), ("tx", 0), ("y0", 0), ("x0", 0), ("h", height), ("w", width))],
        F.col(array).cast("array<double>").alias("pixels"),
    )

    def tiles(frame: Tile) -> Iterator[Tile]:
        for y in range(0, height, size):
            for x in range(0, width, size):
                yield (*frame[:3], y // size, x // size, y, x, frame[-1][y : y + size, x : x + size])

    return Frames(map_tiles(whole, tiles), height, width, tile=size)


def from_rows(df: DataFrame, number: Column, value: Column, height: int, width: int, dataset_id: Column) -> DataFrame:
    """Pixels of a table with one value a row, numbered in C order over frame, y, x."""
    i = number.cast("long")
    size = height * width
    return df.select(
        dataset_id.alias("dataset_id"), F.floor(i / size).cast("long").alias("frame_no"),
        F.floor(i % size / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), F.lit(0).alias("channel"),
        value.cast("double").alias("value"),
    )


def frame_rank(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """frame_no of an index over the frame axes, in C order; null where it is out of bounds."""
    ok = reduce(lambda a, b: a & b, [(i >= 0) & (i < n) for i, n in zip(index, shape, strict=True)])
    rank = reduce(lambda a, b: a * F.lit(b[1]) + b[0], zip(index, shape, strict=True), F.lit(0).cast("long"))
    return F.when(ok, rank.cast("long"))


def frame_index(frame_no: Column, shape: Sequence[int]) -> Column:
    """The index (array<int>) over the frame axes of a frame_no."""
    out, step = [], 1
    for n in reversed(list(shape)):
        out.append((F.floor(frame_no / step) % n).cast("int"))
        step *= n
    return F.array(*reversed(out))


def to_tiles(pixels: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of size x size pixels (less at the right and lower edge), row-major, by one shuffle of pixels."""
    ty, tx = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    grouped = pixels.withColumn("ty", ty).withColumn("tx", tx).groupBy("dataset_id", "frame_no", "channel", "ty", "tx")
    tiles = grouped.agg(
        F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("p"), F.min("y").alias("y0"), F.min("x").alias("x0"),
        F.max("y").alias("y1"), F.max("x").alias("x1"),
    )
    return tiles.select(
        "dataset_id", "frame_no", "channel", "ty", "tx", "y0", "x0", (F.col("y1") - F.col("y0") + 1).alias("h"),
        (F.col("x1") - F.col("x0") + 1).alias("w"), F.transform("p", lambda q: q["value"]).alias("pixels"),
    )


def to_pixels(tiles: DataFrame) -> DataFrame:
    """Pixels of tiles; narrow."""
    out = tiles.select("dataset_id", "frame_no", "channel", "y0", "x0", "w", F.posexplode("pixels").alias("i", "value"))
    return out.select(
        "dataset_id", "frame_no", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"),
        (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"), "channel", "value",
    )


#: Values go through the steps of a kernel in blocks of so many, which stay in a core's cache.
BLOCK = 1 << 15


def _run_kernels(df: DataFrame, kernels: Sequence[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    names = df.columns

    def task(batches):
        for batch in batches:
            flat, off = flat_values(batch.column("pixels"))
            out = np.empty(len(flat))
            with np.errstate(all="ignore"):
                for a in range(int(off[0]), int(off[-1]), BLOCK):
                    part = flat[a : min(a + BLOCK, int(off[-1]))]
                    for kernel in kernels:
                        part = kernel(part)
                    out[a : a + len(part)] = part
            yield with_pixels(batch, out, names)

    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'pixels' else f.dataType.simpleString()}" for f in df.schema)
    return df.withColumn("pixels", F.col("pixels").cast("array<double>")).mapInArrow(task, schema)


def pointwise(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a function to every value of a pixel or tile table.

    Pixel tables get projections. On tile tables all steps with kernels (the functions of `functions.pointwise`) are one pass
    over Arrow batches, in which a null value counts as NaN; casts are casts of arrays; other column functions are applied
    by `transform`, which Spark interprets."""
    if "pixels" in df.columns:
        kernels = getattr(fn, "kernels", None)
        if kernels:
            return _run_kernels(df, kernels)
        return df.withColumn("pixels", fn.of_array(F.col("pixels")) if hasattr(fn, "of_array") else F.transform("pixels", fn))
    for stage in getattr(fn, "stages", ())[:-1]:
        df = df.withColumn("value", stage(F.col("value")))
    fn = getattr(fn, "stages", (fn,))[-1]
    return df.withColumn("value", fn(F.col("value")))
