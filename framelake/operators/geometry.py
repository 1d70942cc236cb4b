"""Coordinate projections and frame selection; sizes are computed from parameters, never counted."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import Frames
from framelake.operators.ordering import bounded
from framelake.operators.tiling import Placement, is_tiled, retile
from framelake.tiles import Tile, map_tiles


def crop_place(frames: Frames, top: int = 0, left: int = 0, height: int = 0, width: int = 0) -> Placement:
    """A rectangle of each frame; height or width 0 goes up to the edge."""
    height, width = height or frames.height - top, width or frames.width - left
    if min(top, left) < 0 or min(height, width) <= 0 or top + height > frames.height or left + width > frames.width:
        raise FrameError("the rectangle isn't inside the frame")
    return Placement(height, width, -top, -left)


def rotate_place(frames: Frames, angle: str | int = "90") -> Placement:
    """Clockwise by 90, 180 or 270 degrees."""
    h, w = frames.height, frames.width
    turned = {
        "90": Placement(w, h, 0, h - 1, 1, -1, True), "180": Placement(h, w, h - 1, w - 1, -1, -1),
        "270": Placement(w, h, w - 1, 0, -1, 1, True),
    }
    if str(angle) not in turned:
        raise FrameError(f"angle {angle} is not 90, 180 or 270")
    return turned[str(angle)]


def flip_place(frames: Frames, direction: str = "horizontal") -> Placement:
    h, w = frames.height, frames.width
    if direction not in ("horizontal", "vertical"):
        raise FrameError(f"direction {direction} is not horizontal or vertical")
    return Placement(h, w, 0, w - 1, 1, -1) if direction == "horizontal" else Placement(h, w, h - 1, 0, -1, 1)


def place(frames: Frames, to: Placement) -> Frames:
    """Frames with their pixels moved: a projection of pixel tables (with a filter where it crops); for tiles see `retile`."""
    if is_tiled(frames):
        return retile(frames, to)
    y, x = F.col("y"), F.col("x")
    a, b = (x, y) if to.swap else (y, x)
    shift = lambda c, s, o: (c + o if s > 0 else F.lit(o) - c).cast("int")
    kept = frames.df
    # in terms of the columns, so that Spark can push it down
    for c, s, o, n in ((a, to.sy, to.oy, to.height), (b, to.sx, to.ox, to.width)):
        low = -o if s > 0 else o - n + 1
        if (low, n) != (0, frames.height if c is y else frames.width):
            kept = kept.where(c.between(low, low + n - 1))
    return frames.with_(kept.withColumns({"y": shift(a, to.sy, to.oy), "x": shift(b, to.sx, to.ox)}), height=to.height, width=to.width)


def crop(frames: Frames, top: int = 0, left: int = 0, height: int = 0, width: int = 0) -> Frames:
    """A rectangle of each frame; height or width 0 goes up to the edge."""
    return place(frames, crop_place(frames, top, left, height, width))


def crop_tiles(tiles: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The same on tiles without a shuffle: tiles outside go, the others are cut. They keep their numbers, so lie on no grid."""

    def cut(tile: Tile):
        y, x, a = tile[5:]
        inside = a[max(0, top - y) : max(0, top + height - y), max(0, left - x) : max(0, left + width - x)]
        if inside.size:
            yield (*tile[:5], max(0, y - top), max(0, x - left), inside)

    return map_tiles(tiles, cut)


def rotate(frames: Frames, angle: str | int = "90") -> Frames:
    """Clockwise by 90, 180 or 270 degrees."""
    return place(frames, rotate_place(frames, angle))


def flip(frames: Frames, direction: str = "horizontal") -> Frames:
    return place(frames, flip_place(frames, direction))


def slice_frames(df: DataFrame, n: int, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Frames start:stop:step of n, renumbered in the order taken; a predicate on frame_no that reaches the scan."""
    a, b, s = slice(start, stop, step).indices(n)
    taken = range(a, b, s)
    if not len(taken):
        return df.where(F.lit(False))
    low, high = min(taken), max(taken)
    keep = F.col("frame_no").between(low, high)
    if abs(s) > 1:
        keep = keep & ((F.col("frame_no") - low) % abs(s) == 0)
    return df.where(keep).withColumn("frame_no", F.floor((F.col("frame_no") - a) / s).cast("long"))


def chosen_numbers(n: int, chosen: Sequence[int] | Sequence[bool]) -> list[int]:
    """Numbers of a list (negatives from the end) or of a mask."""
    if chosen and all(isinstance(c, bool) for c in chosen):
        if len(chosen) != n:
            raise FrameError(f"a mask of {len(chosen)} for {n} frames")
        return [i for i, c in enumerate(chosen) if c]
    numbers = [c + n if c < 0 else c for c in chosen]
    if any(not 0 <= c < n for c in numbers):
        raise FrameError(f"frame numbers outside of 0 to {n - 1}")
    return numbers


def selection(spark: SparkSession, numbers: Sequence[int]) -> DataFrame:
    """The table (number, place) of a list of numbers."""
    return spark.createDataFrame(list(zip(numbers, range(len(numbers)), strict=True)), "number long, place long")


def select_by_table(df: DataFrame, chosen: DataFrame, inner: int = 1) -> DataFrame:
    """Frames by a selection table (number, place): each goes to every place that its number has. Numbers count along the first
    frame axis, `inner` frames each. The table is broadcast up to a counted number of rows, else joined by number."""
    first = F.floor(F.col("frame_no") / inner).cast("long")
    met = df.withColumn("_number", first).join(bounded(chosen.select(F.col("number").alias("_number"), F.col("place").alias("_place"))), "_number")
    return met.withColumn("frame_no", (F.col("_place") * inner + F.col("frame_no") % inner).cast("long")).select(df.columns)


def list_frames(df: DataFrame, n: int, chosen: Sequence[int] | Sequence[bool]) -> DataFrame:
    """Frames of a list (order and repeats kept, negatives from the end) or of a mask, renumbered in the order given."""
    numbers = chosen_numbers(n, chosen)
    return select_by_table(df, selection(df.sparkSession, numbers)) if numbers else df.where(F.lit(False))


def select_first(frames: Frames, key: int | slice | Sequence[int] | Sequence[bool]) -> Frames:
    """The part of a stack at a key along its first frame axis: an int (the axis goes), a slice, a list or a mask.

    A slice is a predicate on frame_no that reaches the scan, a list a join with a selection table."""
    if not frames.counts:
        raise FrameError("the stack has no frame axis of known length to select from")
    n, *rest = frames.counts
    inner = math.prod(rest)
    within = F.col("frame_no") % inner
    if isinstance(key, int):
        number = key + n if key < 0 else key
        if not 0 <= number < n:
            raise FrameError(f"frame {key} is outside of 0 to {n - 1}")
        df = frames.df.where(F.col("frame_no").between(number * inner, (number + 1) * inner - 1)).withColumn("frame_no", within)
        return frames.with_(df, axes=frames.axes[1:], counts=tuple(rest))
    if isinstance(key, slice):
        taken = range(*key.indices(n))
        df = frames.df.where(F.lit(False))
        if len(taken):
            low, high, step = min(taken), max(taken), abs(taken.step)
            first = F.floor(F.col("frame_no") / inner)
            df = frames.df.where(F.col("frame_no").between(low * inner, (high + 1) * inner - 1))
            df = df.where((first - low) % step == 0) if step > 1 else df
            df = df.withColumn("frame_no", (F.floor((first - taken.start) / taken.step) * inner + within).cast("long"))
        return frames.with_(df, counts=(len(taken), *rest))
    numbers = chosen_numbers(n, key)
    df = select_by_table(frames.df, selection(frames.df.sparkSession, numbers), inner) if numbers else frames.df.where(F.lit(False))
    return frames.with_(df, counts=(len(numbers), *rest))


def one_frame(df: DataFrame, n: int, number: int) -> DataFrame:
    """One frame; its axis goes."""
    number = number + n if number < 0 else number
    if not 0 <= number < n:
        raise FrameError(f"frame {number} is outside of 0 to {n - 1}")
    return df.where(F.col("frame_no") == number).withColumn("frame_no", F.lit(0).cast("long"))


def select_region(df: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Pixels of rows y[0] to y[1] - 1 and columns x[0] to x[1] - 1, with their coordinates."""
    return df.where(F.col("y").between(y[0], y[1] - 1) & F.col("x").between(x[0], x[1] - 1))


def in_order(df: DataFrame) -> DataFrame:
    """C order: frame, y, x, channel."""
    return df.orderBy("dataset_id", "frame_no", "y", "x", "channel")
