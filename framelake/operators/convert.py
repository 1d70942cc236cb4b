"""Exact and scaled conversion of pixel types, its inverse, and frame functions of the user's."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import PIXELS, Frames, pointwise
from framelake.functions.pointwise import INTEGERS, SPARK_TYPES, Stage, Staged, cast_dtype, holds
from framelake.operators import geometry
from framelake.operators.aggregates import value_range
from framelake.operators.tiling import is_tiled
from framelake.tiles import KEYS, PLACE, TILE_SCHEMA, batches_of, rows_of


def convert_exact(df: DataFrame, source: str, target: str) -> DataFrame:
    """Values of one pixel type in another that can hold them all."""
    if not holds(source, target):
        raise FrameError(f"{target} can't hold every {source}; give a range to scale to")
    return pointwise(df, cast_dtype(target))


def convert_scaled(df: DataFrame, target: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Integers of target from one range of all values (given or found): value, offset, scale and clipped.

    scale = (high - low) / largest, 1 if the range is empty; half to even; NaN is 0, infinities are the ends. clipped: the
    value lies more than half a step outside of the range."""
    if target not in INTEGERS:
        raise FrameError(f"{target} is not an integer type")
    most = float(INTEGERS[target][1])
    ends = value_range(df) if low is None or high is None else None
    if ends is not None:
        ends = ends.select(
            (F.col("low") if low is None else F.lit(float(low))).alias("_lo"),
            (F.col("high") if high is None else F.lit(float(high))).alias("_hi"), F.lit(True).alias("_one"),
        )
        df_ = df.withColumn("_one", F.lit(True)).join(F.broadcast(ends), "_one").drop("_one")  # one row
    else:
        df_ = df.withColumns({"_lo": F.lit(float(low)), "_hi": F.lit(float(high))})
    scale = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / most).otherwise(F.lit(1.0))
    v = F.col("value")
    raw = (v - F.col("_lo")) / scale
    out = F.when(F.isnan(v), F.lit(0.0)).otherwise(F.rint(F.least(F.greatest(raw, F.lit(0.0)), F.lit(most))))
    beyond = ~F.isnan(v) & ((raw < -0.5) | (raw > most + 0.5))
    return df_.select(
        *[c for c in df.columns if c != "value"], out.cast("long").alias("value"), F.col("_lo").alias("offset"),
        scale.alias("scale"), beyond.alias("clipped"),
    )


def scaled_kernel(low: float, scale: float, most: int) -> Staged:
    """(value - low) / scale in 0 to most, half to even, NaN as 0."""
    return Staged([
        Stage(
            lambda v: F.when(F.isnan(v), F.lit(0.0)).otherwise(F.rint(F.least(
                F.greatest((v - F.lit(low)) / F.lit(scale), F.lit(0.0)), F.lit(float(most)),
            ))),
            lambda a: np.nan_to_num(np.rint(np.clip((a - low) / scale, 0.0, float(most))), copy=False, nan=0.0),
        )
    ])


def convert(
    frames: Frames, dtype: str | None = None, value_range: tuple[float, float] | None = None,
    select: int | slice | Sequence | None = None,
) -> Frames:
    """The stack (pixels or tiles), or a part of it along its first axis, as another pixel type (its own by default).

    Floats and types that hold every value are exact casts. Other integers are scaled linearly from one range of all values:
    the given one, outside of which values are clipped (a warning says so, by one more pass), or their own, found by a pass
    of their own; so df is read more than once and should be stored. metadata gets value_scaling (source_dtype, value_range,
    offset, scale and the formula that recovers values) and source_frames; missing_frames becomes source_missing_frames,
    because its numbers are those of the source."""
    dtype = dtype or frames.dtype
    if dtype not in SPARK_TYPES:
        raise FrameError(f"{dtype} is not a pixel type")
    metadata = dict(frames.metadata)
    if "missing_frames" in metadata:
        metadata["source_missing_frames"] = metadata.pop("missing_frames")
    if select is not None:
        n = (frames.counts or (0,))[0]
        frames_ = geometry.select_first(frames, select)
        if isinstance(select, int):
            metadata["source_frames"] = [select + n if select < 0 else select]
        else:
            metadata["source_frames"] = list(range(*select.indices(n))) if isinstance(select, slice) else geometry.chosen_numbers(n, select)
        frames = frames_
    if dtype not in INTEGERS or holds(frames.dtype, dtype):
        return frames.with_(pointwise(frames.df, cast_dtype(dtype)), dtype=dtype, metadata=metadata)
    most, warnings = INTEGERS[dtype][1], frames.warnings
    found = tuple(value_range_of(frames.df))
    low, high = (float(x) for x in (value_range or found))
    scale = (high - low) / most if high > low else 1.0
    if value_range and ((found[0] - low) / scale < -0.5 or (found[1] - low) / scale > most + 0.5):
        warnings = (*warnings, f"values outside of {low:g} to {high:g} are clipped")
    metadata["value_scaling"] = {
        "source_dtype": frames.dtype, "value_range": [low, high], "offset": low, "scale": scale,
        "formula": "original ~ offset + pixel * scale",
    }
    done = pointwise(pointwise(frames.df, scaled_kernel(low, scale, most)), cast_dtype(dtype))
    return frames.with_(done, dtype=dtype, metadata=metadata, warnings=warnings)


def value_range_of(df: DataFrame):
    return value_range(df).first()


def recover(frames: Frames) -> Frames:
    """The values of `convert`, to half a step, by its value_scaling."""
    said = frames.metadata.get("value_scaling")
    if said is None:
        raise FrameError("the stack has no value_scaling")
    offset, scale = float(said["offset"]), float(said["scale"])
    doubles = pointwise(frames.df, cast_dtype("float64"))
    values = pointwise(doubles, Staged([Stage(lambda v: F.lit(offset) + v * F.lit(scale), lambda a: offset + a * scale)]))
    return frames.with_(values, dtype=said["source_dtype"], metadata={k: v for k, v in frames.metadata.items() if k != "value_scaling"})


def recover_values(df: DataFrame) -> DataFrame:
    """Values of `convert_scaled`, to half a step."""
    return df.withColumn("value", F.col("offset") + F.col("value") * F.col("scale"))


def map_frames(
    frames: Frames, fn: Callable[[np.ndarray], np.ndarray], height: int | None = None, width: int | None = None,
    metadata: Mapping[str, Any] | None = None,
) -> Frames:
    """Apply fn to every (y, x, channel) or, with one channel, (y, x) frame; a frame must fit a task. Sizes may change (say how).

    Tile tables stay tile tables: the tiles of a frame meet in one task, the result is cut again. metadata is added to the
    stack's. A stack without frames is refused, and so is a result of another number of axes or another size."""
    h, w, c, size = frames.height, frames.width, frames.channels, frames.tile
    height, width = height or h, width or w
    if frames.df.isEmpty():
        raise FrameError("there are no frames to map")

    def mapped(block: np.ndarray) -> np.ndarray:
        out = np.asarray(fn(block if c > 1 else block[..., 0]), float)
        if out.ndim != (3 if c > 1 else 2) or out.shape[:2] != (height, width):
            raise FrameError(f"the function made a frame of shape {out.shape}, not {(height, width)}")
        return out.reshape(height, width, -1)

    def from_pixels(table: pa.Table) -> pa.Table:
        block = np.full((h, w, c), np.nan)
        block[table.column("y").to_numpy(), table.column("x").to_numpy(), table.column("channel").to_numpy()] = table.column("value").to_numpy()
        out = mapped(block)
        yy, xx, cc = np.unravel_index(np.arange(out.size), out.shape)
        same = lambda name: pa.repeat(table.column(name)[0], out.size)
        return pa.table(
            [same("dataset_id"), same("frame_no"), *[pa.array(a.astype(np.int32)) for a in (yy, xx, cc)], pa.array(out.reshape(-1))],
            names=PIXELS,
        )

    def from_tiles(batches):
        rows = (tile for batch in batches for tile in rows_of(batch))
        for key, group in groupby(rows, key=lambda tile: tile[:2]):
            block = np.full((h, w, c), np.nan)
            for _, _, channel, _, _, y, x, a in group:
                block[y : y + a.shape[0], x : x + a.shape[1], channel] = a
            out = mapped(block)
            grid = [(channel, y, x) for channel in range(out.shape[2]) for y in range(0, height, size) for x in range(0, width, size)]
            yield from batches_of((*key, k, y // size, x // size, y, x, out[y : y + size, x : x + size, k]) for k, y, x in grid)

    if is_tiled(frames):
        dealt = frames.df.select(*KEYS, *PLACE, "pixels").repartition("dataset_id", "frame_no").sortWithinPartitions("dataset_id", "frame_no")
        df = dealt.mapInArrow(from_tiles, TILE_SCHEMA)
    else:
        schema = "dataset_id string, frame_no long, y int, x int, channel int, value double"
        df = frames.df.select(*PIXELS).groupBy("dataset_id", "frame_no").applyInArrow(from_pixels, schema)
    return frames.with_(df, height=height, width=width, metadata={**frames.metadata, **(metadata or {})})
