"""Filters over windows of pixels: tiles with a halo, dealt by one shuffle, and NumPy kernels on each.

Tile tables stay tile tables: each tile goes to itself whole and to its neighbours as the strip they need, so the shuffle
carries arrays of about the stack's size. Pixel tables deal pixel rows. Kernels and results are the same either way."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import FRAME, PIXELS, Frames, pointwise
from framelake.functions.pointwise import Stage, Staged
from framelake.functions.scalars import reflect_index
from framelake.operators.medians import STRIP, median
from framelake.operators.tiling import Placement, assemble, deal, is_tiled, on_blocks, stay
from framelake.tiles import KEYS, PART_SCHEMA, PLACE, TILE_SCHEMA, Tile, batches_of, map_tiles, rows_of

_OUT = "dataset_id string, frame_no long, y int, x int, channel int, value double"


def _axis(df: DataFrame, name: str, n: int, radius: int, tile: int, mirrored: bool) -> DataFrame:
    """For one axis: where (p) and in which tiles (t) each row or column of a frame is needed."""
    spark = df.sparkSession
    positions = spark.range(-radius if mirrored else 0, n + radius if mirrored else n).select(F.col("id").cast("int").alias("p"))
    first = F.greatest(F.floor((F.col("p") - radius) / tile), F.lit(0))
    last = F.least(F.floor((F.col("p") + radius) / tile), F.lit((n - 1) // tile))
    cells = positions.select("p", F.explode(F.sequence(first, last)).alias("t"))
    return cells.select(reflect_index(F.col("p"), n).cast("int").alias(name), F.col("p").alias(f"p{name}"), F.col("t").cast("int").alias(f"t{name}"))


def halo_tiles(frames: Frames, radius: int, tile: int = 256, mirrored: bool = True) -> DataFrame:
    """Pixels with their tile and padded position, each as often as tiles need it; frame edges are mirrored (or left out)."""
    y = F.broadcast(_axis(frames.df, "y", frames.height, radius, tile, mirrored))
    x = F.broadcast(_axis(frames.df, "x", frames.width, radius, tile, mirrored))
    return frames.df.join(y, "y").join(x, "x").select("dataset_id", "frame_no", "channel", "ty", "tx", "py", "px", "value")


def _filtered(
    frames: Frames, radius: int, tile: int, mirrored: bool, fill: float, kernel, before: Placement | None = None,
    after: Placement | None = None,
) -> Frames:
    """Frames after a kernel, on tiles between the two placements: see `on_blocks`."""
    if is_tiled(frames):
        return on_blocks(frames, radius, mirrored, fill, kernel, before, after)
    return frames.with_(_on_pixel_rows(frames, radius, tile, mirrored, fill, kernel))


def _on_pixel_rows(frames: Frames, radius: int, tile: int, mirrored: bool, fill: float, kernel) -> DataFrame:
    h, w = frames.height, frames.width

    def task(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        rows, cols = min(tile, h - ty * tile), min(tile, w - tx * tile)
        block = np.full((rows + 2 * radius, cols + 2 * radius), fill)
        block[
            table.column("py").to_numpy() - ty * tile + radius, table.column("px").to_numpy() - tx * tile + radius,
        ] = table.column("value").to_numpy()
        out = kernel(block, rows, cols)
        n = rows * cols
        yy, xx = np.divmod(np.arange(n), cols)
        same = lambda name: pa.repeat(table.column(name)[0], n)
        return pa.table(
            [
                same("dataset_id"), same("frame_no"), pa.array((yy + ty * tile).astype(np.int32)),
                pa.array((xx + tx * tile).astype(np.int32)), same("channel"), pa.array(out.reshape(-1)),
            ],
            names=PIXELS,
        )

    return halo_tiles(frames, radius, tile, mirrored).groupBy(*KEYS).applyInArrow(task, _OUT)


def median_filter(frames: Frames, size: int = 3, tile: int = 256, before: Placement | None = None, after: Placement | None = None) -> Frames:
    """Median over a square window, mirrored edges; an even window begins size // 2 before and takes the upper middle.

    On tiles, `before` moves the frames and `after` crops the result within the filter's own shuffle (`on_blocks`)."""
    if not 1 <= size <= 51:
        raise FrameError("size is 1 to 51")
    r = size // 2

    def kernel(block: np.ndarray, rows: int, cols: int) -> np.ndarray:
        return median(block, rows, cols, size)

    return _filtered(frames, r, tile, True, np.nan, kernel, before, after)


def strips(rows: int, cols: int):
    """(first row, rows) of strips whose pixels stay in a core's cache."""
    step = max(1, STRIP // cols)
    for a in range(0, rows, step):
        yield a, min(step, rows - a)


def _weighted(parts: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    out, term = parts[0] * weights[0], np.empty(parts[0].shape)
    for part, weight in zip(parts[1:], weights[1:], strict=True):
        np.multiply(part, weight, out=term)
        out += term
    return out


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    total = sum(w)
    return [x / total for x in w]


def gaussian_filter(frames: Frames, sigma: float = 1.0, tile: int = 256, before: Placement | None = None, after: Placement | None = None) -> Frames:
    """Gaussian blur by two one-dimensional passes over each tile, mirrored edges, channels apart. before, after: see `median_filter`."""
    if not 0.1 <= sigma <= 100:
        raise FrameError("sigma is 0.1 to 100")
    weights = np.array(gaussian_weights(sigma))
    r = len(weights) // 2
    tile = max(tile, r)

    def kernel(block: np.ndarray, rows: int, cols: int) -> np.ndarray:
        out = np.empty((rows, cols))
        for a, n in strips(rows, cols):
            down = _weighted([block[a + k : a + k + n] for k in range(2 * r + 1)], weights)
            out[a : a + n] = _weighted([down[:, k : k + cols] for k in range(2 * r + 1)], weights)
        return out

    return _filtered(frames, r, tile, True, np.nan, kernel, before, after)


#: Greatest radius and by how much frames are shrunk for it; larger ones by LARGEST_SHRINK.
SHRINK = ((10, 1), (30, 2), (100, 4))
LARGEST_SHRINK = 8


def shrink_factor(radius: float) -> int:
    return next((factor for most, factor in SHRINK if radius <= most), LARGEST_SHRINK)


def ball_background(frames: Frames, radius: float, tile: int = 128, subtract: bool = False) -> DataFrame:
    """Least of value + ball height over the ball, outside left out; or the values less that."""
    r = int(radius)
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    inside = dy**2 + dx**2 <= radius**2
    offsets = [(int(a), int(b), radius - math.sqrt(radius**2 - a * a - b * b)) for a, b in zip(dy[inside], dx[inside], strict=True)]

    def kernel(block: np.ndarray, rows: int, cols: int) -> np.ndarray:
        out = np.full((rows, cols), np.inf)
        for y, n in strips(rows, cols):
            least, term = out[y : y + n], np.empty((n, cols))
            for a, b, up in offsets:
                np.add(block[r + a + y : r + a + y + n, r + b : r + b + cols], up, out=term)
                np.minimum(least, term, out=least)
        return block[r : r + rows, r : r + cols] - out if subtract else out

    return _filtered(frames, r, max(tile, r), False, np.inf, kernel).df


def _mirrored(p, n: int):
    """A real position mirrored about the centres of the first and the last of n pixels."""
    return F.when(p < 0, -p).when(p > n - 1, F.lit(2 * (n - 1)) - p).otherwise(p)


def enlarge(small: Frames, height: int, width: int, df: DataFrame) -> DataFrame:
    """Bilinear values of a small stack at the pixels of df: each pixel joins four of the small one's, by position."""
    def near(name: str, n: int, full: int):
        p = _mirrored((F.col(name) + 0.5) * (n / full) - 0.5, n) if n > 1 else F.lit(0.0)
        low = F.least(F.floor(p), F.lit(max(n - 2, 0))).cast("int")
        return low, p - low

    y, fy = near("y", small.height, height)
    x, fx = near("x", small.width, width)
    corners = F.array(*[F.struct(
        (F.least(F.col("_y") + a, F.lit(small.height - 1))).alias("sy"),
        (F.least(F.col("_x") + b, F.lit(small.width - 1))).alias("sx"),
        ((F.col("_fy") if a else 1 - F.col("_fy")) * (F.col("_fx") if b else 1 - F.col("_fx"))).alias("wt"),
    ) for a in (0, 1) for b in (0, 1)])
    at = df.select(
        *FRAME, "y", "x", "channel", y.alias("_y"), fy.alias("_fy"), x.alias("_x"), fx.alias("_fx"),
    ).select(*FRAME, "y", "x", "channel", F.explode(corners).alias("c")).select(*FRAME, "y", "x", "channel", "c.*")
    s = small.df.select(*FRAME, "channel", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("value").alias("_v"))
    return at.join(s, [*FRAME, "channel", "sy", "sx"]).groupBy(*FRAME, "y", "x", "channel").agg(F.sum(F.col("wt") * F.col("_v")).alias("_bg"))


def rolling_ball(frames: Frames, radius: float = 50.0, light_background: bool = False, tile: int = 128) -> Frames:
    """Subtract a rolling-ball background; frames are shrunk by block minima for radii above 10 and the background enlarged."""
    if not 1 <= radius <= 1000:
        raise FrameError("radius is 1 to 1000")
    if is_tiled(frames):
        return frames.with_(_ball_on_tiles(frames, radius, light_background))
    df, top = frames.df, None
    if light_background:
        top = df.groupBy(*FRAME, "channel").agg(F.max(F.when(~F.isnan("value"), F.col("value"))).alias("_top"))
        df = df.join(top, [*FRAME, "channel"]).withColumn("value", F.col("_top") - F.col("value")).select(frames.df.columns)
    s = shrink_factor(radius)
    cell = lambda c: F.floor(F.col(c) / s).cast("int").alias(c)
    small = df if s == 1 else df.groupBy(*FRAME, cell("y"), cell("x"), "channel").agg(F.min("value").alias("value"))
    shape = Frames(small.select(*PIXELS), -(-frames.height // s), -(-frames.width // s), frames.channels)
    bg = shape.with_(ball_background(shape, radius / s, tile))
    back = bg.df.withColumnRenamed("value", "_bg") if s == 1 else enlarge(bg, frames.height, frames.width, df)
    out = df.join(back, [*FRAME, "y", "x", "channel"]).withColumn("value", F.col("value") - F.col("_bg"))
    if light_background:
        out = out.withColumn("value", -F.col("value"))
    return frames.with_(out.select(frames.df.columns))


def shrink_tiles(frames: Frames, s: int) -> Frames:
    """Tiles of the least value of s x s pixels, NaN left out where there are others; narrow."""
    if frames.tile % s:
        raise FrameError(f"tiles of {frames.tile} are not whole blocks of {s}")

    def small(tile: Tile):
        a = tile[-1]
        least = np.fmin.reduceat(np.fmin.reduceat(a, np.arange(0, a.shape[0], s), axis=0), np.arange(0, a.shape[1], s), axis=1)
        yield (*tile[:5], tile[5] // s, tile[6] // s, least)

    return Frames(map_tiles(frames.df, small), -(-frames.height // s), -(-frames.width // s), frames.channels, frames.tile // s)


def _between(first: int, length: int, n: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """For pixels of an enlarged axis: the lower of two small pixels, and the weight of the upper."""
    p = (np.arange(first, first + length) + 0.5) * (n / full) - 0.5
    p = np.where(p < 0, -p, np.where(p > n - 1, 2 * (n - 1) - p, p)) if n > 1 else np.zeros(length)
    low = np.minimum(np.floor(p), max(n - 2, 0)).astype(int)
    return low, p - low


def _ball_on_tiles(frames: Frames, radius: float, light_background: bool) -> DataFrame:
    """The rolling ball on a tile table: no pixel becomes a row; the enlarged background is made and subtracted by tile."""
    df, places = frames.df, PLACE
    if light_background:
        most = F.array_max(F.filter("pixels", lambda v: ~F.isnan(v)))
        top = df.groupBy(*FRAME, "channel").agg(F.max(most).alias("_top"))
        df = df.join(top, [*FRAME, "channel"]).select(*KEYS, *places, F.transform("pixels", lambda v: F.col("_top") - v).alias("pixels"))
    stack, s = frames.with_(df), shrink_factor(radius)
    if s == 1:
        out = ball_background(stack, radius, subtract=True)
    else:
        small = shrink_tiles(stack, s)
        small = small.with_(ball_background(small, radius / s))
        n, full, tile, less = (small.height, small.width), (frames.height, frames.width), frames.tile, small.tile
        # the enlarged axis runs up to one small pixel ahead, and takes one more
        halo = 2

        def task(own: pa.Table, strips: pa.Table) -> pa.Table:
            (tile_,), parts = (list(rows_of(t.combine_chunks().to_batches()[0])) for t in (own, strips))
            at, value = tile_[3:5], tile_[-1]
            start = [at[i] * less - halo for i in (0, 1)]
            block = assemble(parts, *start, (less + 2 * halo, less + 2 * halo))
            (y, fy), (x, fx) = (_between(at[i] * tile, k, n[i], full[i]) for i, k in enumerate(value.shape))
            y, x, y1, x1 = y - start[0], x - start[1], np.minimum(y + 1, n[0] - 1) - start[0], np.minimum(x + 1, n[1] - 1) - start[1]
            across = lambda q: block[np.ix_(q, x)] * (1 - fx) + block[np.ix_(q, x1)] * fx
            back = across(y) * (1 - fy)[:, None] + across(y1) * fy[:, None]
            return pa.Table.from_batches(list(batches_of([(*tile_[:-1], value - back)])))

        whole = df.select(*KEYS, *places, "pixels")
        strips = map_tiles(small.df, deal(small, stay(small), stay(small), less, halo), PART_SCHEMA)
        out = whole.groupBy(*KEYS).cogroup(strips.groupBy(*KEYS)).applyInArrow(task, TILE_SCHEMA)
    return pointwise(out, Staged([Stage(lambda v: -v, np.negative)])) if light_background else out
