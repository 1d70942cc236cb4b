"""Reductions of tile tables: partial results by tile in NumPy, merged by Spark's aggregates. No pixel becomes a row."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import FRAME, Frames
from framelake.operators.ordering import bounded, stored
from framelake.operators.tiling import Placement, retile
from framelake.tiles import KEYS, PART_SCHEMA, PLACE, TILE_SCHEMA, Tile, lists, map_tiles, merge_parts, rows_of, views, with_pixels

_FRAME_HEAD = "dataset_id string, frame_no long"
#: Averaged medians hold about so many values in a task at a time.
MEDIAN_VALUES = 1 << 23


def map_rows(df: DataFrame, fn: Callable[[Tile, tuple], Iterator[tuple]], schema: str, *more: str) -> DataFrame:
    """Rows of a schema for each tile; fn also gets the tile's values of the columns `more`."""
    columns = [*KEYS, *PLACE, "pixels", *more]
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def task(batches):
        for batch in batches:
            extra = list(zip(*[batch.column(c).to_pylist() for c in more], strict=True)) if more else [()] * len(batch)
            rows = [row for tile, x in zip(rows_of(batch), extra, strict=True) for row in fn(tile, x)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([_joined(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

    return df.select(*columns).mapInArrow(task, schema)


def _joined(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Values, each a scalar or an array; a scalar stands for itself."""
    if isinstance(values[0], np.ndarray):
        return pa.array(np.concatenate(values), kind)
    return pa.array(values, kind)


def _expanded(head: tuple, *arrays: np.ndarray) -> tuple:
    """One row of arrays: the head repeated beside the arrays."""
    n = len(arrays[0])
    return (*[np.repeat(np.array([h], object if isinstance(h, str) or h is None else None), n) for h in head], *arrays)


def extremes(df: DataFrame, finite: bool) -> DataFrame:
    """dataset_id, frame_no, least, most by tile, NaN (and infinities, if finite) left out; null where nothing is left.

    Spark's compiled array_min and array_max do it; only tiles with values to leave out are filtered."""
    inf = F.lit(float("inf"))
    kept = lambda v: ~F.isnan(v) & ((F.abs(v) != inf) if finite else F.lit(True))
    low, high = F.array_min("pixels"), F.array_max("pixels")
    clean, some = kept(low) & kept(high), F.filter("pixels", kept)
    least, most = (F.when(clean, c).otherwise(of(some)) for c, of in ((low, F.array_min), (high, F.array_max)))
    return df.select(*FRAME, least.alias("least"), most.alias("most"))


def value_range(df: DataFrame) -> DataFrame:
    """See `aggregates.value_range`."""
    r = extremes(df, False).agg(F.min("least").alias("low"), F.max("most").alias("high"))
    return r.select(F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))


# --- exact quantiles by refinement -----------------------------------------------------------------------------------

#: Bits of a value's key that the passes count by, from the highest.
PASSES = (48, 32, 16, 0)


def sort_keys(a: np.ndarray) -> np.ndarray:
    """64-bit keys in the order of the values (no NaN); -0 counts as 0."""
    bits = (a + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _counts(df: DataFrame, sample: Callable[[Tile], np.ndarray], shift: int, first: bool) -> DataFrame:
    """Values by frame, prefix (what an earlier pass chose) and bin (the key without `shift` low bits), with least and most."""

    def count(tile: Tile, prefixes: tuple):
        a = np.ascontiguousarray(sample(tile)).reshape(-1)
        a = a[~np.isnan(a)]
        if not a.size:
            return
        keys = sort_keys(a) >> np.uint64(shift)
        if first:
            n = np.bincount(keys.astype(np.int64))
            bins = np.flatnonzero(n)
            empty = np.zeros(len(bins))
            yield _expanded(tile[:2], np.zeros(len(bins), np.int64), bins, n[bins], empty - np.inf, empty + np.inf)
            return
        above = keys >> np.uint64(16)
        for prefix in prefixes[0]:
            inside = above == np.uint64(prefix)
            if inside.any():
                values, n = np.unique(a[inside], return_counts=True)
                bins = (sort_keys(values) >> np.uint64(shift)).astype(np.int64)
                start = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
                end = np.concatenate((start[1:], [len(bins)])) - 1
                yield _expanded(tile[:2], np.full(len(start), prefix, np.int64), bins[start], np.add.reduceat(n, start), values[start], values[end])

    schema = f"{_FRAME_HEAD}, prefix long, bin long, n long, least double, most double"
    made = map_rows(df, count, schema, *([] if first else ["_prefixes"]))
    totals = made.groupBy(*FRAME, "prefix", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    upto = F.sum("n").over(Window.partitionBy(*FRAME, "prefix").orderBy("bin"))
    return totals.withColumn("before", upto - F.col("n"))


def quantiles(df: DataFrame, at: Sequence[float], sample: Callable[[Tile], np.ndarray] = lambda tile: tile[-1]) -> DataFrame:
    """dataset_id, frame_no, q: exact quantiles (array, linear between neighbours) of each frame's values, NaN left out;
    frames without values have no row.

    Counts by the 16 highest bits of a value's sort key name the bin that holds each rank; the next pass counts by the next
    16 bits in those bins only, and so on until a bin has one value: two passes over tiles of whole numbers, four at most. A
    frame's bins are all that one task holds, at most 65,536 for each rank. df is read once a pass, so it should be stored.
    Chosen bins (a few numbers a frame) are broadcast up to a counted number of rows, else joined by frame."""
    counts = _counts(df, sample, PASSES[0], True)
    counts = stored(counts)
    frames = counts.groupBy(*FRAME).agg(F.sum("n").alias("n"))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = []
    for i, q in enumerate(at):
        low = F.floor(place(q)).cast("long")
        ranks += [F.struct(F.lit(2 * i + k).alias("i"), r.alias("r")) for k, r in enumerate((low, F.least(low + 1, F.col("n") - 1)))]
    wanted = frames.select(*FRAME, F.explode(F.array(*ranks)).alias("x")).select(*FRAME, "x.i", "x.r", F.lit(0).cast("long").alias("prefix"))
    found, wanted = [], _narrowed(wanted, counts)
    for shift in PASSES[1:]:
        found.append(wanted.where("least = most"))
        open_ = wanted.where("least <> most")
        if not open_.limit(1).count():
            break
        chosen = stored(open_.groupBy(*FRAME).agg(F.collect_set("prefix").alias("_prefixes")))
        tiles = df.join(bounded(chosen), FRAME)
        wanted = _narrowed(open_.select(*FRAME, "i", "r", "prefix"), _counts(tiles, sample, shift, False))
    else:
        found.append(wanted)
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    by = values.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("i", "least"))).alias("v"))
    pick = lambda i: F.element_at("v", F.lit(i))
    out = []
    for i, q in enumerate(at):
        part, low, high = place(q) - F.floor(place(q)), pick(2 * i), pick(2 * i + 1)
        # infinite neighbours would make NaN of a part of 0
        out.append(F.when((low == high) | (part == 0), low).otherwise(low * (1 - part) + high * part))
    return by.join(frames, FRAME).select(*FRAME, F.array(*out).alias("q"))


def _narrowed(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """Ranks (i, r within prefix) moved to the bin that holds them, which is the new prefix; stored."""
    inside = (F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n"))
    met = wanted.join(counts.select(*FRAME, "prefix", "bin", "n", "before", "least", "most"), [*FRAME, "prefix"]).where(inside)
    return stored(met.select(*FRAME, "i", (F.col("r") - F.col("before")).alias("r"), F.col("bin").alias("prefix"), "least", "most"))


def _every_fourth(tile: Tile) -> np.ndarray:
    """Finite pixels of every fourth row and column of the frame."""
    y0, x0, a = tile[5:]
    a = a[-y0 % 4 :: 4, -x0 % 4 :: 4]
    return a[np.isfinite(a)]


def frame_stats(df: DataFrame) -> DataFrame:
    """See `aggregates.frame_stats`."""
    s = extremes(df, True).groupBy(*FRAME).agg(F.min("least").alias("min"), F.max("most").alias("max"))
    s = s.join(quantiles(df, (0.001, 0.999), _every_fourth), FRAME, "left")
    zero = F.lit(0.0)
    ends = [F.coalesce(F.col("q")[i], c, zero).alias(name) for i, (c, name) in enumerate((("min", "low"), ("max", "high")))]
    return s.select(*FRAME, F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"), *ends)


def normalise(df: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """See `aggregates.normalise`."""
    q = stored(quantiles(df, (low / 100, high / 100)))
    ends = q.select(*FRAME, F.col("q")[0].alias("_a"), F.col("q")[1].alias("_b"))
    return _scaled(df.select(*KEYS, *PLACE, "pixels").join(bounded(ends), FRAME, "left"))


def _scaled(df: DataFrame) -> DataFrame:
    names = [*KEYS, *PLACE, "pixels"]

    def task(batches):
        for batch in batches:
            low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b"))
            off = batch.column("pixels").offsets.to_numpy()
            out = np.empty(len(batch.column("pixels").values))
            for v, a, b, at in zip(views(batch), low, high, off[:-1], strict=True):
                # a frame without values has no ends, which are NaN here
                out[at : at + v.size] = ((v - a) / (b - a) if b > a else np.full(v.shape, np.nan if np.isnan(a) else 0.0)).reshape(-1)
            yield with_pixels(batch, out, names)

    return df.select(*names, "_a", "_b").mapInArrow(task, TILE_SCHEMA)


# --- histograms ------------------------------------------------------------------------------------------------------


def histogram(df: DataFrame, bins: int, low: float | None, high: float | None) -> DataFrame:
    """See `aggregates.histogram`: ends by frame (a first pass, if they aren't given), counts by tile, sums by frame and bin."""
    lit = lambda x: F.lit(None if x is None else float(x)).cast("double")
    zero = F.lit(0.0)
    if low is None or high is None:
        seen = extremes(df, True).groupBy(*FRAME).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        ends = seen.select(*FRAME, F.coalesce(lit(low), "least", zero).alias("_lo"), F.coalesce(lit(high), "most", zero).alias("_hi"))
    else:
        ends = df.select(*FRAME).distinct().select(*FRAME, lit(low).alias("_lo"), lit(high).alias("_hi"))
    ends = stored(ends.withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_hi"))))

    def count(tile: Tile, span: tuple):
        lo, hi = span
        v = tile[-1].reshape(-1)
        if not (v.min() >= lo and v.max() <= hi):  # a NaN makes this false as well
            v = v[(v >= lo) & (v <= hi)]
        place = v - lo
        place /= hi - lo
        place *= bins
        place = place.astype(np.int32)
        n = np.bincount(np.minimum(place, bins - 1, out=place), minlength=bins)
        some = np.flatnonzero(n)
        if len(some):
            yield _expanded(tile[:2], some, n[some])

    made = map_rows(df.join(bounded(ends), FRAME), count, f"{_FRAME_HEAD}, bin int, n long", "_lo", "_hi")
    counts = made.groupBy(*FRAME, "bin").agg(F.sum("n").alias("n"))
    every = ends.select(*FRAME, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counts, [*FRAME, "bin"], "left")
    return out.select(*FRAME, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("_lo").alias("low"), F.col("_hi").alias("high"))


# --- averages over frames --------------------------------------------------------------------------------------------

_PLACES = ["channel", "ty", "tx", "y0", "x0", "h", "w", "n", "pixels"]
_PLACE_SCHEMA = "channel int, ty int, tx int, y0 int, x0 int, h int, w int, n long, pixels binary"
_AVERAGE_SCHEMA = "channel int, ty int, tx int, y0 int, x0 int, h int, w int, pixels array<double>"


def _place_rows(rows: list[tuple], binary: bool) -> pa.RecordBatch:
    """Rows (channel, ty, tx, y0, x0, h, w, n, array), without n where they aren't binary."""
    *head, n, arrays = zip(*rows, strict=True)
    columns = [pa.array(v, pa.int32()) for v in head] + ([pa.array(n, pa.int64())] if binary else []) + [lists(arrays, binary)]
    return pa.RecordBatch.from_arrays(columns, names=[c for c in _PLACES if binary or c != "n"])


def _by_place(batches, keys: int):
    """Runs of rows whose first `keys` columns are equal, read one by one."""
    rows = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(len(_PLACES))], strict=True))
    return groupby(rows, key=lambda row: row[:keys])


def _dealt(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.repartition(*keys[:3]).sortWithinPartitions(*keys).select(*_PLACES)


def average_mean(df: DataFrame) -> DataFrame:
    """One tile of means for each place of the grid: a task sums the tiles of each place that it reads (it holds one frame of
    sums at most), then sums meet by place and are added one after the other."""

    def sums(batches):
        held: dict = {}
        for batch in batches:
            for _, _, c, ty, tx, y, x, a in rows_of(batch):
                if (c, ty, tx) in held:
                    held[c, ty, tx][-2] += 1
                    held[c, ty, tx][-1] += a
                else:
                    held[c, ty, tx] = [c, ty, tx, y, x, *a.shape, 1, a.copy()]
        for row in held.values():
            yield _place_rows([tuple(row)], True)

    def means(batches):
        for _, rows in _by_place(batches, 3):
            first = next(rows)
            total, n = np.frombuffer(first[-1]).copy(), first[-2]
            for row in rows:
                total += np.frombuffer(row[-1])
                n += row[-2]
            yield _place_rows([(*first[:-1], total / n)], False)

    partial = df.select(*KEYS, *PLACE, "pixels").mapInArrow(sums, _PLACE_SCHEMA)
    return _dealt(partial, "channel", "ty", "tx").mapInArrow(means, _AVERAGE_SCHEMA)


def average_median(df: DataFrame, frames: int) -> DataFrame:
    """The same with medians (NaN where a frame has one). Tiles are cut into runs (n: their number) so short that those of all
    `frames` frames fit a task together (MEDIAN_VALUES); the runs of a place meet in one shuffle, medians in another."""
    most = max(1, MEDIAN_VALUES // max(1, frames))

    def runs(batches):
        for batch in batches:
            for _, _, c, ty, tx, y, x, a in rows_of(batch):
                flat = a.reshape(-1)
                yield _place_rows([(c, ty, tx, y, x, *a.shape, k, flat[at : at + most]) for k, at in enumerate(range(0, flat.size, most))], True)

    def medians(batches):
        for _, rows in _by_place(batches, 8):
            held = list(rows)
            middle = np.median(np.stack([np.frombuffer(row[-1]) for row in held]), axis=0)
            yield _place_rows([(*held[0][:-1], middle)], True)

    def whole(batches):
        for _, rows in _by_place(batches, 3):
            held = list(rows)
            yield _place_rows([(*held[0][:-1], np.concatenate([np.frombuffer(row[-1]) for row in held]))], False)

    cut = df.select(*KEYS, *PLACE, "pixels").mapInArrow(runs, _PLACE_SCHEMA)
    by_run = cut.repartition("channel", "ty", "tx", "n").sortWithinPartitions("channel", "ty", "tx", "n").select(*_PLACES)
    made = by_run.mapInArrow(medians, _PLACE_SCHEMA)
    return _dealt(made, "channel", "ty", "tx", "n").mapInArrow(whole, _AVERAGE_SCHEMA)


# --- pyramids --------------------------------------------------------------------------------------------------------


def _halved(a: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 pixels, of what there is at an odd edge."""
    h, w = a.shape
    out = np.add.reduceat(np.add.reduceat(a, np.arange(0, h, 2), axis=0), np.arange(0, w, 2), axis=1)
    rows, cols = (np.minimum(2, n - np.arange(0, n, 2)) for n in (h, w))
    return out / (rows[:, None] * cols)


def pyramid_level(frames: Frames) -> Frames:
    """The next level on tiles of the same size: each tile is halved where it is, and four meet in one by their numbers.

    A tile of odd size would cut 2 x 2 pixels apart: such a grid is first made one pixel larger."""
    if frames.tile % 2:
        frames = retile(frames, Placement(frames.height, frames.width), frames.tile + 1)
    height, width, size = (frames.height + 1) // 2, (frames.width + 1) // 2, frames.tile

    def half(tile: Tile):
        yield (*tile[:3], tile[3] // 2, tile[4] // 2, tile[5] // 2, tile[6] // 2, _halved(tile[-1]))

    def parent(group: list[Tile]) -> Tile:
        key, y, x = group[0][:5], group[0][3] * size, group[0][4] * size
        out = np.full((min(size, height - y), min(size, width - x)), np.nan)
        for t in group:
            out[t[5] - y : t[5] - y + t[-1].shape[0], t[6] - x : t[6] - x + t[-1].shape[1]] = t[-1]
        return (*key, y, x, out)

    return frames.with_(merge_parts(map_tiles(frames.df, half, PART_SCHEMA), parent), height=height, width=width)


def tile_count(frames: Frames) -> int:
    """Tiles of a frame, channels included."""
    return math.ceil(frames.height / frames.tile) * math.ceil(frames.width / frames.tile) * frames.channels


def check_grid(df: DataFrame, frames: Frames, by: Sequence[str] = (), pixels: bool = True) -> None:
    """Tiles of df (by the columns `by`, which name a frame) are those of the grid, each once and whole; else FrameError.

    Without `pixels` their number in each tile is not looked at, so that no pixel is read."""
    t = frames.tile
    right = (F.col("y0") == F.col("ty") * t) & (F.col("x0") == F.col("tx") * t)
    right &= (F.size("pixels") == F.col("h") * F.col("w")) if pixels else F.lit(True)
    right &= (F.col("h") == F.least(
        F.lit(t), F.lit(frames.height) - F.col("y0"),
    )) & (F.col("w") == F.least(F.lit(t), F.lit(frames.width) - F.col("x0")))
    right &= (F.col("ty") >= 0) & (F.col("tx") >= 0) & F.col("channel").between(0, frames.channels - 1)
    n = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(F.when(right, 1)).alias("right"),
        F.count_distinct("channel", "ty", "tx").alias("places"),
    )
    want = tile_count(frames)
    bad = n.where((F.col("n") != want) | (F.col("right") != want) | (F.col("places") != want)).limit(1).collect()
    if bad:
        said = f"{bad[0]['places']} of {want} tiles, {bad[0]['n'] - bad[0]['right']} of a wrong place or size, {bad[0]['n'] - bad[0]['places']} repeated"
        raise FrameError(f"a frame isn't {frames.height} x {frames.width} x {frames.channels} in tiles of {t}: {said}")
