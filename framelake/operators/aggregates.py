"""Reductions over frames, pixels and files. Those of frames take pixel tables and tile tables (`tile_stats`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import FRAME, Frames
from framelake.functions.scalars import glob_match, image, natural_key, parse_timestep, sequence_number, sequence_pattern
from framelake.operators import tile_stats
from framelake.operators.ordering import bounded, global_rank, stored
from framelake.sources.files import check_same_shape

PLACE = ["y", "x", "channel"]


def is_tiles(df: DataFrame) -> bool:
    return "pixels" in df.columns


_INF = float("inf")


def average_frames(df: DataFrame, method: str = "mean") -> DataFrame:
    """One frame: the mean (or median) of every pixel over all frames; a median with a NaN is NaN. No frames are refused.

    Of a pixel table: y, x, channel, value; of a tile table: channel, ty, tx, y0, x0, h, w, pixels."""
    if method not in ("mean", "median"):
        raise FrameError(f"{method} is not mean or median")
    if df.isEmpty():
        raise FrameError("there are no frames to average")
    if is_tiles(df):
        if method == "mean":
            return tile_stats.average_mean(df)
        return tile_stats.average_median(df, df.select(*FRAME).distinct().count())
    value = F.avg("value") if method == "mean" else F.when(
        F.max(F.isnan("value").cast("int")) == 1, F.lit(float("nan")),
    ).otherwise(F.percentile("value", F.lit(0.5)))
    return df.groupBy(*PLACE).agg(value.alias("value"))


def value_range(df: DataFrame) -> DataFrame:
    """low and high of all values, NaN left out; 0 and 1 if there are none. One row."""
    if is_tiles(df):
        return tile_stats.value_range(df)
    seen = F.when(~F.isnan("value"), F.col("value"))
    r = df.agg(F.min(seen).alias("low"), F.max(seen).alias("high"))
    return r.select(F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))


def _finite():
    v = F.col("value")
    return F.when(~F.isnan(v) & (v != _INF) & (v != -_INF), v)


def frame_stats(df: DataFrame) -> DataFrame:
    """min, max of finite pixels and 0.1 / 99.9 percentiles of every fourth pixel of every fourth row, by frame.

    A tile table is read several times (`tile_stats.quantiles`), so it should be stored."""
    if is_tiles(df):
        return tile_stats.frame_stats(df)
    f = _finite()
    sample = F.when((F.col("y") % 4 == 0) & (F.col("x") % 4 == 0), f)
    s = df.groupBy(*FRAME).agg(F.min(f).alias("min"), F.max(f).alias("max"), F.percentile(sample, F.array(F.lit(0.001), F.lit(0.999))).alias("p"))
    zero = F.lit(0.0)
    return s.select(
        *FRAME, F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"),
        F.coalesce(F.col("p")[0], "min", zero).alias("low"), F.coalesce(F.col("p")[1], "max", zero).alias("high"),
    )


def histogram(df: DataFrame, bins: int = 256, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts by frame in equal bins of low..high (default: the frame's finite range); the last bin is closed."""
    if not 2 <= bins <= 4096:
        raise FrameError("bins are 2 to 4096")
    if is_tiles(df):
        return tile_stats.histogram(df, bins, low, high)
    f = _finite()
    ends = df.groupBy(*FRAME).agg(F.coalesce(F.min(f), F.lit(0.0)).alias("_lo"), F.coalesce(F.max(f), F.lit(0.0)).alias("_hi"))
    if low is not None:
        ends = ends.withColumn("_lo", F.lit(float(low)))
    if high is not None:
        ends = ends.withColumn("_hi", F.lit(float(high)))
    ends = ends.withColumn("_hi", F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_hi")))
    bin_ = F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    inside = ~F.isnan("value") & (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    counts = df.join(ends, FRAME).where(inside).groupBy(*FRAME, bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(*FRAME, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counts, [*FRAME, "bin"], "left")
    return out.select(*FRAME, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("_lo").alias("low"), F.col("_hi").alias("high"))


def pyramid_level(df: DataFrame) -> DataFrame:
    """The next level: means of 2 x 2 pixels; an odd last row or column averages what there is."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return df.groupBy(*FRAME, half("y"), half("x"), "channel").agg(F.avg("value").alias("value"))


def pyramid_levels(height: int, width: int, tile: int = 512) -> int:
    """Levels until the last one fits a tile: one more than the halvings that the longer side needs."""
    return 1 + (-(-max(height, width, 1) // tile) - 1).bit_length()


def tile_index(df: DataFrame, size: int) -> DataFrame:
    """Pixels, extent and mean of each tile of size x size."""
    ty, tx = F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx")
    return df.groupBy(*FRAME, "channel", ty, tx).agg(
        F.count("*").alias("n"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"),
        F.avg("value").alias("mean"),
    )


def normalise(df: DataFrame, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """Each frame's percentiles low..high (all channels, NaN left out) to 0..1; values beyond them go beyond 0..1.

    NaN stays NaN, but an empty span gives zeros throughout. A tile table is read several times, so it should be stored."""
    if not 0 <= low < high <= 100:
        raise FrameError("percentiles are 0 to 100, low below high")
    if is_tiles(df):
        return tile_stats.normalise(df, low, high)
    seen = F.when(~F.isnan("value"), F.col("value"))
    p = df.groupBy(*FRAME).agg(F.percentile(seen, F.array(F.lit(low / 100), F.lit(high / 100))).alias("_p"))
    a, b, v = F.col("_p")[0], F.col("_p")[1], F.col("value")
    scaled = F.when(a.isNull(), F.lit(float("nan"))).when(b > a, (v - a) / F.when(b > a, b - a)).otherwise(F.lit(0.0))
    return df.join(p, FRAME).withColumn("value", scaled).select(df.columns)


def find_sequences(files: DataFrame) -> DataFrame:
    """Names of images that differ in their last number alone: pattern, n (2 or more) and the first in natural order."""
    numbered = files.where(F.col("name").rlike(r"\d") & image(F.col("name")))
    grouped = numbered.groupBy(sequence_pattern(F.col("name")).alias("pattern")).agg(
        F.count("*").alias("n"), F.min(F.struct(natural_key(F.col("name")).alias("k"), "name")).alias("f"),
    )
    return grouped.where("n >= 2").select("pattern", "n", F.col("f.name").alias("first"))


def sequence_files(files: DataFrame, pattern: str) -> DataFrame:
    """Files of a sequence with frame_no in natural order. No match is refused, and so is, where files have a shape, a file
    whose shape is not that of the first (by name)."""
    found = global_rank(files.where(glob_match(F.col("name"), pattern)), natural_key(F.col("name")), "name", name="frame_no")
    if found.isEmpty():
        raise FrameError(f"no file matches {pattern}")
    if "shape" in files.columns:
        odd = check_same_shape(found).orderBy("frame_no").select("name", "shape").first()
        if odd:
            raise FrameError(f"{odd['name']} has shape {tuple(odd['shape'])}, unlike the first file of {pattern}")
    return found.select("name", "frame_no", sequence_number(F.col("name")).alias("number"))


def group_timesteps(files: DataFrame) -> DataFrame:
    """Files (name) by time step: step, files and the first name; names without a step are left out."""
    steps = files.select("name", parse_timestep(F.col("name")).alias("step")).where("step is not null")
    return steps.groupBy("step").agg(F.count("*").alias("files"), F.min("name").alias("first"))


def load_reference(named: DataFrame, stack: Frames, reference: str, method: str = "mean") -> DataFrame:
    """One frame: the average of every frame of the files that a reference names (reference, path: see `reference_files`).

    stack: frames (pixels or tiles) of any files, whose dataset_id is the file's path. A reference without files, files
    without frames and frames of another size are refused; the size is checked for every frame."""
    paths = stored(named.where(F.col("reference") == reference).select(F.col("path").alias("dataset_id")).distinct())
    if paths.isEmpty():
        raise FrameError(f"reference {reference!r} names no file")
    frames = stack.with_(stack.df.join(bounded(paths), "dataset_id", "left_semi"))
    empty = paths.join(frames.df.select("dataset_id").distinct(), "dataset_id", "left_anti").first()
    if empty:
        raise FrameError(f"{empty[0]} of reference {reference!r} has no frames")
    by = ["dataset_id", "frame_no"]
    if is_tiles(stack.df):
        tile_stats.check_grid(frames.df, stack, by)
    else:
        size = frames.df.groupBy(*by).agg(F.count("*").alias("n"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        want = stack.height * stack.width * stack.channels
        odd = size.where((F.col("n") != want) | (F.col("h") != stack.height) | (F.col("w") != stack.width)).first()
        if odd:
            raise FrameError(f"{odd['dataset_id']} has a frame of {odd['h']} x {odd['w']}, not {stack.height} x {stack.width}")
    return average_frames(frames.df, method)


def dataset_size(datasets: DataFrame) -> DataFrame:
    """frames and bytes of catalog rows (shape, axes, item_bytes)."""
    product = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda x, y: x * y)
    tail = F.when(F.element_at("axes", -1) == "channel", 3).otherwise(2)
    lead = F.slice("shape", F.lit(1), (F.size("shape") - tail).cast("int"))
    return datasets.select("dataset_id", product(lead).alias("frames"), (product("shape") * F.col("item_bytes")).alias("bytes"))


def grid_check(volumes: DataFrame) -> DataFrame:
    """One row: volumes, and whether all have one shape, dtype, field, spacing and origin."""
    return volumes.agg(
        F.count("*").alias("volumes"),
        (F.count_distinct(F.struct("shape", "dtype", "field", "spacing", "origin")) <= 1).alias("one_grid"),
    )


def time_monotonic(volumes: DataFrame) -> DataFrame:
    """Volumes (rank, time_s; ranks without gaps) whose time is not after the one before."""
    before = volumes.select((F.col("rank") + 1).alias("rank"), F.col("time_s").alias("before"))
    return volumes.select("rank", "time_s").join(before, "rank").where("time_s <= before")
