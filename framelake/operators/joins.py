"""Operators that bring two tables together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import Frames, pointwise, to_tiles
from framelake.functions.pointwise import Staged
from framelake.operators.tile_stats import check_grid
from framelake.tiles import KEYS, PLACE, TILE_SCHEMA, lists, views, with_pixels

#: A reference frame of up to so many pixels is broadcast; a larger one is joined by its position.
BROADCAST_PIXELS = 4_000_000


def _reference(df: DataFrame, name: str, pixels: int) -> DataFrame:
    out = df.select("y", "x", "channel", F.col("value").alias(name))
    return F.broadcast(out) if pixels <= BROADCAST_PIXELS else out


def flat_field(df: DataFrame, pixels: int, dark: DataFrame | None = None, flat: DataFrame | None = None) -> DataFrame:
    """(value - dark) / (flat - dark), 0 where flat - dark isn't above 0 (NaN included); with one reference a difference or a ratio.

    pixels: pixels of a frame, which bound the references. A pixel without reference gets null: see `check_reference`."""
    if dark is None and flat is None:
        raise FrameError("a dark or a flat reference is needed")
    out, at = df, ["y", "x", "channel"]
    if dark is not None:
        out = out.join(_reference(dark, "_dark", pixels), at, "left")
    if flat is not None:
        out = out.join(_reference(flat, "_flat", pixels), at, "left")
    d = F.col("_dark") if dark is not None else F.lit(0.0)
    if flat is None:
        return out.withColumn("value", F.col("value") - d).drop("_dark").select(df.columns)
    beam = F.col("_flat") - d
    value = F.when(beam.isNull(), F.lit(None)).when((beam > 0) & ~F.isnan(beam), (F.col("value") - d) / F.when(beam > 0, beam)).otherwise(F.lit(0.0))
    return out.withColumn("value", value).select(df.columns)


#: References of up to so many bytes are broadcast to join tiles; larger ones are repeated for SALTS groups of frames.
BROADCAST_BYTES = 512 << 20
SALTS = 64


def flat_field_tiles(frames: Frames, dark: DataFrame | None = None, flat: DataFrame | None = None, then: Staged | None = None) -> Frames:
    """`flat_field` on a tile table. References are one frame each on the same grid: channel, ty, tx, y0, x0, h, w, pixels.

    Tiles meet the references of their place as bytes, which Spark hands on without a look, and are combined whole; `then` is
    applied in the same pass. References are checked to be whole."""
    if dark is None and flat is None:
        raise FrameError("a dark or a flat reference is needed")
    at, refs = ["channel", "ty", "tx"], []
    for name, df in (("_dark", dark), ("_flat", flat)):
        if df is not None:
            check_grid(df, frames, pixels=False)
            one = df.select(*at, *PLACE, "pixels").mapInArrow(_packed(name), f"channel int, ty int, tx int, {name} binary")
            refs.append(one)
    size = frames.height * frames.width * frames.channels * 8 * len(refs)
    met = frames.df.select(*KEYS, *PLACE, "pixels")
    if size <= BROADCAST_BYTES:
        for one in refs:
            met = met.join(F.broadcast(one), at)
    else:
        both = refs[0] if len(refs) == 1 else refs[0].join(refs[1], at)
        copies = both.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.withColumn("_salt", F.pmod("frame_no", F.lit(SALTS)).cast("int")).join(copies, [*at, "_salt"])
    names, kernels = [*KEYS, *PLACE, "pixels"], (then.kernels if then else None) or []

    def task(batches):
        for batch in batches:
            off = batch.column("pixels").offsets.to_numpy()
            out = np.zeros(len(batch.column("pixels").values))
            given = [batch.column(c) if c in batch.schema.names else None for c in ("_dark", "_flat")]
            with np.errstate(all="ignore"):
                for i, v in enumerate(views(batch)):
                    d, f = (None if g is None else np.frombuffer(g[i].as_buffer()).reshape(v.shape) for g in given)
                    to = out[off[i] : off[i + 1]].reshape(v.shape)
                    if f is None:
                        np.subtract(v, d, out=to)
                    else:
                        beam = f if d is None else f - d
                        np.divide(v if d is None else v - d, beam, out=to, where=beam > 0)
                    for kernel in kernels:
                        to[...] = kernel(to)
            yield with_pixels(batch, out, names)

    refs_there = [c for c, df in (("_dark", dark), ("_flat", flat)) if df is not None]
    done = frames.with_(met.select(*names, *refs_there).mapInArrow(task, TILE_SCHEMA))
    return done if then is None or kernels else done.with_(pointwise(done.df, then))


def _packed(name: str):
    """Pixels of tiles as bytes."""

    def task(batches):
        for batch in batches:
            lengths = np.diff(batch.column("pixels").offsets.to_numpy())
            if (lengths != batch.column("h").to_numpy() * batch.column("w").to_numpy()).any():
                raise FrameError("a tile of a reference lacks pixels")
            keys = [batch.column(c) for c in ("channel", "ty", "tx")]
            yield pa.RecordBatch.from_arrays([*keys, lists(list(views(batch)), True)], names=["channel", "ty", "tx", name])

    return task


def reference_tiles(df: DataFrame, frames: Frames) -> DataFrame:
    """A reference on the grid of a tile table, be it tiles already or pixels (y, x, channel, value)."""
    if "pixels" in df.columns:
        return df
    pixels = df.select(F.lit("reference").alias("dataset_id"), F.lit(0).cast("long").alias("frame_no"), "y", "x", "channel", "value")
    return to_tiles(pixels, frames.tile).select("channel", "ty", "tx", *PLACE, "pixels")


def check_reference(df: DataFrame, reference: DataFrame) -> None:
    """The reference has the pixels of a frame, no more and no less."""
    a, b = df.select("y", "x", "channel").distinct(), reference.select("y", "x", "channel").distinct()
    if a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
        raise FrameError("the reference differs in shape")


def check_extent(reference: DataFrame, height: int, width: int, channels: int = 1) -> None:
    """The reference, one frame, has every pixel of a frame of this size once. Only the reference is read."""
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1) & F.col("channel").between(0, channels - 1)
    r = reference.agg(F.count("*"), F.count(F.when(inside, 1)), F.count_distinct("y", "x", "channel")).first()
    if set(r) != {height * width * channels}:
        raise FrameError(f"the reference differs in shape: {r[0]} pixels for {height} x {width} x {channels}")


def apply_colormap(df: DataFrame, table: DataFrame, name: str, channels: int) -> DataFrame:
    """r, g, b of 8-bit pixels, by a table (cmap, index, r, g, b) of 256 rows a map; values beyond 0..255 take its ends.

    Frames of three channels have their colours already: they become r, g, b as they are. Frames said to have one channel that
    have more raise when they are computed."""
    if channels not in (1, 3):
        raise FrameError(f"frames of {channels} channels have no colours")
    rows = table.where(F.col("cmap") == name).select("index", "r", "g", "b")
    held = rows.limit(257).collect()
    if not held:
        raise FrameError(f"unknown colour map {name!r}")
    if sorted(r["index"] for r in held) != list(range(256)):
        raise FrameError(f"colour map {name!r} has no 256 rows of index 0 to 255")
    level = F.least(F.greatest(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(255.0)).cast("int")
    if channels == 3:
        of = lambda c: F.max(F.when(F.col("channel") == c, level))
        return df.groupBy("dataset_id", "frame_no", "y", "x").agg(of(0).alias("r"), of(1).alias("g"), of(2).alias("b"))
    single = F.when(F.col("channel") == 0, level).otherwise(F.raise_error(F.lit("a colour map is for frames of one channel")).cast("int"))
    return df.join(F.broadcast(rows), single == F.col("index"), "left").drop("index")


def manifest_diff(source: DataFrame, target: DataFrame, overwrite: bool = False) -> DataFrame:
    """What to do with each source file (path, length, modified, and md5 where known): copy, skip, conflict, or error where a
    folder is in the way."""
    t = target.select(
        F.col("path").alias("_p"), F.col("length").alias("_n"), F.col("modified").alias("_m"),
        *([F.col("is_dir").alias("_d")] if "is_dir" in target.columns else [F.lit(False).alias("_d")]),
    )
    same = (F.col("_n") == F.col("length")) & (F.floor(F.unix_micros("_m") / 1_000_000) == F.floor(F.unix_micros("modified") / 1_000_000))
    status = F.when(F.col("_p").isNull(), "copy").when(F.col("_d"), "error").when(same, "skip").otherwise("copy" if overwrite else "conflict")
    known = ["md5"] if "md5" in source.columns else []
    return source.join(t, F.col("path") == F.col("_p"), "left").select("path", "length", *known, status.alias("status"))


def copy_summary(diff: DataFrame, verify: bool = False) -> DataFrame:
    """copied, skipped, conflicts, bytes and checksummed of a diff, in one row.

    checksummed: copied files whose checksum is compared: all with verify, else those whose MD5 is known (a column md5)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    known = F.lit(verify) | (F.col("md5").isNotNull() if "md5" in diff.columns else F.lit(False))
    checked = F.count(F.when((F.col("status") == "copy") & known, 1))
    size = F.coalesce(F.sum(F.when(F.col("status") == "copy", F.col("length"))), F.lit(0)).cast("long")
    return diff.agg(
        n("copy").alias("copied"), n("skip").alias("skipped"), n("conflict").alias("conflicts"), size.alias("bytes"),
        checked.alias("checksummed"),
    )


def verify_copies(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files (path, length, and digest or md5 where known) that differ: missing, extra, size, md5 or digest.

    A checksum counts where both sides have it: md5 is what a store tells of its files, digest a SHA-256 made on request."""

    def side(df: DataFrame, end: str) -> DataFrame:
        sums = [F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("md5", "digest")]
        return df.select("path", F.col("length").alias(f"n{end}"), *[c.alias(f"{k}{end}") for c, k in zip(sums, "md", strict=True)])

    problem = F.when(F.col("n2").isNull(), "missing").when(F.col("n1").isNull(), "extra").when(F.col("n1") != F.col("n2"), "size")
    problem = problem.when(F.col("m1") != F.col("m2"), "md5").when(F.col("d1") != F.col("d2"), "digest")
    both = side(source, "1").join(side(target, "2"), "path", "full_outer")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def digests(files: DataFrame, verify: bool = True) -> DataFrame:
    """path, length, md5 and, with verify, digest (SHA-256) of a binaryFile table."""
    return files.select("path", "length", F.md5("content").alias("md5"), *([F.sha2("content", 256).alias("digest")] if verify else []))


def pending_timesteps(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Time steps without output yet."""
    return steps.select("step").distinct().join(done.select("step"), "step", "left_anti")


def frame_comparison(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """By frame: pixels, pixels that only one stack has, pixels beyond the tolerance, the largest difference."""
    key = ["dataset_id", "frame_no", "y", "x", "channel"]
    j = a.select(*key, F.col("value").alias("v")).join(b.select(*key, F.col("value").alias("w")), key, "full_outer")
    off = F.abs(F.col("v") - F.col("w"))
    single = F.col("v").isNull() | F.col("w").isNull()
    return j.groupBy("dataset_id", "frame_no").agg(
        F.count("*").alias("pixels"), F.count(F.when(single, 1)).alias("unmatched"),
        F.count(F.when(off > atol + rtol * F.abs("w"), 1)).alias("different"), F.max(off).alias("max_difference"),
    )
