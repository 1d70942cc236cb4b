"""Sinks: checked frame tables in Parquet with a catalog that commits them, and the record of the run that made them."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import Frames, check_axes
from framelake.functions.pointwise import SPARK_TYPES
from framelake.operators.ordering import stored
from framelake.operators.tile_stats import check_grid

RUN = "run_id string, source string, frames string, dtype string, low double, high double, created timestamp, pipeline string"
#: A stack's row in the catalog of its folder. data names the folder of the frames; the greatest version counts.
CATALOG = (
    "version long, data string, axes array<string>, counts array<long>, height int, width int, channels int, tile int, "
    "dtype string, metadata map<string,string>, warnings array<string>, created timestamp"
)


def check_frames(frames: Frames, count: int | None = None) -> int:
    """Number of frames; raises where a frame lacks pixels or has some twice, or frames are missing.

    Pixels are told apart by bits: a bitmap for each run of 32,768 places of a frame, made by Spark's own aggregate."""
    size, by = frames.height * frames.width * frames.channels, ["dataset_id", "frame_no"]
    if "pixels" in frames.df.columns:
        check_grid(frames.df, frames, by)
        n = frames.df.select(*by).distinct().count()
    else:
        place = ((F.col("y") * frames.width + F.col("x")) * frames.channels + F.col("channel")).cast("long")
        inside = F.col("y").between(0, frames.height - 1) & F.col("x").between(0, frames.width - 1) & F.col("channel").between(0, frames.channels - 1)
        runs = frames.df.select(*by, F.when(inside, place).alias("p")).groupBy(*by, F.bitmap_bucket_number("p").alias("run"))
        bits = runs.agg(F.count("*").alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("p"))).alias("places"))
        each = bits.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
        n, wrong = each.agg(F.count("*"), F.count(F.when((F.col("n") != size) | (F.col("places") != size), 1))).first()
        if wrong:
            raise FrameError(f"{wrong} frames are not {frames.height} x {frames.width} x {frames.channels}, every pixel once")
    if count is not None and n != count:
        raise FrameError(f"{n} frames, not {count}")
    return n


def json_safe(metadata: Mapping[str, Any]) -> dict[str, str]:
    """Values as JSON by name; what JSON does not know becomes text, numbers that are not finite become null."""

    def safe(v: Any) -> Any:
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, Mapping):
            return {str(k): safe(x) for k, x in v.items()}
        return [safe(x) for x in v] if isinstance(v, (list, tuple)) else v

    return {k: json.dumps(safe(v), default=str) for k, v in metadata.items()}


def _catalog(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(CATALOG).parquet(f"{path}/catalog")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def catalog_row(spark: SparkSession, path: str):
    """The row of the stack in a folder; None where no write was finished."""
    df = _catalog(spark, path)
    return None if df is None else df.orderBy(F.desc("version")).first()


def write_frames(frames: Frames, path: str, count: int | None = None, overwrite: bool = False, held: bool = False) -> DataFrame:
    """Write a stack (pixels or tiles) to a folder, in C order, and return the frames that are stored; see `read_frames`.

    The frames are checked (`check_frames`; their number is that of the frame axes, where it is known) and written to a folder
    of their own; then one row of the catalog, with axes, shape, pixel type and metadata, names that folder. A write that fails
    leaves no row, so that readers see what was there before, and no frames. overwrite adds a row of a higher version; frames
    of lower ones can then be removed. Check and write read a checkpoint, so that the plan runs once; held: the frames come
    cheaply from one already."""
    spark = frames.df.sparkSession
    before = catalog_row(spark, path)
    if before is not None and not overwrite:
        raise FrameError(f"{path} already exists")
    axes = check_axes(frames.axes)
    if count is None and frames.counts is not None:
        count = math.prod(frames.counts)
    if not held:
        frames = frames.with_(stored(frames.df))
    n = check_frames(frames, count)
    counts = frames.counts if frames.counts is not None else (n,)
    version = 0 if before is None else before["version"] + 1
    data = f"data-{version}-{uuid.uuid4().hex[:8]}"
    order = ["channel", "ty", "tx"] if "pixels" in frames.df.columns else ["y", "x", "channel"]
    df = frames.df.repartitionByRange("dataset_id", "frame_no", order[1]).sortWithinPartitions("dataset_id", "frame_no", *order)
    said = (version, data, list(axes), list(counts), frames.height, frames.width, frames.channels, frames.tile, frames.dtype)
    row = spark.createDataFrame([(*said, json_safe(frames.metadata), list(frames.warnings), datetime.now(UTC).replace(tzinfo=None))], CATALOG)
    try:
        df.write.mode("errorifexists").partitionBy("dataset_id").parquet(f"{path}/{data}")
        row.coalesce(1).write.mode("append").parquet(f"{path}/catalog")
    except BaseException:
        _remove(spark, f"{path}/{data}")
        raise
    return spark.read.schema(frames.df.schema).parquet(f"{path}/{data}")


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of whatever store Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_frames(spark: SparkSession, path: str) -> Frames:
    """The stack that was last written to a folder, with its axes, lengths, pixel type, metadata and warnings."""
    row = catalog_row(spark, path)
    if row is None:
        raise FrameError(f"{path} has no finished stack")
    kind = SPARK_TYPES.get(row["dtype"], "double")
    head = "frame_no long, channel int, ty int, tx int, y0 int, x0 int, h int, w int" if row["tile"] else "frame_no long, y int, x int, channel int"
    df = spark.read.parquet(f"{path}/{row['data']}")
    value = next(c for c in ("pixels", "value") if c in df.columns)
    columns = ["dataset_id", *[c.split()[0] for c in head.split(", ")]]
    as_said = F.col(value).cast(f"array<{kind}>" if value == "pixels" else kind).alias(value)
    metadata = {k: json.loads(v) for k, v in row["metadata"].items()}
    size = (row["height"], row["width"], row["channels"], row["tile"])
    return Frames(
        df.select(F.col("dataset_id").cast("string"), *columns[1:], as_said), *size, tuple(row["axes"]), tuple(row["counts"]),
        row["dtype"], metadata, tuple(row["warnings"]),
    )


def run_record(
    spark: SparkSession, run_id: str, source: str, frames: tuple[int | None, int | None, int | None], dtype: str,
    low: float | None, high: float | None, pipeline: str,
) -> DataFrame:
    """A runs row: what was made of which frames, by which pipeline (YAML), when."""
    said = yaml.safe_dump(dict(zip(("start", "stop", "step"), frames, strict=True)))
    return spark.createDataFrame([(run_id, source, said, dtype, low, high, datetime.now(UTC).replace(tzinfo=None), pipeline)], RUN)
