"""File listings and what the catalog says: all of it DataFrames of paths, so that listings of any size work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.functions.scalars import glob_match, natural_key, openable


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, length and modified of files directly in a folder, by Spark's own listing (no contents are read)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def listing(entries: DataFrame) -> DataFrame:
    """Entries (name, is_dir, length) as shown: hidden ones left out, folders first, natural order; with openable."""
    shown = entries.where(~F.startswith("name", F.lit(".")))
    shown = shown.withColumn("openable", ~F.col("is_dir") & openable(F.col("name")))
    return shown.orderBy(~F.col("is_dir"), natural_key(F.col("name")), "name")


def find_files(files: DataFrame, folder: str, pattern: str) -> DataFrame:
    """Files (folder, name) directly in a folder that match a pattern."""
    return files.where((F.col("folder") == folder) & glob_match(F.col("name"), pattern))


def require_files(found: DataFrame, what: str) -> DataFrame:
    if not found.limit(1).count():
        raise FrameError(f"no file matches {what}")
    return found


def check_same_shape(files: DataFrame) -> DataFrame:
    """Files (frame_no, name, shape) whose shape is not that of the first frame."""
    first = files.agg(F.min_by("shape", "frame_no").alias("_first"))
    return files.join(F.broadcast(first), F.col("shape") != F.col("_first")).drop("_first")  # one row


def missing_frames(present: DataFrame, claimed: DataFrame) -> DataFrame:
    """dataset_id, frame_no of frames before the last one written that are not there. claimed: dataset_id, frames."""
    ends = present.groupBy("dataset_id").agg((F.max("frame_no") + 1).alias("end"))
    known = claimed.join(ends, "dataset_id", "left").select(
        "dataset_id", F.least(F.coalesce("end", F.lit(0)), "frames").alias("end"),
    ).where("end > 0")
    every = known.select("dataset_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - 1)).alias("frame_no"))
    return every.join(present.select("dataset_id", "frame_no").distinct(), ["dataset_id", "frame_no"], "left_anti")


def is_image(shape: Column, dtype: Column) -> Column:
    """At least two dimensions of booleans, integers or floats."""
    return (F.size(shape) >= 2) & dtype.rlike("^(bool|u?int(8|16|32|64)|float(32|64))$")


def select_dataset(datasets: DataFrame) -> DataFrame:
    """By path: the one image dataset, or a message that lists the candidates."""
    c = datasets.where(is_image(F.col("shape"), F.col("dtype"))).groupBy("path").agg(F.array_sort(F.collect_list("dataset_id")).alias("ids"))
    every = datasets.select("path").distinct().join(c, "path", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    problem = F.when(n == 0, "no image dataset").when(n > 1, F.concat(F.lit("choose one of "), F.array_join("ids", ", ")))
    return every.select("path", F.when(n == 1, F.col("ids")[0]).alias("dataset_id"), problem.alias("problem"))


def default_axes(shape: Column, labels: Column | None = None) -> Column:
    """Axes (array<string>) by labels if they fit, else by the number of dimensions; null where they can't be told."""
    n, last = F.size(shape), F.element_at(shape, -1)
    colour = last.isin(3, 4)
    names = lambda *a: F.array(*[F.lit(x) for x in a])
    out = F.when(n == 2, names("y", "x")).when((n == 3) & colour, names("y", "x", "channel")).when(n == 3, names("frame", "y", "x")).when(
        (n == 4) & colour, names("frame", "y", "x", "channel"),
    )
    if labels is None:
        return out
    return F.when(labels.isNotNull() & (F.size(labels) == n), labels).otherwise(out)


def reference_files(references: DataFrame, files: DataFrame) -> DataFrame:
    """reference, path of each named file, or of every openable file of each named folder, in natural order within it.

    references: reference, entry; files: path, folder, name."""
    named = references.join(files, F.col("entry") == F.col("path")).select("reference", "path", "name")
    inside = references.join(files.where(openable(F.col("name"))), F.col("entry") == F.col("folder")).select("reference", "path", "name")
    return named.unionByName(inside).distinct().select("reference", "path", natural_key(F.col("name")).alias("order"))


def missing_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that are neither a file nor a folder with files."""
    known = files.select(F.col("path").alias("entry")).union(files.select("folder")).distinct()
    return references.join(known, "entry", "left_anti")
