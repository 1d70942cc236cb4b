"""Ranks over whole tables without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.errors import FrameError


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share.

    Only a single-machine session (master local) that names none gets a temporary folder of its own; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise FrameError("spark.checkpoint.dir names no folder that all executors share")
    import tempfile

    folder = f"file://{tempfile.mkdtemp(prefix='framelake-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The same rows in the shared checkpoint folder, where a lost executor doesn't take them along."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A stored table of a few columns, broadcast behind a count of its rows; a longer one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank", first: int = 0) -> DataFrame:
    """df with its place in a total order: rows are dealt to ranges of the order, ranked within each, and moved on by the
    sizes of the ranges before. Only one number for each range comes to the driver."""
    held = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    held = stored(held)
    total, before = first, []
    for part, n in sorted((r[0], r[1]) for r in held.groupBy("_range").count().collect()):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_before")
    return held.join(F.broadcast(offsets), "_range").withColumn(name, rank.cast("long")).drop("_range", "_before")
