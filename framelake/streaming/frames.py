"""Frames that arrive over time: the stateless operators run unchanged on a streaming table of tiles or pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from framelake.frames import Frames
from framelake.plans.pipeline import Pipeline

#: Operations that need no other pixels of a frame and no state. On tiles, moves are refused where they would cut the grid anew.
STATELESS = {"invert", "clip", "threshold", "tone", "crop", "rotate", "flip", "flat_field"}


def read_frames(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """Frame tables that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_pipeline(frames: Frames, pipeline: Pipeline) -> Frames:
    """Run a pipeline of stateless steps on a streaming stack; others are refused before anything starts."""
    from framelake.errors import FrameError

    other = [s.operation for s in pipeline.steps if s.enabled and s.operation not in STATELESS]
    if other:
        raise FrameError(f"these steps need whole frames and don't run on a stream: {', '.join(other)}")
    return pipeline(frames)
