"""Stacks with axes and metadata through selection, conversion, mapping and the sink."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import Frames, tiles_from_array_column, to_pixels
from framelake.operators import convert, geometry
from framelake.plans.pipeline import Pipeline, Step, run_pipeline
from framelake.sources import writers

NAN = float("nan")


def stack(spark, a, tile=None, **said) -> Frames:
    """A stack of (frame axes..., y, x)."""
    a = np.asarray(a, float)
    *counts, h, w = a.shape
    flat = a.reshape(-1, h, w)
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(flat)], "k long, v array<double>")
    f = tiles_from_array_column(df, "k", "v", h, w, F.lit("d"), tile or 64)
    axes = (("angle", "time")[: len(counts)] if counts else ()) + ("y", "x")
    return Frames(f.df if tile else to_pixels(f.df), h, w, tile=tile, axes=axes, counts=tuple(counts), **said)


def array(f: Frames) -> np.ndarray:
    df = to_pixels(f.df) if "pixels" in f.df.columns else f.df
    out = np.full((int(np.prod(f.counts)), f.height, f.width), NAN)
    for r in df.collect():
        out[r.frame_no, r.y, r.x] = r.value
    return out.reshape(f.shape)


FOUR = np.arange(4 * 3 * 6 * 5).reshape(4, 3, 6, 5)


@pytest.mark.parametrize("tile", [None, 4])
def test_selection_along_the_first_axis(spark, tile):
    f = stack(spark, FOUR, tile)
    for key in (slice(None, None, -2), slice(1, 3), slice(3, 0, -1), [3, 1, 3, -4], [True, False, True, False]):
        got = geometry.select_first(f, key)
        assert got.axes == f.axes and (array(got) == FOUR[key]).all()
    one = geometry.select_first(f, -1)
    assert one.axes == ("time", "y", "x") and (array(one) == FOUR[-1]).all()
    assert geometry.select_first(one, 2).counts == ()
    assert geometry.select_first(f, slice(2, 2)).df.count() == 0 and geometry.select_first(f, []).counts == (0, 3)
    for bad in (4, -5, [4], [True]):
        with pytest.raises(FrameError):
            geometry.select_first(f, bad)
    with pytest.raises(FrameError, match="no frame axis"):
        geometry.select_first(f.with_(f.df, counts=None), 0)


def test_selection_tables(spark):
    f = stack(spark, FOUR)
    chosen = spark.createDataFrame([(2, 0), (2, 1), (0, 2), (9, 3)], "number long, place long")
    got = f.with_(geometry.select_by_table(f.df, chosen, 3), counts=(3, 3))
    assert (array(got) == FOUR[[2, 2, 0]]).all()


@pytest.mark.parametrize("tile", [None, 4])
def test_round_trip_keeps_axes_and_metadata(spark, tmp_path, tile):
    metadata = {"energy_kev": 25.0, "nested": {"a": [1, NAN]}, "name": "é"}
    f = stack(spark, FOUR, tile, dtype="uint16", metadata=metadata, warnings=("late",))
    path = str(tmp_path / "out")
    writers.write_frames(f, path)
    got = writers.read_frames(spark, path)
    assert (got.axes, got.counts, got.shape, got.dtype, got.tile, got.warnings) == (
        ("angle", "time", "y", "x"), (4, 3), (4, 3, 6, 5), "uint16", tile, ("late",),
    )
    assert got.metadata == {"energy_kev": 25.0, "nested": {"a": [1, None]}, "name": "é"} and (array(got) == FOUR).all()
    with pytest.raises(FrameError, match="already exists"):
        writers.write_frames(f, path)
    writers.write_frames(f.with_(f.df, metadata={}), path, overwrite=True)
    assert writers.read_frames(spark, path).metadata == {}


@pytest.mark.parametrize("tile", [None, 4])
def test_failed_writes_leave_what_was_there(spark, tmp_path, tile):
    f, path = stack(spark, FOUR, tile), str(tmp_path / "out")
    first = f.df.where("frame_no = 0")
    value = "pixels" if tile else "value"
    some = f.df.where("frame_no <> 1").unionByName(first.withColumn("frame_no", F.lit(1).cast("long")).where("ty + tx > 0" if tile else "y + x > 0"))
    again = first.where("ty = 1 and tx = 1" if tile else "y = 3 and x = 3").withColumn("frame_no", F.lit(1).cast("long"))
    twice = some.unionByName(again)
    for bad in (some, twice, f.df.where("frame_no < 11")):
        with pytest.raises(FrameError):
            writers.write_frames(f.with_(bad), path)
    with pytest.raises(FrameError, match="no finished stack"):
        writers.read_frames(spark, path)
    writers.write_frames(f, path)
    before = sorted(os.listdir(path))
    fails = f.df.withColumn(
        value,
        F.when(F.col("frame_no") == 11, F.raise_error(F.lit("broken")).cast(f.df.schema[value].dataType)).otherwise(F.col(value)),
    )
    with pytest.raises(Exception, match="broken"):
        writers.write_frames(f.with_(fails), path, overwrite=True)
    assert sorted(os.listdir(path)) == before and (array(writers.read_frames(spark, path)) == FOUR).all()


def test_a_failure_between_data_and_catalog_leaves_no_data(spark, tmp_path):
    f, path = stack(spark, FOUR), tmp_path / "out"
    path.mkdir()
    (path / "catalog").write_text("in the way")
    with pytest.raises(Exception, match="catalog"):
        writers.write_frames(f, str(path))
    assert [n for n in os.listdir(path) if n.startswith("data")] == []


FLOATS = np.linspace(-1.0, 3.0, 2 * 6 * 7).reshape(2, 6, 7)


@pytest.mark.parametrize("tile", [None, 4])
def test_conversion_tells_how(spark, tile):
    f = stack(spark, FLOATS, tile, dtype="float32", metadata={"missing_frames": [1], "k": 2})
    got = convert.convert(f, "uint16")
    said = got.metadata["value_scaling"]
    assert got.dtype == "uint16" and said["value_range"] == [-1.0, 3.0] and said["source_dtype"] == "float32" and not got.warnings
    assert got.metadata["source_missing_frames"] == [1] and "missing_frames" not in got.metadata and got.metadata["k"] == 2
    back = convert.recover(got)
    assert back.dtype == "float32" and "value_scaling" not in back.metadata and abs(array(back) - FLOATS).max() <= said["scale"] / 2 + 1e-9
    clipped = convert.convert(f, "uint8", (0, 1))
    want = np.rint(np.clip(FLOATS, 0, 1) * 255)
    assert len(clipped.warnings) == 1 and (array(clipped) == want).all()
    assert not convert.convert(f, "uint8", (-1, 3)).warnings
    part = convert.convert(f, select=[1])
    assert part.metadata["source_frames"] == [1] and "value_scaling" not in part.metadata and part.dtype == "float32" and part.counts == (1,)
    assert convert.convert(f, "float64", select=-1).metadata["source_frames"] == [1]
    whole = convert.convert(stack(spark, np.round(FLOATS), tile, dtype="uint8"), "uint16")
    assert "value_scaling" not in whole.metadata and (array(whole) == np.round(FLOATS)).all()
    odd = np.array([[[NAN, float("inf"), -float("inf"), 5.0]]])
    assert array(convert.convert(stack(spark, odd, tile), "uint16", (0, 10)))[0, 0].tolist() == [0, 65535, 0, 32768]
    with pytest.raises(FrameError, match="not a pixel type"):
        convert.convert(f, "complex64")
    with pytest.raises(FrameError, match="no value_scaling"):
        convert.recover(f)


@pytest.mark.parametrize("tile", [None, 4])
def test_mapped_frames(spark, tile):
    f = stack(spark, FOUR, tile, metadata={"energy": 25})
    got = convert.map_frames(f, lambda a: a[1:, :3] * 2, 5, 3, {"note": "x"})
    assert got.metadata == {"energy": 25, "note": "x"} and got.shape == (4, 3, 5, 3) and got.axes == f.axes
    assert (array(got) == FOUR[:, :, 1:, :3] * 2).all()
    with pytest.raises(FrameError, match="no frames"):
        convert.map_frames(f.with_(f.df.limit(0)), lambda a: a)
    for bad in (lambda a: a[0], lambda a: a[1:]):
        with pytest.raises(Exception, match="made a frame of shape"):
            convert.map_frames(f, bad).df.collect()


def test_runs_on_tiles(spark, tmp_path):
    f = stack(spark, FOUR[:, 0], 4, metadata={"k": 1})
    p, path = Pipeline([Step("crop", {"top": 1}), Step("flip")]), str(tmp_path / "run")
    stored = run_pipeline(f, p, path, "r", "s", 4, (None, None, 2), "uint8")
    assert stored.count() == 2 * 4
    got = writers.read_frames(spark, f"{path}/frames")
    assert got.metadata["run"]["pipeline"] == p.to_yaml() and got.metadata["k"] == 1 and got.counts == (2,) and got.dtype == "uint8"
    row = spark.read.parquet(f"{path}/run").first()
    assert [row.low, row.high] == got.metadata["value_scaling"]["value_range"]
    want = FOUR[::2, 0, 1:, ::-1]
    assert abs(array(convert.recover(got)) - want).max() <= got.metadata["value_scaling"]["scale"] / 2 + 1e-9
    with pytest.raises(FrameError, match="already exists"):
        run_pipeline(f, p, path, "r", "s", 4)
