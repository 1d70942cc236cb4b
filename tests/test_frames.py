"""Closed forms, edges and refusals of the frame operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import PIXELS, Frames, check_axes, frame_axes, pointwise, tiles_from_array_column, to_pixels, to_tiles
from framelake.functions import pointwise as fn
from framelake.functions import scalars
from framelake.functions.colormaps import color_tables, read_color_tables
from framelake.operators import aggregates, convert, geometry, joins, neighbourhood, ordering
from framelake.plans.pipeline import Pipeline, Step, run_pipeline
from framelake.sources import files, vtk, writers
from framelake.sources import files as sources_files
from framelake.streaming.frames import read_frames, stream_pipeline

SCHEMA = "dataset_id string, frame_no long, y int, x int, channel int, value double"


def frames(spark, a) -> Frames:
    a = np.asarray(a, float)
    a = a if a.ndim == 3 else a[None]
    rows = [("d", int(f), int(y), int(x), 0, float(v)) for (f, y, x), v in np.ndenumerate(a)]
    return Frames(spark.createDataFrame(rows, SCHEMA), a.shape[1], a.shape[2])


def array(f: Frames) -> np.ndarray:
    got = f.df.select("frame_no", "y", "x", "value").collect()
    out = np.full((max(r[0] for r in got) + 1, f.height, f.width), np.nan)
    for r in got:
        out[r[0], r[1], r[2]] = r[3]
    return out


def apply(spark, f, values):
    df = pointwise(frames(spark, [list(values)]).df, f)
    return [r[0] for r in df.orderBy("x").select("value").collect()]


def test_axes():
    assert frame_axes(("time", "z", "y", "x")) == ("time", "z")
    for bad in (("y",), ("y", "x", "time"), ("y", "y", "x"), ("Y", "x"), ("channel", "y", "x", "z")):
        with pytest.raises(FrameError):
            check_axes(bad)


def test_nan_and_ends(spark):
    nan = float("nan")
    got = apply(spark, fn.clip(0, 1), [-1, 0.5, 2, nan, math.inf])
    assert got[:3] == [0, 0.5, 1] and math.isnan(got[3]) and got[4] == 1
    assert apply(spark, fn.threshold(1, "above"), [0, 1, nan]) == [0, 1, 0]
    assert apply(spark, fn.threshold(1, "below"), [0, 1, nan]) == [1, 0, 0]
    assert apply(spark, fn.to_uint8(0, 100), [-10, 0, 50, 100, 200, nan]) == [0, 0, 128, 255, 255, 0]
    assert apply(spark, fn.to_uint8(5, 5), [1, 5, 9]) == [0, 0, 0]
    with pytest.raises(FrameError):
        fn.clip(2, 1)


def test_tone(spark):
    assert apply(spark, fn.tone(100, 1000, curve=[[0, 0], [0.5, 0.25], [1, 1]]), [100, 550, 1000, 2000]) == pytest.approx([100, 325, 1000, 1000])
    x = np.linspace(0, 1, 101)
    assert apply(spark, fn.tone_map(), x) == pytest.approx(x)
    assert apply(spark, fn.tone_map(exposure=1), x) == pytest.approx(np.minimum(2 * x, 1))
    assert apply(spark, fn.tone_map(curve=[[0, 1], [1, 0]]), x) == pytest.approx(1 - x)
    for name in ("contrast", "highlights", "shadows", "whites", "blacks"):
        for value in (-100, 100):
            y = apply(spark, fn.tone_map(**{name: value}), x)
            assert min(np.diff(y)) >= -1e-9 and min(y) >= 0 and max(y) <= 1
    y = apply(spark, fn.tone_map(curve=[[0.2, 0.1], [0.5, 0.6], [1, 1]]), [0, 0.1, 0.2, 0.5])
    assert y == pytest.approx([0.1, 0.1, 0.1, 0.6])
    for bad in ("linear", [[0, 0]], [[0.5, 0], [0.2, 1]]):
        with pytest.raises(FrameError):
            fn.check_curve(bad)


def test_geometry_and_tiles(spark):
    a = np.arange(2 * 5 * 7).reshape(2, 5, 7)
    f = frames(spark, a)
    for k, angle in ((-1, "90"), (2, "180"), (1, "270")):
        assert (array(geometry.rotate(f, angle)) == np.rot90(a, k, (1, 2))).all()
    assert (array(geometry.flip(f, "vertical")) == a[:, ::-1]).all()
    assert (array(geometry.crop(f, 1, 2, 0, 3)) == a[:, 1:, 2:5]).all()
    tiles = to_tiles(f.df, 3)
    assert (array(f.with_(to_pixels(tiles))) == a).all()
    cropped = geometry.crop_tiles(tiles, 1, 2, 3, 4)
    assert (array(Frames(to_pixels(cropped), 3, 4)) == a[:, 1:4, 2:6]).all()
    with pytest.raises(FrameError):
        geometry.crop(f, 4, 0, 2, 0)


def test_selection(spark):
    a = np.arange(5 * 4).reshape(5, 2, 2)
    f = frames(spark, a)
    for s in ((None, None, 2), (None, None, -2), (1, 4, None), (-2, None, None)):
        assert (array(f.with_(geometry.slice_frames(f.df, 5, *s))) == a[slice(*s)]).all()
    assert (array(f.with_(geometry.list_frames(f.df, 5, [3, -1, 3]))) == a[[3, -1, 3]]).all()
    mask = [True, False, True, False, False]
    assert (array(f.with_(geometry.list_frames(f.df, 5, mask))) == a[mask]).all()
    assert (array(f.with_(geometry.one_frame(f.df, 5, -2))) == a[[-2]]).all()
    with pytest.raises(FrameError):
        geometry.list_frames(f.df, 5, [5])


def test_references_and_flat_field(spark):
    darks = np.stack([np.full((4, 5), v) for v in (9.0, 10, 1011)])
    d = frames(spark, darks)
    assert aggregates.average_frames(d.df, "median").agg(F.max("value")).first()[0] == 10
    dark = frames(spark, np.full((4, 5), 10.0)).df
    flat = np.full((4, 5), 110.0)
    flat[0, 0] = 10
    f = frames(spark, np.full((4, 5), 60.0))
    got = array(f.with_(joins.flat_field(f.df, 20, dark, frames(spark, flat).df)))[0]
    assert got[0, 0] == 0 and (got.ravel()[1:] == 0.5).all()
    assert (array(f.with_(joins.flat_field(f.df, 20, dark)))[0] == 50).all()
    with pytest.raises(FrameError):
        joins.flat_field(f.df, 20)
    with pytest.raises(FrameError):
        joins.check_reference(f.df, frames(spark, np.zeros((4, 6))).df)


def test_statistics(spark):
    a = np.linspace(0, 1000, 64 * 64).reshape(64, 64)
    b = a.copy()
    b[0, 0], b[1, 1] = np.nan, np.inf
    s = aggregates.frame_stats(frames(spark, b).df).first()
    finite = b[np.isfinite(b)]
    sample = b[::4, ::4][np.isfinite(b[::4, ::4])]
    assert (s["min"], s["max"]) == (finite.min(), finite.max())
    assert (s["low"], s["high"]) == pytest.approx(tuple(np.percentile(sample, [0.1, 99.9])))
    h = [r[0] for r in aggregates.histogram(frames(spark, a).df, 10).orderBy("bin").select("n").collect()]
    assert h == np.histogram(a, 10)[0].tolist()
    level = aggregates.pyramid_level(frames(spark, np.arange(35).reshape(5, 7)).df)
    got = array(Frames(level, 3, 4))[0]
    assert got[0, 0] == np.mean([0, 1, 7, 8]) and got[2, 3] == 34
    assert aggregates.pyramid_levels(600, 700, 512) == 2
    nothing = frames(spark, np.full((2, 2), np.nan))
    assert tuple(aggregates.value_range(nothing.df).first()) == (0.0, 1.0)
    assert (array(nothing.with_(aggregates.normalise(frames(spark, np.ones((2, 2))).df))) == 0).all()


def test_median_and_gaussian_have_no_seams(spark):
    a = np.random.default_rng(0).normal(size=(2, 23, 31))
    f = frames(spark, a)
    for size in (3, 4, 9):
        r, b = size // 2, np.pad(a, ((0, 0), (size // 2, size), (size // 2, size)), "symmetric")
        v = np.lib.stride_tricks.sliding_window_view(b, (size, size), (1, 2))[:, :23, :31].reshape(2, 23, 31, -1)
        assert (array(neighbourhood.median_filter(f, size, tile=8)) == np.sort(v, axis=3)[..., size * size // 2]).all(), r
    w = np.array(neighbourhood.gaussian_weights(2.0))
    p = np.pad(a, ((0, 0), (8, 8), (8, 8)), "symmetric")
    want = sum(w[i] * w[j] * p[:, i : i + 23, j : j + 31] for i in range(17) for j in range(17))
    assert np.allclose(array(neighbourhood.gaussian_filter(f, 2.0, tile=8)), want)


def test_rolling_ball(spark):
    y, x = np.mgrid[:60, :80]
    ground = 1000 + 0.05 * x + 0.02 * y
    spot = np.zeros_like(ground)
    spot[28:34, 38:44] = 500
    for radius in (8, 20):
        got = array(neighbourhood.rolling_ball(frames(spark, ground + spot), radius, tile=32))[0]
        inner = got[15:45, 15:65][spot[15:45, 15:65] == 0]
        assert abs(inner).max() < 10 and got[31, 41] == pytest.approx(500, abs=10)
    light = array(neighbourhood.rolling_ball(frames(spark, ground - spot), 20, True, tile=32))[0]
    assert light[31, 41] == pytest.approx(-500, abs=10)


def test_conversion(spark):
    a = np.linspace(-1, 3, 84).reshape(2, 6, 7)
    f = frames(spark, a)
    s = convert.convert_scaled(f.df, "uint8")
    back = array(f.with_(convert.recover_values(s).select(*PIXELS)))
    assert abs(back - a).max() <= 4 / 255 / 2 + 1e-12
    assert not s.where("clipped").count() and convert.convert_scaled(f.df, "uint8", 0, 1).where("clipped").count()
    odd = convert.convert_scaled(frames(spark, [[np.nan, np.inf, -np.inf, 5]]).df, "uint16", 0, 10).orderBy("x").select("value").collect()
    assert [r[0] for r in odd] == [0, 65535, 0, 32768]
    with pytest.raises(FrameError):
        convert.convert_exact(f.df, "float32", "uint16")
    assert fn.holds("uint16", "float32") and not fn.holds("uint32", "float32") and not fn.holds("int8", "uint16")


def test_vtk(spark, tmp_path):
    v = (np.arange(60) / 7).reshape(3, 4, 5).astype(np.float32)
    for i in (1, 2, 10):
        (tmp_path / f"v_{i}.vtk").write_bytes(vtk.write_volume(v + i, f"t = {i / 2} s", "frac", (1, 2, 3), (0, 0, 10)))
    vtk.register(spark)
    df = spark.read.format("vtk").option("paths", ",".join(str(tmp_path / f"v_{i}.vtk") for i in (1, 2, 10))).option("partition_bytes", "80").load()
    got = {(r.dataset_id[-8:], r.frame_no): r.pixels for r in df.collect()}
    assert len(got) == 9 and df.rdd.getNumPartitions() == 9
    some = df.where("frame_no > 0 and frame_no <= 1 and h = 4")
    assert some.rdd.getNumPartitions() == 3 and {(r.frame_no, r.w) for r in some.collect()} == {(1, 5)}
    assert sorted(r.frame_no for r in df.where(F.col("frame_no").isin(0, 2, 7)).collect()) == [
        0, 0, 0, 2, 2, 2,
    ] and df.where("frame_no = 9").count() == 0
    assert np.allclose(got["v_10.vtk", 2], (v + 10)[2].ravel())
    contents = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    ranked = vtk.series_rank(vtk.catalog_of(contents)).orderBy("rank").collect()
    assert [r.time_s for r in ranked] == [0.5, 1.0, 5.0] and ranked[0].spacing == [3.0, 2.0, 1.0] and ranked[0].origin == [10.0, 0.0, 0.0]
    good = vtk.write_volume(v, "t", "frac")
    for bad in (
        b"x" + good, good[:-30], good + b"123", good.replace(b"BINARY", b"ASCII"), good.replace(b"float 1", b"float 3"),
        good.replace(b"STRUCTURED_POINTS", b"RECTILINEAR_GRID"), good.replace(b"float 1", b"vec 1"),
    ):
        with pytest.raises(FrameError):
            vtk.parse_header(bad[:4096], len(bad), "a.vtk")


def test_files(spark, tmp_path):
    for name in ("s_10.tif", "s_2.tif", "s_1.tif", "b.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = files.scan_folder(spark, str(tmp_path), "*.tif")
    assert [r.name for r in aggregates.sequence_files(got, "s_*.tif").orderBy("frame_no").collect()] == ["s_1.tif", "s_2.tif", "s_10.tif"]
    with pytest.raises(FrameError):
        files.require_files(files.find_files(spark.createDataFrame([("d", "a.tif")], "folder string, name string"), "d", "*.png"), "*.png")
    shapes = spark.createDataFrame([(0, "a", [2, 3]), (1, "b", [2, 3]), (2, "c", [4, 3])], "frame_no int, name string, shape array<int>")
    assert [r.name for r in files.check_same_shape(shapes).collect()] == ["c"]
    names = spark.createDataFrame([("A2",), ("a10",), ("a1",), ("2",), ("_x",)], "n string")
    assert [r.n for r in names.orderBy(scalars.natural_key(F.col("n"))).collect()] == ["2", "_x", "a1", "A2", "a10"]


def test_pipeline(spark, tmp_path):
    p = Pipeline([Step("invert", {"high": 100}), Step("median", {}, False), Step("clip", {"low": 5})])
    assert Pipeline.from_yaml(p.to_yaml()) == p
    for bad, message in (
        ([Step("median", {"size": 99})], r"Step 1 \(median\)"), ([Step("blur")], "unknown operation"),
        ([Step("clip", {"lo": 1})], "unknown parameters"), ([Step("crop", {"top": 1.5})], "whole number"),
        ([Step("invert", {"high": float("nan")})], "not a number"), ([Step("tone", {"black": 5, "white": 5})], "white point"),
        ([Step("flat_field")], "reference"),
    ):
        with pytest.raises(FrameError, match=message):
            Pipeline(bad)
    with pytest.raises(FrameError):
        Pipeline.from_yaml("version: 2\nsteps: []")
    f = frames(spark, np.arange(24).reshape(3, 2, 4))
    loaded = []
    q = Pipeline([Step("flat_field", {"dark": "d"}), Step("flat_field", {"dark": "d"})])
    resolved = q.resolve(lambda name: loaded.append(name) or frames(spark, np.ones((2, 4))).df)
    assert loaded == ["d"] and (array(resolved(f)) == np.arange(24).reshape(3, 2, 4) - 2).all()
    with pytest.raises(FrameError, match="not resolved"):
        q(f)
    with pytest.raises(FrameError):
        resolved.to_yaml()
    path = str(tmp_path / "run")
    stored = run_pipeline(f, p, path, "r", "s", 3)
    assert stored.count() == 24 and spark.read.parquet(path + "/run").first()["pipeline"] == p.to_yaml()
    with pytest.raises(Exception, match="already exists"):
        run_pipeline(f, p, path, "r", "s", 3)
    with pytest.raises(FrameError):
        writers.check_frames(f.with_(f.df.where("x < 3 or frame_no > 0")))


def test_stream_equals_batch(spark, tmp_path):
    f = frames(spark, np.arange(48).reshape(3, 4, 4))
    tiles = to_tiles(f.df, 2)
    tiles.write.parquet(str(tmp_path / "in"))
    p = Pipeline([Step("invert", {"high": 100}), Step("clip", {"low": 60})])
    s = stream_pipeline(Frames(read_frames(spark, str(tmp_path / "in"), tiles.schema), 4, 4), p)
    q = s.df.writeStream.format("memory").queryName("tiles_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert (array(f.with_(to_pixels(spark.table("tiles_out")))) == array(p(f))).all()
    with pytest.raises(FrameError, match="median"):
        stream_pipeline(s, Pipeline([Step("median")]))


NAN = float("nan")


def test_normalise_with_nan_and_outer_percentiles(spark):
    rng = np.random.default_rng(3)
    stack = rng.uniform(-5, 5, (3, 6, 7))
    stack[0, 2, 3] = NAN
    stack[1] = 4.0
    stack[1, 0, 0] = NAN
    f = frames(spark, stack)
    got = array(f.with_(aggregates.normalise(f.df, 10, 90)))
    for i in (0, 2):
        low, high = np.nanpercentile(stack[i], [10, 90])
        assert np.allclose(got[i], (stack[i] - low) / (high - low), equal_nan=True) and np.nanmin(got[i]) < 0 and np.nanmax(got[i]) > 1
    assert (got[1] == 0).all()


def test_flat_field_with_nan_and_shape(spark):
    sample, dark, flat = np.full((2, 3), 60.0), np.full((2, 3), 10.0), np.array([[110.0, 10, NAN], [5, 110, 110]])
    sample[1, 1], dark[1, 2] = NAN, NAN
    ref = lambda a: frames(spark, a).df
    got = array(frames(spark, sample).with_(joins.flat_field(ref(sample), 6, ref(dark), ref(flat))))[0]
    with np.errstate(invalid="ignore"):
        want = np.divide(sample - dark, flat - dark, out=np.zeros((2, 3)), where=flat - dark > 0)
    assert np.array_equal(got, want, equal_nan=True)
    step = Pipeline([Step("flat_field", {"flat": ref(np.ones((3, 3)))})])
    with pytest.raises(FrameError, match="differs in shape"):
        step(frames(spark, sample))
    assert Pipeline([Step("flat_field", {"flat": ref(flat)})])(frames(spark, sample)).df.count() == 6


def test_rolling_ball_with_nan(spark):
    a = np.full((6, 6), 10.0)
    a[2, 3], a[4, 4] = NAN, 7.0
    got = array(neighbourhood.rolling_ball(frames(spark, a), 1.0, light_background=True))[0]
    assert np.isfinite(got).sum() > 20 and np.isnan(got[2, 3])


def test_colour_maps(spark):
    table = color_tables(spark)
    f = frames(spark, [[0, 255, 300], [-4, NAN, 128]])
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in joins.apply_colormap(f.df, table, "grey", 1).collect()}
    assert got == {(0, 0): (0,) * 3, (0, 1): (255,) * 3, (0, 2): (255,) * 3, (1, 0): (0,) * 3, (1, 1): (0,) * 3, (1, 2): (128,) * 3}
    with pytest.raises(FrameError, match="unknown colour map"):
        joins.apply_colormap(f.df, table, "none", 1)
    rgb = spark.createDataFrame([("d", 0, 0, 0, c, float(10 * c)) for c in range(3)], SCHEMA)
    assert [tuple(r)[-3:] for r in joins.apply_colormap(rgb, table, "fire", channels=3).collect()] == [(0, 10, 20)]


def test_colour_frames_and_tables_of_ones_own(spark, tmp_path):
    rgb = spark.createDataFrame([("d", 0, 0, 0, c, float(10 * c)) for c in range(3)], SCHEMA)
    with pytest.raises(Exception, match="one channel"):
        joins.apply_colormap(rgb, color_tables(spark), "grey", 1).collect()
    with pytest.raises(FrameError, match="no colours"):
        joins.apply_colormap(rgb, color_tables(spark), "grey", 2)
    path = tmp_path / "maps.csv"
    rows = [f"blue,{i},0,0,{i}" for i in range(256)]
    path.write_text("\n".join(["cmap,index,r,g,b", *rows]))
    table = read_color_tables(spark, str(path))
    got = joins.apply_colormap(frames(spark, [[7.0, 250.0]]).df, table, "blue", 1).orderBy("x").collect()
    assert [(r.r, r.g, r.b) for r in got] == [(0, 0, 7), (0, 0, 250)] and {r.cmap for r in table.select("cmap").distinct().collect()} == {
        "blue", "grey", "grey_inverted", "fire",
    }
    for bad in (rows[:-1], [*rows[:-1], rows[0]], [*rows[:-1], "blue,255,0,0,300"]):
        path.write_text("\n".join(["cmap,index,r,g,b", *bad]))
        with pytest.raises(FrameError, match="'blue'"):
            read_color_tables(spark, str(path))
    with pytest.raises(FrameError, match="no 256 rows"):
        joins.apply_colormap(rgb, color_tables(spark).where("index < 9"), "grey", 1)


def test_checksums_of_copies(spark):
    files = "path string, length long, md5 string, digest string"
    a = spark.createDataFrame([("a", 1, "x", "s"), ("b", 1, None, "s"), ("c", 1, "x", None), ("d", 2, "x", "s"), ("e", 1, "x", "s")], files)
    b = spark.createDataFrame([("a", 1, "y", "s"), ("b", 1, "y", "t"), ("c", 1, "x", "t"), ("d", 3, "x", "s"), ("f", 1, None, None)], files)
    assert {r.path: r.problem for r in joins.verify_copies(a, b).collect()} == {"a": "md5", "b": "digest", "d": "size", "e": "missing", "f": "extra"}
    assert {r.path: r.problem for r in joins.verify_copies(a.drop("md5", "digest"), b).collect()} == {"d": "size", "e": "missing", "f": "extra"}
    content = spark.createDataFrame([("a", 1, bytearray(b"x"))], "path string, length long, content binary")
    assert joins.digests(content, False).columns == [
        "path", "length", "md5",
    ] and joins.digests(content).first().md5 == "9dd4e461268c8034f5c8564e155c67a6"
    at = F.lit("2020-01-01 00:00:00").cast("timestamp")
    diff = joins.manifest_diff(a.drop("digest").withColumn("modified", at), b.where("path = 'a'").select("path", "length", at.alias("modified")))
    assert tuple(joins.copy_summary(diff).first()) == (4, 1, 0, 5, 3) and joins.copy_summary(diff, True).first().checksummed == 4


def test_sequences_are_checked(spark):
    rows = [("s_2.tif", [4, 5]), ("s_1.tif", [4, 5]), ("s_10.tif", [4, 6]), ("t_1.tif", [9, 9])]
    df = spark.createDataFrame(rows, "name string, shape array<int>")
    with pytest.raises(FrameError, match=r"s_10.tif has shape \(4, 6\)"):
        aggregates.sequence_files(df, "s_*.tif")
    assert aggregates.sequence_files(df, "s_?.tif").count() == 2
    with pytest.raises(FrameError, match="no file matches"):
        aggregates.sequence_files(df, "u_*.tif")


@pytest.mark.parametrize("tiles", [False, True])
def test_references_of_files(spark, tiles):
    rows = [
        (f"r/{d}/{k}.tif", f, y, x, 0, float(10 * k + f)) for d, k,
        n in (("dark", 2, 1), ("dark", 10, 2), ("flat", 7, 1)) for f in range(n) for y in range(3) for x in range(4)
    ]
    px = spark.createDataFrame(rows, SCHEMA)
    stack = Frames(to_tiles(px, 2), 3, 4, tile=2) if tiles else Frames(px, 3, 4)
    files = spark.createDataFrame(
        [(p, p.rsplit("/", 1)[0], p.rsplit("/", 1)[1]) for p in {r[0] for r in rows}], "path string, folder string, name string",
    )
    refs = spark.createDataFrame([("dark", "r/dark"), ("flat", "r/flat/7.tif"), ("none", "r/other")], "reference string, entry string")
    named = sources_files.reference_files(refs, files)
    value = "pixels" if tiles else "value"
    for name, want in (("dark", (20 + 100 + 101) / 3), ("flat", 70.0)):
        got = aggregates.load_reference(named, stack, name).select(F.explode(value) if tiles else value).collect()
        assert len(got) == 12 and all(r[0] == pytest.approx(want) for r in got)
    with pytest.raises(FrameError, match="names no file"):
        aggregates.load_reference(named, stack, "none")
    with pytest.raises(FrameError, match="r/flat/7.tif"):
        aggregates.load_reference(named, stack.with_(stack.df.where("dataset_id <> 'r/flat/7.tif'")), "flat")
    odd = spark.createDataFrame([("r/dark/2.tif", 5, y, x, 0, 1.0) for y in range(3) for x in range(5)], SCHEMA)
    with pytest.raises(FrameError, match="3 x 4"):
        aggregates.load_reference(named, stack.with_(stack.df.unionByName(to_tiles(odd, 2) if tiles else odd)), "dark")


def test_a_cluster_has_to_name_its_folder():
    class Session:
        def __init__(self, master, named=None):
            self.conf, self.sparkContext, self.master, self.named = self, self, master, named

        def get(self, key, default):
            return self.named

        def set(self, key, value):
            self.named = value

    assert ordering.shared_folder(Session("spark://host", "s3a://shared")) == "s3a://shared"
    single = Session("local[4]")
    assert ordering.shared_folder(single) == ordering.shared_folder(single)
    for master in ("spark://host", "yarn", "local-cluster[3,2,100]"):
        with pytest.raises(FrameError, match="spark.checkpoint.dir"):
            ordering.shared_folder(Session(master))


def test_names_of_images(spark):
    names = ["a_1.TIF", "a_2.TIF", "n1.txt", "n2.txt", "s[1]_1.tif", "s[1]_2.tif", "one.png", "x_0010000_a_b_7.TIF"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.pattern: (r.n, r.first) for r in aggregates.find_sequences(df).collect()}
    assert got == {"a_*.TIF": (2, "a_1.TIF"), "s[[]1]_*.tif": (2, "s[1]_1.tif")}
    assert [r.name for r in aggregates.sequence_files(df, "s[[]1]_*.tif").orderBy("frame_no").collect()] == ["s[1]_1.tif", "s[1]_2.tif"]
    step = df.select(scalars.parse_timestep(df.name).alias("s")).where("s is not null").collect()
    assert [r.s for r in step] == [0]
    long = ["f" + "9" * 45 + ".tif", "f1" + "0" * 45 + ".tif", "f007.tif", "f0.tif"]
    key = spark.createDataFrame([(n,) for n in long], "name string").orderBy(scalars.natural_key(F.col("name")))
    assert [r.name for r in key.collect()] == ["f0.tif", "f007.tif", long[0], long[1]]


def test_tone_plan_is_small(spark):
    curve = [[0, 0], [0.25, 0.2], [0.5, 0.6], [0.75, 0.7], [1, 1]]
    sliders = {"exposure": 1, "contrast": 20, "highlights": 10, "shadows": 20, "whites": 5, "blacks": 5, "curve": curve}
    f = frames(spark, np.linspace(0, 1, 12).reshape(3, 4))
    t = fn.tone(0.1, 0.9, **sliders)
    df = pointwise(f.df, t)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    tiles = pointwise(to_tiles(f.df, 4), t)
    assert np.allclose(array(f.with_(df)), array(f.with_(to_pixels(tiles))))
    with pytest.raises(FrameError):
        fn.tone_map(exposure=6)


def test_saved_pipelines_with_faults():
    p = Pipeline.from_yaml("version: 1\nsteps:\n- op: median\n  params: {size: 5}\n- {op: invert, enabled: false}\n")
    assert [(s.operation, s.enabled) for s in p.steps] == [("median", True), ("invert", False)] and Pipeline.from_yaml(p.to_yaml()) == p
    for text in (
        "a: [", "version: 2", "version: 1\nsteps: 3", "version: 1\nsteps: [3]", "version: 1\nsteps: [{params: {}}]",
        "version: 1\nsteps: [{op: clip, params: [1]}]", "version: 1\nsteps: [{op: clip, enabled: 2}]",
        "version: 1\nsteps: [{op: clip, what: 2}]", "version: 1\nsteps: [{op: nothing}]",
    ):
        with pytest.raises(FrameError):
            Pipeline.from_yaml(text)


def test_pyramid_levels():
    for size in (1, 511, 512, 513, 1024, 1025, 5120, 70_000):
        levels = 1
        while size > 512 << (levels - 1):
            levels += 1
        assert aggregates.pyramid_levels(size, 3) == levels


def tiled(f: Frames, size: int) -> Frames:
    return Frames(to_tiles(f.df, size), f.height, f.width, tile=size)


def test_tiles_of_arrays(spark):
    a = np.arange(2 * 23 * 31, dtype=float).reshape(2, 23, 31)
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(a)], "k long, v array<double>")
    for size in (8, 23, 64):
        f = tiles_from_array_column(df, "k", "v", 23, 31, F.lit("d"), size)
        assert (array(f.with_(to_pixels(f.df))) == a).all()
        assert f.df.select(F.sum(F.size("pixels") - F.col("h") * F.col("w"))).first()[0] == 0
    empty = tiles_from_array_column(df.limit(0), "k", "v", 23, 31, F.lit("d"), 8)
    assert neighbourhood.median_filter(empty).df.count() == 0


def test_filters_on_tile_tables(spark):
    a = np.random.default_rng(1).normal(size=(2, 23, 31)) * 100
    a[1, 3, 4] = NAN
    f = frames(spark, a)
    for make in (
        lambda g: neighbourhood.median_filter(g, 1, 8),
        lambda g: neighbourhood.median_filter(g, 4, 8),
        lambda g: neighbourhood.median_filter(g, 27, 8),
        lambda g: neighbourhood.gaussian_filter(g, 2.0, 8),
        lambda g: neighbourhood.gaussian_filter(g, 9.0, 8),
        lambda g: neighbourhood.rolling_ball(g, 3.0, False, 8),
        lambda g: neighbourhood.rolling_ball(g, 12.0, False, 8),
        lambda g: neighbourhood.rolling_ball(g, 12.0, True, 8),
        lambda g: neighbourhood.rolling_ball(g, 40.0, False, 8),
    ):
        want, got = array(make(f)), make(tiled(f, 8))
        assert np.allclose(array(got.with_(to_pixels(got.df))), want, equal_nan=True, atol=1e-9)
        assert got.df.select(F.min(F.col("y0") == F.col("ty") * 8)).first()[0]
    with pytest.raises(FrameError, match="tile size"):
        neighbourhood.median_filter(f.with_(to_tiles(f.df, 8)))
    with pytest.raises(FrameError, match="whole blocks"):
        neighbourhood.rolling_ball(tiled(f, 9), 20.0)


def test_pipeline_steps_on_tile_tables(spark):
    a = np.random.default_rng(2).normal(size=(1, 9, 14))
    f = frames(spark, a)
    p = Pipeline([Step("invert", {"high": 1}), Step("median"), Step("gaussian"), Step("clip", {"low": -1})])
    got = p(tiled(f, 4))
    assert np.allclose(array(got.with_(to_pixels(got.df))), array(p(f)))
