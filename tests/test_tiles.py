"""Operators on tile tables against the same on pixel tables and against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import Frames, pointwise, tiles_from_array_column, to_pixels, to_tiles
from framelake.functions import pointwise as fn
from framelake.operators import aggregates, geometry, joins, medians, neighbourhood, tile_stats, tiling
from framelake.plans.pipeline import Pipeline, Step
from framelake.streaming.frames import read_frames, stream_pipeline

NAN = float("nan")


def tiles(spark, a, size) -> Frames:
    a = np.asarray(a, float)
    a = a if a.ndim == 3 else a[None]
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(a)], "k long, v array<double>")
    return tiles_from_array_column(df, "k", "v", *a.shape[1:], F.lit("d"), size)


def array(f: Frames) -> np.ndarray:
    """The frames, after a check that their tiles are those of the grid."""
    tile_stats.check_grid(f.df, f, ["dataset_id", "frame_no"])
    rows = f.df.collect()
    out = np.full((max(r.frame_no for r in rows) + 1, f.height, f.width), np.nan)
    for r in rows:
        out[r.frame_no, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r.pixels, float).reshape(r.h, r.w)
    return out


def one(df, height, width) -> np.ndarray:
    out = np.full((height, width), np.nan)
    for r in df.collect():
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r.pixels, float).reshape(r.h, r.w)
    return out


@pytest.mark.parametrize("size", [4, 5, 16])
def test_moves(spark, size):
    a = np.arange(2 * 9 * 13, dtype=float).reshape(2, 9, 13)
    f = tiles(spark, a, size)
    for k, angle in ((-1, "90"), (2, "180"), (1, "270")):
        assert (array(geometry.rotate(f, angle)) == np.rot90(a, k, (1, 2))).all()
    assert (array(geometry.flip(f, "vertical")) == a[:, ::-1]).all() and (array(geometry.flip(f)) == a[:, :, ::-1]).all()
    for top, left, h, w in ((1, 2, 0, 3), (4, 4, 3, 6), (0, 0, 5, 7), (8, 12, 1, 1)):
        assert (array(geometry.crop(f, top, left, h, w)) == a[:, top : top + h if h else None, left : left + w]).all()
    assert (array(tiling.retile(f, tiling.stay(f), 7)) == a).all()


def test_placements_compose():
    rng = np.random.default_rng(0)
    a = np.arange(7 * 10).reshape(7, 10)
    for _ in range(60):
        f, want, done = Frames(None, 7, 10), a, tiling.Placement(7, 10)
        for _ in range(4):
            k = rng.integers(3)
            if k == 0:
                angle = str(rng.choice([90, 180, 270]))
                step, want = geometry.rotate_place(f, angle), np.rot90(want, -int(angle) // 90)
            elif k == 1:
                step, want = geometry.flip_place(f, "vertical"), want[::-1]
            else:
                top, left = int(rng.integers(f.height)), int(rng.integers(f.width))
                h, w = int(rng.integers(1, f.height - top + 1)), int(rng.integers(1, f.width - left + 1))
                step, want = geometry.crop_place(f, top, left, h, w), want[top : top + h, left : left + w]
            done = done.then(step)
            f = Frames(None, step.height, step.width)
        y, x, moved = done.move(("d", 0, 0, 0, 0, 0, 0, a))
        assert (moved[-y : -y + done.height, -x : -x + done.width] == want).all() and want.shape == (done.height, done.width)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_moves_that_keep_the_grid_shuffle_nothing(spark):
    f = tiles(spark, np.zeros((1, 16, 16)), 4)
    f = f.with_(spark.createDataFrame(f.df.collect(), f.df.schema))
    assert exchanges(geometry.rotate(f, "90").df) == 0 and exchanges(geometry.crop(f, 4, 8, 7, 0).df) == 0
    assert exchanges(geometry.crop(f, 1).df) == 1
    moves = [Step("crop", {"top": 1}), Step("rotate"), Step("crop", {"left": 3}), Step("flip")]
    assert exchanges(Pipeline(moves)(f).df) == 1
    assert exchanges(Pipeline([*moves, Step("median"), Step("crop", {"top": 2})])(f).df) == 1


def test_pipelines_on_tiles_equal_those_on_pixels(spark):
    a = np.random.default_rng(2).normal(size=(2, 19, 23))
    a[1, 3, 4] = NAN
    f = tiles(spark, a, 6)
    px = Frames(to_pixels(f.df), 19, 23)
    ref = spark.createDataFrame([(y, x, 0, float(y * x % 7) / 3) for y in range(19) for x in range(23)], "y int, x int, channel int, value double")
    crop = Step("crop", {"top": 3, "left": 2, "height": 13})
    for steps in (
        [Step("median"), crop],
        [crop, Step("median", {"size": 4}), Step("crop", {"top": 1, "width": 9}), Step("invert")],
        [Step("rotate"), crop, Step("gaussian"), Step("flip"), Step("rotate", {"angle": "180"})],
        [Step("flip"), Step("gaussian", {"sigma": 0.5}), Step("flip"), Step("flip"), Step("crop", {"top": 2}), Step("rotate")],
        [Step("flat_field", {"dark": ref, "flat": ref}), Step("clip", {"low": 0})],
        [Step("flat_field", {"dark": ref}), crop, Step("normalise", {"low_percentile": 5, "high_percentile": 80}), Step("threshold", {"value": 0.5})],
        [
            Step("invert", {"high": 1}),
            Step("tone", {"black": -1, "white": 2, "contrast": 30, "curve": [[0, 0.1], [0.4, 0.3], [1, 0.9]]}), Step("rotate"),
            Step("rolling_ball", {"radius": 2}), crop,
        ],
        [Step("median", {}, False)],
    ):
        p = Pipeline(steps)
        got, want = p(f), p(px)
        pixels = np.full((2, want.height, want.width), NAN)
        for r in want.df.collect():
            pixels[r.frame_no, r.y, r.x] = r.value
        assert (got.height, got.width) == (want.height, want.width)
        assert np.allclose(array(got), pixels, equal_nan=True, atol=1e-12), steps
    for bad in ([Step("median"), Step("crop", {"top": 90})], [Step("crop", {"top": 90})], [Step("flat_field", {"dark": ref.where("y > 0")})]):
        with pytest.raises(FrameError, match=rf"Step {len(bad)} \((crop|flat_field)\)"):
            Pipeline(bad)(f)


def test_kernels_equal_columns(spark):
    values = [*np.linspace(-0.5, 1.5, 37), NAN, float("inf"), -float("inf"), 0.0, -0.0]
    f = tiles(spark, [values], 16)
    curve = [[0.1, 0.3], [0.25, 0.2], [0.5, 0.6], [0.75, 0.7], [0.9, 1.0]]
    sliders = {"exposure": 0.5, "contrast": 25, "highlights": -40, "shadows": 20, "whites": 30, "blacks": -10}
    for g in (
        fn.invert(0, 1), fn.clip(), fn.clip(low=0.2), fn.clip(0.1, 0.4), fn.threshold(0.5), fn.threshold(0.5, "below"), fn.tone_map(), fn.tone_map(
            **sliders, curve=curve,
        ),
        fn.tone(-0.2, 1.2, **sliders), fn.to_uint8(0.1, 0.9), fn.to_uint8(1, 1), fn.to_uint8(
            0, 1, fn.tone_map(contrast=50),
        ), fn.chain(fn.invert(0, 1), fn.clip(0, 1)),
    ):
        assert g.kernels
        got = array(f.with_(pointwise(f.df, g)))[0, 0]
        px = {r.x: r.value for r in pointwise(to_pixels(f.df), g).collect()}
        assert np.allclose(got, [px[x] for x in range(len(values))], equal_nan=True, rtol=0, atol=1e-12)
    bare = pointwise(f.df, lambda v: v * 2)
    assert np.allclose(array(f.with_(bare))[0, 0], np.array(values) * 2, equal_nan=True)
    kinds = pointwise(pointwise(f.df, fn.clip(0, 1)), fn.cast_dtype("float32")).schema["pixels"].dataType.simpleString()
    assert kinds == "array<float>"


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    stack = rng.normal(size=(6, 21, 17)) * 1e3
    stack[1] = rng.integers(0, 50, (21, 17))
    stack[2] = 7.0
    stack[3] = NAN
    stack[4, ::2] = NAN
    stack[4, 1, :3] = float("inf"), -float("inf"), -0.0
    stack[5] = np.where(rng.random((21, 17)) < 0.5, 1.0, np.nextafter(1.0, 2.0))
    at = (0.0, 0.001, 0.1, 0.5, 0.77, 1.0)
    got = {r.frame_no: r.q for r in tile_stats.quantiles(tiles(spark, stack, 8).df, at).collect()}
    assert set(got) == {0, 1, 2, 4, 5}
    for i, q in got.items():
        v = np.sort(stack[i][~np.isnan(stack[i])])
        for p, x in zip(at, q, strict=True):
            k = p * (len(v) - 1)
            low, high = v[int(k)], v[min(int(k) + 1, len(v) - 1)]
            assert x == (low if low == high or k == int(k) else low * (1 - (k - int(k))) + high * (k - int(k)))


@pytest.mark.parametrize("size", [5, 8])
def test_statistics_on_tiles(spark, size):
    rng = np.random.default_rng(5)
    stack = rng.normal(size=(4, 19, 26)) * 10
    stack[1, 2, 3], stack[1, 4, 4], stack[1, 5, 5] = NAN, float("inf"), -float("inf")
    stack[2] = NAN
    stack[3] = 4.0
    f = tiles(spark, stack, size)
    px = to_pixels(f.df)
    both = lambda g: [sorted(map(tuple, g(df).collect())) for df in (f.df, px)]
    for a, b in zip(*both(lambda df: aggregates.frame_stats(df)), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])
    for g in (lambda df: aggregates.histogram(df, 7), lambda df: aggregates.histogram(df, 4, -5, 5), lambda df: aggregates.histogram(df, 3, low=0)):
        got, want = both(g)
        assert got == want
    got, want = both(aggregates.value_range)
    assert got == want
    want = np.full(stack.shape, NAN)
    for r in aggregates.normalise(px, 10, 90).collect():
        want[r.frame_no, r.y, r.x] = r.value
    assert np.allclose(array(f.with_(aggregates.normalise(f.df, 10, 90))), want, equal_nan=True)


@pytest.mark.parametrize("values", [1 << 23, 12])
def test_averages_on_tiles(spark, values, monkeypatch):
    monkeypatch.setattr(tile_stats, "MEDIAN_VALUES", values)
    stack = np.random.default_rng(6).integers(0, 9, (5, 11, 14)).astype(float)
    stack[2, 3, 4] = NAN
    f = tiles(spark, stack, 4)
    for method, g in (("mean", np.mean), ("median", np.median)):
        got = aggregates.average_frames(f.df, method)
        tile_stats.check_grid(got, f)
        assert np.allclose(one(got, 11, 14), g(stack, axis=0), equal_nan=True)
    for df in (f.df.limit(0), to_pixels(f.df).limit(0)):
        with pytest.raises(FrameError, match="no frames"):
            aggregates.average_frames(df)


def test_flat_field_on_tiles(spark, monkeypatch):
    sample, dark, flat = np.full((2, 5, 7), 60.0), np.full((5, 7), 10.0), np.full((5, 7), 110.0)
    sample[1, 1, 1], dark[1, 2], flat[0, 0], flat[0, 1], flat[0, 2] = NAN, NAN, 10, NAN, 5
    f, ref = tiles(spark, sample, 3), lambda a: aggregates.average_frames(tiles(spark, a, 3).df)
    for limit in (1 << 30, 0):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        with np.errstate(invalid="ignore"):
            want = np.divide(sample - dark, flat - dark, out=np.zeros(sample.shape), where=np.broadcast_to(flat - dark > 0, sample.shape))
        assert np.array_equal(array(joins.flat_field_tiles(f, ref(dark), ref(flat))), want, equal_nan=True)
        assert np.array_equal(array(joins.flat_field_tiles(f, ref(dark), None, fn.invert(0, 1))), 1 - (sample - dark), equal_nan=True)
        assert np.allclose(array(joins.flat_field_tiles(f, None, ref(flat)))[1, 2:], 60 / 110)
    with pytest.raises(FrameError, match="needed"):
        joins.flat_field_tiles(f)
    for bad in (np.ones((5, 8)), np.ones((2, 7))):
        with pytest.raises(FrameError, match="5 x 7"):
            joins.flat_field_tiles(f, ref(bad))


@pytest.mark.parametrize("size", [4, 5])
def test_pyramid_on_tiles(spark, size):
    a = np.random.default_rng(7).normal(size=(2, 13, 22))
    f = tiles(spark, a, size)
    px = to_pixels(f.df)
    for _ in range(3):
        f, px = tile_stats.pyramid_level(f), aggregates.pyramid_level(px)
        want = np.full((2, f.height, f.width), NAN)
        for r in px.collect():
            want[r.frame_no, r.y, r.x] = r.value
        assert np.allclose(array(f), want)


def test_grids_with_faults(spark):
    f = tiles(spark, np.zeros((2, 6, 7)), 4)
    by = ["dataset_id", "frame_no"]
    tile_stats.check_grid(f.df, f, by)
    for bad in (
        f.df.where("ty > 0 or frame_no = 0"), f.df.unionByName(f.df.where("ty = 0 and tx = 0")),
        f.df.withColumn("x0", F.col("x0") + 1), f.df.withColumn("pixels", F.slice("pixels", 1, 3)),
    ):
        with pytest.raises(FrameError, match="6 x 7"):
            tile_stats.check_grid(bad, f, by)
    with pytest.raises(Exception, match="lacks pixels"):
        tiling.retile(f.with_(f.df.where("tx = 0")), tiling.stay(f), 3).df.collect()


def test_channels_stay_apart(spark):
    rows = [("d", 0, y, x, c, float(100 * c + 10 * y + x)) for c in range(3) for y in range(5) for x in range(6)]
    px = spark.createDataFrame(rows, "dataset_id string, frame_no long, y int, x int, channel int, value double")
    f = Frames(to_tiles(px, 4), 5, 6, 3, tile=4)
    got = geometry.crop(geometry.rotate(f), 1, 0, 4, 0)
    tile_stats.check_grid(got.df, got, ["dataset_id", "frame_no"])
    want = geometry.crop(geometry.rotate(Frames(px, 5, 6, 3)), 1, 0, 4, 0)
    assert sorted(map(tuple, to_pixels(got.df).collect())) == sorted(tuple(r[c] for c in (
        "dataset_id", "frame_no", "y", "x", "channel", "value",
    )) for r in want.df.collect())
    assert neighbourhood.median_filter(f).df.count() == 12


def test_medians_equal_sorting():
    rng = np.random.default_rng(8)
    for size, rows, cols in (
        (1, 3, 4), (2, 9, 5), (3, 20, 31), (4, 7, 6), (5, 16, 9), (6, 10, 11), (7, 40, 33), (12, 15, 9), (21, 30, 40),
        (51, 20, 64),
    ):
        for kind in ("real", "few", "nan", "inf"):
            block = rng.normal(size=(rows + size, cols + size))
            if kind == "few":
                block = np.round(block)
            elif kind == "nan":
                block[rng.random(block.shape) < 0.6] = NAN
            elif kind == "inf":
                block[rng.random(block.shape) < 0.4] = float("inf")
            v = np.lib.stride_tricks.sliding_window_view(block, (size, size))[:rows, :cols].reshape(rows, cols, -1)
            want = np.sort(v, axis=2)[:, :, size * size // 2]
            for g in (medians.median, medians.by_ranks, medians.by_partition):
                assert np.array_equal(g(block, rows, cols, size), want, equal_nan=True), (size, kind)
    assert len(medians.network(9, 4)) < 25


def test_streams_of_tiles(spark, tmp_path):
    a = np.random.default_rng(9).normal(size=(3, 8, 12))
    f = tiles(spark, a, 4)
    f.df.write.parquet(str(tmp_path / "in"))
    dark = aggregates.average_frames(f.df)
    steps = [Step("flat_field", {"dark": dark}), Step("crop", {"top": 4}), Step("flip"), Step("invert", {"high": 1})]
    got = stream_pipeline(f.with_(read_frames(spark, str(tmp_path / "in"), f.df.schema)), Pipeline(steps))
    q = got.df.writeStream.format("memory").queryName("moved_tiles").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert np.allclose(array(got.with_(spark.table("moved_tiles"))), 1 - (a - a.mean(axis=0))[:, 4:, ::-1])
    with pytest.raises(FrameError, match=r"Step 1 \(crop\).*grid stays"):
        stream_pipeline(f.with_(read_frames(spark, str(tmp_path / "in"), f.df.schema)), Pipeline([Step("crop", {"top": 1})]))
