"""Legacy VTK volumes: header rules, series, stacks and stores."""

import json

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from framelake import queries
from framelake.errors import FrameError
from framelake.sources import vtk

VOLUME = (np.arange(60, dtype=np.float32) / 7).reshape(3, 4, 5)


def content(
    volume=VOLUME, title="t = 0.45 s", kind="float", encoding="BINARY", after=b"\n", lines="ORIGIN 0 0 10\nSPACING 1 2 3\n\n",
    points=None,
) -> bytes:
    nz, ny, nx = volume.shape
    head = [
        "# vtk DataFile Version 3.0", title, encoding, "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}",
        f"{lines}POINT_DATA {points or volume.size}", f"SCALARS frac1 {kind}", "LOOKUP_TABLE default", "",
    ]
    return "\n".join(head).encode() + volume.astype(volume.dtype.newbyteorder(">")).tobytes() + after


def header(data: bytes) -> vtk.Volume:
    return vtk.parse_header(data[: vtk.HEADER_BYTES], len(data), "a.vtk")


def test_headers():
    v = header(content())
    assert (v.shape, v.dtype, v.field, v.spacing, v.origin, v.time) == ((3, 4, 5), "float32", "frac1", (3, 2, 1), (10, 0, 0), 0.45)
    v = header(content(lines=""))
    assert v.spacing == (1, 1, 1) and v.origin == (0, 0, 0)
    assert header(content(lines="aspect_ratio 4 5 6\n")).spacing == (6, 5, 4) and header(content(after=b"")).shape == (3, 4, 5)
    assert header(content(title="phase field")).time is None and header(content(title="t=-1.5e2 s")).time == -150
    for kind, name in (("vtktypefloat32", "float32"), ("FLOAT", "float32"), ("vtktypeuint32", "uint32"), ("int 1", "int32")):
        assert header(content(kind=kind)).dtype == name
    short = np.arange(-30, 30, dtype=np.int16).reshape(3, 4, 5)
    v = header(content(short, kind="short"))
    data = content(short, kind="short")
    assert (v.planes(data[v.data : v.data + 120], 3) == short.reshape(3, -1)).all()


@pytest.mark.parametrize(
    "data, message",
    [
        (b"x" + content(), "not a legacy"), (
            content(encoding="ASCII"), "only BINARY",
        ), (content(kind="float 3"), "3 components"), (content(kind="bit"), "unknown type"), (content(kind=""), "no SCALARS"),
        (
            content(after=b"\nSCALARS conc1 float\nLOOKUP_TABLE default\n" + bytes(240)), "after its field",
        ), (content()[:-21], "truncated"), (content(points=99), "doesn't fit"),
        (
            content().replace(b"STRUCTURED_POINTS", b"RECTILINEAR_GRID"), "only STRUCTURED_POINTS",
        ), (content(lines="FIELD a 1\n"), "not read: FIELD"), (content(lines="SPACING 1 2\n"), "SPACING"),
        (content(lines="ORIGIN a b c\n"), "ORIGIN"), (content().replace(b"DIMENSIONS 5 4 3", b"CELLS 5 4 3"), "CELLS"), (
            content().replace(b"LOOKUP_TABLE", b"LOOKUPS"), "no LOOKUP_TABLE",
        ),
    ],
)
def test_what_is_refused(data, message):
    with pytest.raises(FrameError, match=message):
        header(data)


def test_series(spark, tmp_path):
    vtk.register(spark)
    for i, t in ((1, 0), (2, 0.5), (10, 1)):
        (tmp_path / f"v_{i}.vtk").write_bytes(content(VOLUME + i, f"t = {t} s"))
    (tmp_path / "other.txt").write_bytes(b"x")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        df = spark.read.format("vtk").option("series", "true").option("dataset_id", "s").load(folder)
        got = {r.frame_no: (r.dataset_id, r.h, r.w, r.pixels) for r in df.collect()}
        assert sorted(got) == list(range(9)) and got[7][:3] == ("s", 4, 5)
        assert all(np.allclose(got[3 * k + z][3], (VOLUME + i)[z].ravel()) for k, i in enumerate((1, 2, 10)) for z in range(3))
        assert [r.frame_no for r in df.where("frame_no >= 4 and frame_no < 6").orderBy("frame_no").collect()] == [4, 5]
    paths = vtk.matching_files(str(tmp_path))
    row = vtk.describe(spark, paths, series=True).first()
    said = {k: json.loads(v) for k, v in row.metadata.items()}
    assert row.axes == ["time", "z", "y", "x"] and row["shape"] == [3, 3, 4, 5] and row.dtype == "float32" and not row.warnings
    assert said["time_s"] == [0, 0.5, 1] and said["source_files"] == ["v_1.vtk", "v_2.vtk", "v_10.vtk"] and said["spacing"] == [3, 2, 1]
    twice = vtk.describe(spark, [paths[0], paths[0]], series=True).first()
    assert len(twice.warnings) == 1 and "increase" in twice.warnings[0]
    single = vtk.describe(spark, paths[:1]).first()
    assert single.axes == ["z", "y", "x"] and json.loads(single.metadata["time_s"]) == 0 and json.loads(single.metadata["vtk_title"]) == "t = 0 s"
    (tmp_path / "v_3.vtk").write_bytes(content(VOLUME[:, :3], "no time"))
    with pytest.raises(FrameError, match="v_3.vtk is not on the same grid as v_1.vtk: shape"):
        vtk.describe(spark, vtk.matching_files(str(tmp_path)), series=True)
    with pytest.raises(Exception, match="v_3.vtk is not on the same grid"):
        spark.read.format("vtk").option("series", "true").load(str(tmp_path)).count()
    assert spark.read.format("vtk").option("pattern", "v_?.vtk").load(str(tmp_path)).count() == 9
    for bad in (
        lambda: vtk.matching_files(str(tmp_path), "*.raw"), lambda: vtk.describe(spark, []),
        lambda: vtk.read_header(str(tmp_path / "none.vtk")),
    ):
        with pytest.raises(FrameError, match="matches|no VTK|does not exist"):
            bad()


def test_stacks_need_one_grid(spark):
    files = [(f"v_{i}.vtk", content(VOLUME + i, f"t = {i} s")) for i in (1, 2, 10)]
    df = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    ranked = lambda rows: vtk.series_rank(vtk.catalog_of(df(rows)))
    got = {r.frame_no: r.pixels for r in vtk.stack_volumes(vtk.planes_of(df(files)), ranked(files)).collect()}
    assert sorted(got) == list(range(9)) and np.allclose(got[8], (VOLUME + 10)[2].ravel())
    odd = [*files, ("v_4.vtk", content(VOLUME, lines="SPACING 1 2 4\n"))]
    with pytest.raises(FrameError, match="v_4.vtk is not on the same grid as v_1.vtk"):
        vtk.stack_volumes(vtk.planes_of(df(odd)), ranked(odd))
    with pytest.raises(FrameError, match="3 planes, not 5"):
        vtk.stack_volumes(vtk.planes_of(df(files)), ranked(files), 5)
    with pytest.raises(FrameError, match="no volumes"):
        vtk.stack_volumes(vtk.planes_of(df([])), ranked([]))


def test_planes_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.4 GB: only the plane asked for is read."""
    nx, ny, nz = 10_000, 10_000, 6
    size = f"DIMENSIONS {nx} {ny} {nz}\nPOINT_DATA {nx * ny * nz}\n"
    head = f"# vtk DataFile Version 3.0\nbig\nBINARY\nDATASET STRUCTURED_POINTS\n{size}SCALARS a float\nLOOKUP_TABLE default\n".encode()
    path = tmp_path / "big.vtk"
    with path.open("wb") as f:
        f.write(head)
        f.truncate(len(head) + nx * ny * nz * 4)
        f.seek(len(head) + 5 * nx * ny * 4)
        f.write(np.array([7.5], ">f4").tobytes())
    vtk.register(spark)
    v = vtk.read_header(str(path))
    with vtk.open_file(str(path)) as f:
        assert v.planes(f.read_at(4, v.data + 5 * v.plane_bytes), 1)[0, 0] == 7.5
    df = spark.read.format("vtk").load(str(path)).where("frame_no = 5").select("frame_no", F.get("pixels", F.lit(0)).alias("first"))
    assert [tuple(r) for r in df.collect()] == [(5, 7.5)]


def test_queries_of_volumes_that_are_not_full(spark, tmp_path):
    """The last volume lacks planes, one in the middle lacks a plane, and one is missing: the series and the stack are whole."""
    ids = [i for i in range(23) if i != 7 and not 10 <= i < 15]
    rows = [(i, [float(np.float32(i + k / 64)) for k in range(64)], i % 3) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("open_vtk_series", "stack_volumes"):
        got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.SQL[name])
        assert got.count() == 17 * 64
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_small_files_share_a_task(spark, tmp_path):
    vtk.register(spark)
    for i in range(150):
        (tmp_path / f"v_{i}.vtk").write_bytes(content(VOLUME + i, f"t = {i} s"))
    for series in ("true", "false"):
        reader = vtk.VtkSource({"path": str(tmp_path), "series": series}).reader(None)
        before, parts = len(cloudpickle.dumps(reader)), reader.partitions()
        assert len(parts) == 3 and before < 1000 and sum(len(p.value) for p in parts) == 150
        df = spark.read.format("vtk").option("series", series).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == 3 and df.count() == 450
        got = df.where("frame_no in (1, 2, 400)").select("frame_no", "pixels").collect()
        assert len(got) == (3 if series == "true" else 300)
        assert all(np.allclose(r.pixels, (VOLUME + 133)[1].ravel()) for r in got if r.frame_no == 400)
    parts = vtk.VtkSource({"path": str(tmp_path), "partition_bytes": "170"}).reader(None).partitions()
    assert len(parts) == 300 and spark.read.format("vtk").option("partition_bytes", "170").load(str(tmp_path)).count() == 450
