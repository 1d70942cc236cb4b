"""Legacy VTK volumes (STRUCTURED_POINTS, big-endian): a Spark data source that reads planes by ranges of bytes from any store
that pyarrow knows, alone or as a series on one grid, and a reader of file contents that Spark has loaded."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from framelake.errors import FrameError
from framelake.functions.scalars import TIME_TITLE, natural_key, parse_time_title
from framelake.operators.ordering import global_rank

HEADER_BYTES = 4096
#: VTK's type names (fixed values); the vtktype names follow from kind and bits.
TYPES = {
    "unsigned_char": "uint8", "char": "int8", "unsigned_short": "uint16", "short": "int16", "unsigned_int": "uint32",
    "int": "int32", "unsigned_long": "uint64", "long": "int64", "float": "float32", "double": "float64",
}
SIZED_TYPES = {f"vtktype{t}": t for t in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")}
#: Lines that a header may have after its first three (fixed values).
LINES = ("DATASET", "DIMENSIONS", "SPACING", "ASPECT_RATIO", "ORIGIN", "POINT_DATA", "SCALARS", "LOOKUP_TABLE")
PLANES = "dataset_id string, frame_no long, h int, w int, pixels array<double>"
#: Planes are sent on in batches of about so many bytes.
BATCH_BYTES = 16 << 20
#: Bytes that a task reads, and that opening a file counts as when files are dealt to tasks.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Volume:
    name: str
    shape: tuple[int, int, int]
    dtype: str
    field: str
    title: str
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float]
    data: int

    @property
    def plane_bytes(self) -> int:
        return self.shape[1] * self.shape[2] * np.dtype(self.dtype).itemsize

    @property
    def grid(self) -> tuple:
        """What the volumes of a series have in common."""
        return self.shape, self.dtype, self.field, self.spacing, self.origin

    @property
    def time(self) -> float | None:
        """Seconds, where the title tells them."""
        found = re.match(TIME_TITLE, self.title)
        return float(found[1]) if found else None

    def planes(self, raw: bytes, count: int) -> np.ndarray:
        return np.frombuffer(raw, np.dtype(self.dtype).newbyteorder(">")).reshape(count, -1).astype(np.float64)


def parse_header(head: bytes, size: int, name: str) -> Volume:
    """Header of a volume; refuses what is not binary structured points with one scalar field, and wrong file sizes.

    Spacing is 1 and origin 0 where no line says so; both, and the shape, are in the order z, y, x."""
    if not head.startswith(b"# vtk DataFile"):
        raise FrameError(f"{name} is not a legacy VTK file")
    found = re.search(rb"^LOOKUP_TABLE[^\n]*\n", head, re.M | re.I)
    if not found:
        raise FrameError(f"{name} has no LOOKUP_TABLE line in its first {HEADER_BYTES} bytes")
    lines = [x.strip() for x in head[: found.end()].decode("latin-1").split("\n")]
    if lines[2].upper() != "BINARY":
        raise FrameError(f"{name} is {lines[2] or 'not'} encoded: only BINARY files are read")
    words: dict[str, list[str]] = {}
    for line in lines[3:]:
        if line:
            key, *rest = line.split()
            words[key.upper()] = rest
    kind = " ".join(words.get("DATASET", ["nothing"]))
    if kind.upper() != "STRUCTURED_POINTS":
        raise FrameError(f"{name} holds {kind}: only STRUCTURED_POINTS are read")
    strange = [k for k in words if k not in LINES]
    if strange:
        raise FrameError(f"{name} has lines that are not read: {', '.join(sorted(strange))}")

    def three(key: str, of: type, default: str | None) -> tuple:
        said = words.get(key, default.split() if default else None)
        try:
            if said is None or len(said) != 3:
                raise ValueError
            return tuple(of(x) for x in reversed(said))
        except ValueError as e:
            raise FrameError(f"{name}: {key} has no three numbers") from e

    shape = three("DIMENSIONS", int, None)
    spacing, origin = three("SPACING" if "SPACING" in words else "ASPECT_RATIO", float, "1 1 1"), three("ORIGIN", float, "0 0 0")
    field, kind, *components = [*words.get("SCALARS", []), "", ""][: max(2, len(words.get("SCALARS", [])))]
    if not kind:
        raise FrameError(f"{name} has no SCALARS line with a name and a type")
    if components not in ([], ["1"]):
        raise FrameError(f"{name}: field {field} has {components[0]} components; one is read")
    dtype = TYPES.get(kind.lower(), SIZED_TYPES.get(kind.lower()))
    if dtype is None:
        raise FrameError(f"{name}: unknown type {kind}")
    points = shape[0] * shape[1] * shape[2]
    if min(shape) < 1 or words.get("POINT_DATA") != [str(points)]:
        raise FrameError(f"{name}: POINT_DATA {' '.join(words.get('POINT_DATA', []))} doesn't fit DIMENSIONS of {points} points")
    out = Volume(name, shape, dtype, field, lines[1], spacing, origin, found.end())
    left = size - out.data - shape[0] * out.plane_bytes
    if left < 0:
        raise FrameError(f"{name} is truncated: {-left} bytes are missing")
    if left > 1:
        raise FrameError(f"{name} has {left} bytes after its field")
    return out


def write_volume(planes: np.ndarray, title: str, field: str = "field", spacing=(1, 1, 1), origin=(0, 0, 0)) -> bytes:
    """A file of a (z, y, x) array; spacing and origin in x, y, z."""
    names = {v: k for k, v in TYPES.items()}
    nz, ny, nx = planes.shape
    head = [
        "# vtk DataFile Version 3.0", title, "BINARY", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}",
        f"ORIGIN {' '.join(map(str, origin))}", f"SPACING {' '.join(map(str, spacing))}", f"POINT_DATA {planes.size}",
        f"SCALARS {field} {names[planes.dtype.name]} 1", "LOOKUP_TABLE default", "",
    ]
    return "\n".join(head).encode() + planes.astype(planes.dtype.newbyteorder(">")).tobytes() + b"\n"


# --- files of any store ----------------------------------------------------------------------------------------------


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:/", path):
        return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pa.fs.LocalFileSystem(), path


def open_file(path: str) -> pa.NativeFile:
    fs, inner = store_of(path)
    try:
        return fs.open_input_file(inner)
    except FileNotFoundError as e:
        raise FrameError(f"{path} does not exist") from e


def natural_name(path: str) -> list:
    """A key that sorts names with numbers in them by the numbers."""
    parts = re.split(r"(\d+)", path.rstrip("/").rsplit("/", 1)[-1].lower())
    return [int(p) if i % 2 else p for i, p in enumerate(parts)]


def sized_files(folder: str, pattern: str = "*.vtk") -> list[tuple[str, int]]:
    """Files directly in a folder that match a pattern, in natural order, with their sizes; none is an error."""
    fs, inner = store_of(folder)
    head = folder.rstrip("/")
    files = [i for i in fs.get_file_info(pa.fs.FileSelector(inner)) if i.type == pa.fs.FileType.File]
    found = sorted(((f"{head}/{i.base_name}", i.size) for i in files if fnmatch.fnmatchcase(i.base_name, pattern)), key=lambda x: natural_name(x[0]))
    if not found:
        raise FrameError(f"no file in {folder} matches {pattern}")
    return found


def matching_files(folder: str, pattern: str = "*.vtk") -> list[str]:
    """Files directly in a folder that match a pattern, in natural order; none is an error."""
    return [path for path, _ in sized_files(folder, pattern)]


def with_sizes(paths: Sequence[str]) -> list[tuple[str, int]]:
    """Files with their sizes; one that is not there is an error."""

    def size(path: str) -> int:
        fs, inner = store_of(path)
        info = fs.get_file_info(inner)
        if info.type != pa.fs.FileType.File:
            raise FrameError(f"{path} does not exist")
        return info.size

    with ThreadPoolExecutor(16) as pool:
        return list(zip(paths, pool.map(size, paths), strict=True))


def write_files(files: DataFrame, folder: str) -> None:
    """Write files (path: a name, content) to a folder of a store that all executors see, each by the task that has it."""

    def task(batches):
        fs, inner = store_of(folder)
        fs.create_dir(inner, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{inner}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"path": batch.column(0)})

    files.select("path", "content").mapInArrow(task, "path string").write.format("noop").mode("overwrite").save()


def file_header(f: pa.NativeFile, path: str) -> Volume:
    return parse_header(f.read_at(HEADER_BYTES, 0), f.size(), path.rsplit("/", 1)[-1])


def read_header(path: str) -> Volume:
    with open_file(path) as f:
        return file_header(f, path)


def read_headers(paths: Sequence[str]) -> list[Volume]:
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(read_header, paths))


def check_series(volumes: Sequence[Volume]) -> None:
    """All volumes of a series are on one grid; the first that isn't is named."""
    for v in volumes:
        if v.grid != volumes[0].grid:
            what = [n for n, a, b in zip(("shape", "type", "field", "spacing", "origin"), v.grid, volumes[0].grid, strict=True) if a != b]
            raise FrameError(f"{v.name} is not on the same grid as {volumes[0].name}: {', '.join(what)} differ")


def describe(spark: SparkSession, paths: Sequence[str], series: bool = False, dataset_id: str = "series") -> DataFrame:
    """The catalog rows (dataset_id, path, axes, shape, dtype, metadata, warnings) of volumes, or the one of a series of them.

    Only headers are read, on the driver, as when Spark lists files. Metadata are JSON by name: scalar_name, spacing, origin,
    and vtk_title, time_s (where a title tells it) or vtk_titles, source_files, time_s (where all do)."""
    if not paths:
        raise FrameError("no VTK files to open")
    volumes = read_headers(paths)
    common = lambda v: {"scalar_name": v.field, "spacing": v.spacing, "origin": v.origin}
    rows = []
    if series:
        check_series(volumes)
        times, first = [v.time for v in volumes], volumes[0]
        told = None not in times
        said = common(first) | {
            "vtk_titles": [v.title for v in volumes], "source_files": [v.name for v in volumes],
        } | ({"time_s": times} if told else {})
        late = told and any(b <= a for a, b in zip(times, times[1:], strict=False))
        warnings = [f"times {times} do not increase in the order of the files"] if late else []
        rows.append((
            dataset_id, ",".join(paths), ["time" if told else "frame", "z", "y", "x"], [len(volumes), *first.shape], first.dtype,
            said, warnings,
        ))
    else:
        for path, v in zip(paths, volumes, strict=True):
            said = common(v) | {"vtk_title": v.title} | ({} if v.time is None else {"time_s": v.time})
            rows.append((path, path, ["z", "y", "x"], list(v.shape), v.dtype, said, []))
    made = [(*r[:5], {k: json.dumps(x) for k, x in r[5].items()}, r[6]) for r in rows]
    return spark.createDataFrame(
        made,
        "dataset_id string, path string, axes array<string>, shape array<long>, dtype string, metadata map<string,string>, warnings array<string>",
    )


# --- the data source -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Range:
    """Planes of a file whose plane 0 has frame number `before`: `count` from `first` where the header is known, else those
    that the conditions choose, once the task has read the header."""

    path: str
    dataset_id: str
    before: int
    volume: Volume | None = None
    first: int = 0
    count: int = 0


class _Ranges(InputPartition):
    """What one task reads."""


class _Reader(DataSourceReader):
    def __init__(self, options):
        given = options.get("paths")
        path = options.get("path")
        if given:
            self.files = with_sizes([p for p in given.split(",") if p])
        elif path and path.lower().endswith(".vtk"):
            self.files = with_sizes([path])
        else:
            self.files = sized_files(path or "", options.get("pattern", "*.vtk"))
        self.series = str(options.get("series", "false")).lower() == "true"
        self.name = options.get("dataset_id", "series")
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.low, self.high, self.only = 0, None, None

    def __getstate__(self):
        """Each task gets the reader, but not the list of all files."""
        return {k: v for k, v in self.__dict__.items() if k != "files"}

    def pushFilters(self, filters):
        """Bounds on frame_no choose planes before any is read."""
        for f in filters:
            value = getattr(f, "value", None)
            column = getattr(f, "attribute", None) == ("frame_no",)
            if column and isinstance(f, In) and all(isinstance(v, int) for v in value):
                self._keep(set(value))
            elif not column or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self._keep({value})
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                most = value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)
            else:
                yield f

    def _keep(self, numbers: set[int]) -> None:
        self.only = numbers if self.only is None else self.only & numbers

    def partitions(self):
        """Ranges of large files, and small files together, whose headers the tasks read (of a series, the planner does too)."""
        headers = read_headers([path for path, size in self.files if self.series or size > self.bytes])
        if self.series:
            check_series(headers)
        depth, known, ranges = headers[0].shape[0] if self.series and headers else 0, iter(headers), []
        for i, (path, size) in enumerate(self.files):
            name, before = (self.name, i * depth) if self.series else (path, 0)
            v = next(known) if self.series or size > self.bytes else None
            if size > self.bytes:
                most = max(1, self.bytes // max(v.plane_bytes, 1))
                ranges += [(n * v.plane_bytes, _Range(path, name, before, v, z, n)) for z, n in self._runs(before, v.shape[0], most)]
            elif not self.series or any(self._runs(before, depth, depth)):
                ranges.append((size, _Range(path, name, before)))
        out, held = [], self.bytes + 1
        for size, r in ranges:
            held += size + OPEN_BYTES
            if held > self.bytes:
                out.append(_Ranges([]))
                held = size + OPEN_BYTES
            out[-1].value.append(r)
        return out

    def _runs(self, before: int, depth: int, most: int) -> Iterator[tuple[int, int]]:
        """Runs (first plane, count) of the wanted planes of a volume, each of `most` at most."""
        low = max(0, self.low - before)
        high = depth if self.high is None else min(depth, self.high + 1 - before)
        wanted = range(low, high) if self.only is None else sorted(z - before for z in self.only if low <= z - before < high)
        start = None
        for i, z in enumerate(wanted):
            if start is None:
                start = z
            last = i + 1 == len(wanted)
            if last or wanted[i + 1] != z + 1 or z + 1 - start == most:
                yield start, z + 1 - start
                start = None

    def read(self, part):
        if part is not None:  # else no plane is wanted
            yield from gathered(batch for r in part.value for batch in self._planes(r))

    def _planes(self, r: _Range) -> Iterator[pa.RecordBatch]:
        with open_file(r.path) as f:
            v = r.volume or file_header(f, r.path)
            step = max(1, BATCH_BYTES // max(v.plane_bytes, 1))
            for first, count in [(r.first, r.count)] if r.volume else self._runs(r.before, v.shape[0], v.shape[0]):
                for z in range(first, first + count, step):
                    n = min(step, first + count - z)
                    yield plane_batch(r.dataset_id, r.before + z, v, v.planes(f.read_at(n * v.plane_bytes, v.data + z * v.plane_bytes), n))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, those of small batches in batches of about BATCH_BYTES."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def plane_batch(dataset_id: str, first: int, v: Volume, planes: np.ndarray) -> pa.RecordBatch:
    """Rows of planes in an Arrow batch, without a Python value for each pixel."""
    n, size = planes.shape
    pixels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(planes.reshape(-1)))
    columns = [pa.array([dataset_id] * n), pa.array(np.arange(first, first + n)), *[pa.array([k] * n, pa.int32()) for k in v.shape[1:]], pixels]
    return pa.RecordBatch.from_arrays(columns, names=["dataset_id", "frame_no", "h", "w", "pixels"])


class VtkSource(DataSource):
    """spark.read.format("vtk").load(path): a row for each z plane, read by ranges of bytes.

    path is a file, or a folder whose files match the option pattern (*.vtk), in natural order; the option paths ("a,b") names
    files in an order of its own. A task reads about partition_bytes (64 MB), many small files or a range of a large one; only
    the headers of large files and of a series are read when the read is planned. With the option series, files must be on one grid, which is checked when the read is
    planned, and are one dataset (dataset_id): frame_no runs over (file, z). Paths are in any store that pyarrow reads and
    that every executor sees; for others load contents by binaryFile and `planes_of`. Conditions on frame_no are pushed down."""

    @classmethod
    def name(cls):
        return "vtk"

    def schema(self):
        return PLANES

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push conditions down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VtkSource)


# --- contents that Spark has loaded ----------------------------------------------------------------------------------


def _planes_task(batches):
    yield from gathered(_content_planes(batches))


def _content_planes(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = parse_header(content[:HEADER_BYTES], len(content), path)
            step = max(1, BATCH_BYTES // max(v.plane_bytes, 1))
            for z in range(0, v.shape[0], step):
                n = min(step, v.shape[0] - z)
                a = v.data + z * v.plane_bytes
                yield plane_batch(path, z, v, v.planes(content[a : a + n * v.plane_bytes], n))


def planes_of(files: DataFrame) -> DataFrame:
    """Planes of files (path, content), such as a binaryFile table."""
    return files.select("path", "content").mapInArrow(_planes_task, PLANES)


CATALOG = "dataset_id string, shape array<long>, dtype string, field string, title string, spacing array<double>, origin array<double>"


def _catalog_task(batches):
    for batch in batches:
        given = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        rows = [parse_header(c[:HEADER_BYTES], len(c), p) for p, c in given]
        lists = [("shape", pa.int64()), ("spacing", pa.float64()), ("origin", pa.float64())]
        columns = {"dataset_id": [v.name for v in rows], "shape": None} | {k: [getattr(v, k) for v in rows] for k in ("dtype", "field", "title")}
        columns |= {k: pa.array([list(getattr(v, k)) for v in rows], pa.list_(t)) for k, t in lists}
        yield pa.RecordBatch.from_pydict(columns)


def catalog_of(files: DataFrame) -> DataFrame:
    """dataset_id, shape (z, y, x), dtype, field, title, spacing, origin and time_s of files (path, content)."""
    return files.select("path", "content").mapInArrow(_catalog_task, CATALOG).withColumn("time_s", parse_time_title(F.col("title")))


def series_rank(catalog: DataFrame) -> DataFrame:
    """Volumes with their rank in the natural order of their names (a row for each file)."""
    return global_rank(catalog, natural_key(F.col("dataset_id")), "dataset_id")


def stack_volumes(planes: DataFrame, ranked: DataFrame, depth: int | None = None) -> DataFrame:
    """Planes of several volumes as one stack: frame_no runs over (volume, z).

    ranked: the volumes' catalog with their rank. Volumes that aren't on one grid (shape, dtype, field, spacing, origin), or
    not of the depth, are refused by name."""
    grid = F.to_json(F.struct("shape", "dtype", "field", "spacing", "origin"))
    first = ranked.agg(F.min_by(F.struct("dataset_id", grid.alias("grid"), F.col("shape")[0].alias("depth")), "rank").alias("f")).first()["f"]
    if first is None:
        raise FrameError("there are no volumes to stack")
    odd = ranked.where(grid != first["grid"]).orderBy("rank").select("dataset_id").limit(1).collect()
    if odd:
        raise FrameError(f"{odd[0][0]} is not on the same grid as {first['dataset_id']}")
    if depth is not None and depth != first["depth"]:
        raise FrameError(f"volumes have {first['depth']} planes, not {depth}")
    r = ranked.select("dataset_id", "rank")
    moved = planes.join(F.broadcast(r) if r.limit(100_001).count() <= 100_000 else r, "dataset_id")
    return moved.withColumn("frame_no", F.col("rank") * first["depth"] + F.col("frame_no")).drop("rank")


def union_frames(parts: list[DataFrame]) -> DataFrame:
    """Frames of several tables in order, renumbered."""
    counts = [p.agg(F.coalesce(F.max("frame_no") + 1, F.lit(0))).first()[0] for p in parts]
    moved = [p.withColumn("frame_no", F.col("frame_no") + sum(counts[:i])) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, moved)
