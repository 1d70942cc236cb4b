"""The library's queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import FrameError
from framelake.frames import Frames, frame_index, frame_rank, from_array_column, from_rows, pointwise, tiles_from_array_column, to_pixels, to_tiles
from framelake.functions import pointwise as fn
from framelake.functions import scalars
from framelake.functions.colormaps import FIRE, color_tables
from framelake.operators import aggregates, convert, geometry, joins, neighbourhood, tile_stats
from framelake.operators.ordering import bounded, global_rank, shared_folder, stored
from framelake.plans.pipeline import OPERATIONS, Param, Pipeline, Step, experiment_scan, register, run_pipeline
from framelake.sources import files as listings
from framelake.sources import vtk, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql:
            SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return add


# --- frames of the given tables --------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> Frames:
    """Each embedding as a frame of 8 x 8."""
    return Frames(from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.lit("emb")), 8, 8)


def emb_tiles(spark: SparkSession, sf_dir: str, size: int = 5) -> Frames:
    """The same as tiles of the arrays; 5 leaves narrow tiles at the right and lower edge."""
    return tiles_from_array_column(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 8, F.lit("emb"), size)


def labelled(spark: SparkSession, sf_dir: str, condition: str, size: int = 5) -> Frames:
    """Frames, as tiles, of labels 0 (dark), 1 (flat) or others (samples)."""
    return tiles_from_array_column(table(spark, sf_dir, "embeddings").where(condition), "vec_id", "embedding", 8, 8, F.lit("emb"), size)


def events(spark: SparkSession, sf_dir: str) -> Frames:
    """Event values in frames of 32 x 32; the last frame may lack pixels."""
    return Frames(from_rows(table(spark, sf_dir, "events"), F.col("event_id"), F.col("value"), 32, 32, F.lit("events")), 32, 32)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def out(df: DataFrame) -> DataFrame:
    """Pixels, also of tiles, with rounded values."""
    df = to_pixels(df) if "pixels" in df.columns else df
    return df.select("frame_no", "y", "x", r6("value").alias("value"))


PX = (
    "px AS (SELECT vec_id AS frame_no, label, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] "
    "AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) t(i))"
)
EV = "px AS (SELECT event_id // 1024 AS frame_no, CAST(event_id % 1024 // 32 AS INTEGER) AS y, CAST(event_id % 32 AS INTEGER) AS x, value AS v FROM events)"


def point(expr: str, where: str = "true", y: str = "y", x: str = "x", f: str = "frame_no", px: str = PX) -> str:
    return f"WITH {px} SELECT {f} AS frame_no, CAST({y} AS INTEGER) AS y, CAST({x} AS INTEGER) AS x, round({expr}, 6) + 0.0 AS value FROM px WHERE {where}"


# --- sources ---------------------------------------------------------------------------------------------------------


@query(point("v"))
def q_frames_from_array_column(spark, sf_dir):
    return out(emb(spark, sf_dir).df)


@query(point("v", px=EV))
def q_frames_from_rows(spark, sf_dir):
    return out(events(spark, sf_dir).df)


def volumes(spark, sf_dir, whole: bool = False) -> DataFrame:
    """Files (path, content) of VTK volumes of five embeddings each.

    whole: a volume for every number up to the last, each of five planes, as a series has to be on one grid. Planes without an
    embedding are padding, whose frame numbers `padding` has."""

    def write(t: pa.Table) -> pa.Table:
        k = t.column("k")[0].as_py()
        t = (t.filter(pc.is_valid(t.column("vec_id"))) if whole else t).sort_by("vec_id")
        planes = np.array(t.column("embedding").to_pylist(), np.float32).reshape(-1, 8, 8)
        if whole:
            at, full = t.column("vec_id").to_numpy() - 5 * k, np.full((5, 8, 8), np.nan, np.float32)
            if len(set(at)) < len(at):
                raise FrameError(f"volume {k} has two embeddings for one plane")
            full[at] = planes
            planes = full
        return pa.table({"path": [f"v_{k}.vtk"], "content": [vtk.write_volume(planes, f"t = {k * 0.5} s", "frac", (1, 2, 3), (0, 0, 10))]})

    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("k"), "vec_id", "embedding")
    if whole:
        e = e.unionByName(spark.range(_volume_count(e)).select(F.col("id").alias("k")), allowMissingColumns=True)
    return e.groupBy("k").applyInArrow(write, "path string, content binary")


def _volume_count(e: DataFrame) -> int:
    """Volumes of five planes up to the largest vec_id."""
    return e.agg(F.coalesce(F.floor(F.max("vec_id") / 5) + 1, F.lit(0))).first()[0]


def padding(spark, sf_dir) -> DataFrame:
    """frame_no of the planes of whole volumes that have no embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    every = spark.range(5 * _volume_count(e)).select(F.col("id").alias("frame_no"))
    return bounded(stored(every.join(e, F.col("frame_no") == F.col("vec_id"), "left_anti")))


def _plane_pixels(planes: DataFrame, *said: str) -> DataFrame:
    p = planes.select("dataset_id", *said, "frame_no", "w", F.posexplode("pixels").alias("i", "value"))
    return p.select(
        "dataset_id", *said, "frame_no", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"),
        (F.col("i") % F.col("w")).cast("int").alias("x"), r6("value").alias("value"),
    )


def vtk_folder(spark, sf_dir, whole: bool = False) -> str:
    """A folder of the shared store with those files."""
    folder = scratch(spark)
    vtk.write_files(volumes(spark, sf_dir, whole), folder)
    vtk.register(spark)
    return folder


@query(
    f"WITH {PX} SELECT 'v_' || (frame_no // 5) || '.vtk' AS dataset_id, frame_no % 5 AS frame_no, y, x, round(v, 6) + 0.0 AS value FROM "
    f"px WHERE frame_no % 5 >= 1"
)
def q_open_vtk(spark, sf_dir):
    planes = spark.read.format("vtk").load(vtk_folder(spark, sf_dir)).where("frame_no >= 1")
    return _plane_pixels(planes.withColumn("dataset_id", F.element_at(F.split("dataset_id", "/"), -1)))


@query(
    f"WITH {PX} SELECT 'eqx' AS dataset_id, 'time' AS axis, (SELECT max(vec_id) // 5 + 1 FROM embeddings) AS files, frame_no, (frame_no "
    f"// 5) * 0.5::DOUBLE AS time_s, y, x, round(v, 6) + 0.0 AS value FROM px"
)
def q_open_vtk_series(spark, sf_dir):
    folder = vtk_folder(spark, sf_dir, whole=True)
    catalog = vtk.describe(spark, vtk.matching_files(folder), series=True, dataset_id="eqx")
    planes = spark.read.format("vtk").option("series", "true").option("dataset_id", "eqx").load(folder)
    depth = catalog.select(F.col("shape")[1]).first()[0]
    said = bounded(stored(catalog.select(
        "dataset_id", F.col("axes")[0].alias("axis"), F.col("shape")[0].alias("files"),
        F.posexplode(F.from_json(F.col("metadata")["time_s"], "array<double>")).alias("frame", "time_s"),
    )))
    planes = planes.withColumn("frame", F.floor(F.col("frame_no") / depth))
    joined = planes.join(said, ["dataset_id", "frame"]).join(padding(spark, sf_dir), "frame_no", "left_anti")
    return _plane_pixels(joined, "axis", "files", "time_s").select("dataset_id", "axis", "files", "frame_no", "time_s", "y", "x", "value")


@query(f"WITH {PX} SELECT frame_no, y, x, round(v, 6) + 0.0 AS value FROM px")
def q_stack_volumes(spark, sf_dir):
    f = volumes(spark, sf_dir, whole=True)
    stacked = vtk.stack_volumes(vtk.planes_of(f), vtk.series_rank(vtk.catalog_of(f)))
    return _plane_pixels(stacked.join(padding(spark, sf_dir), "frame_no", "left_anti")).select("frame_no", "y", "x", "value")


@query(
    "WITH g AS (SELECT vec_id // 5 AS k, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'given' AS grid, count(*) AS volumes, min(n) "
    "= max(n) AS one_grid FROM g UNION ALL SELECT 'first volume deeper', count(*), false FROM g"
)
def q_grid_check(spark, sf_dir):
    c = vtk.catalog_of(volumes(spark, sf_dir))
    deeper = c.withColumn(
        "shape",
        F.when(F.col("dataset_id") == "v_0.vtk", F.transform("shape", lambda n, i: F.when(i == 0, n + 4).otherwise(n))).otherwise(F.col("shape")),
    )
    checked = lambda df, name: aggregates.grid_check(df).select(F.lit(name).alias("grid"), "volumes", "one_grid")
    return checked(c, "given").unionByName(checked(deeper, "first volume deeper"))


@query(
    "SELECT k AS rank, t AS time_s, before FROM (SELECT k, t, lag(t) OVER (ORDER BY k) AS before FROM (SELECT event_id // 1024 AS k, "
    "min(value) AS t FROM events GROUP BY 1)) WHERE t <= before"
)
def q_time_monotonic(spark, sf_dir):
    v = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1024).alias("rank")).agg(F.min("value").alias("time_s"))
    return aggregates.time_monotonic(v)


NAMES = "n AS (SELECT p_partkey AS k, 'scan_' || (p_partkey % 3) || '_' || p_partkey || '.tif' AS name FROM part)"


def names(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit("scan_"), (k % 3).cast("string"), F.lit("_"), k.cast("string"), F.lit(".tif")).alias("name"),
    )


@query(f"WITH {NAMES} SELECT name, row_number() OVER (ORDER BY k) - 1 AS frame_no, k AS number FROM n WHERE k % 3 = 1")
def q_open_sequence(spark, sf_dir):
    return aggregates.sequence_files(names(spark, sf_dir), "scan_1_*.tif")


PAGES = (
    "f AS (SELECT page_id, 'site/' || (page_id % 7) || '/' || page_id || CASE page_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.VTK' WHEN 2 "
    "THEN '.txt' ELSE '' END AS path, 'site/' || (page_id % 7) AS folder, page_id || CASE page_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN "
    "'.VTK' WHEN 2 THEN '.txt' ELSE '' END AS name, CAST(length(url) AS BIGINT) AS length, page_id % 11 = 0 AS is_dir FROM pages)"
)


def pages(spark, sf_dir) -> DataFrame:
    p = F.col("page_id")
    end = F.when(p % 4 == 0, ".tif").when(p % 4 == 1, ".VTK").when(p % 4 == 2, ".txt").otherwise("")
    folder = F.concat(F.lit("site/"), (p % 7).cast("string"))
    name = F.concat(p.cast("string"), end)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(folder, F.lit("/"), name).alias("path"), folder.alias("folder"), name.alias("name"),
        F.length("url").cast("long").alias("length"), (p % 11 == 0).alias("is_dir"),
    )


@query(f"WITH {PAGES} SELECT path FROM f WHERE folder = 'site/3' AND name GLOB '*1*.tif'")
def q_find_files(spark, sf_dir):
    return listings.find_files(pages(spark, sf_dir), "site/3", "*1*.tif").select("path")


@query(
    f"WITH {PAGES} SELECT name, is_dir, NOT is_dir AND (name LIKE '%.tif' OR name LIKE '%.VTK') AS openable, row_number() OVER (ORDER "
    f"BY NOT is_dir, page_id) AS rank FROM f"
)
def q_scan_files(spark, sf_dir):
    shown = listings.listing(pages(spark, sf_dir))
    return global_rank(shown, ~F.col("is_dir"), scalars.natural_key(F.col("name")), "name", first=1).select("name", "is_dir", "openable", "rank")


@query(f"WITH {PAGES} SELECT name, row_number() OVER (PARTITION BY folder ORDER BY NOT is_dir, page_id) AS rank FROM f")
def q_dirs_first_sort(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("folder").orderBy(~F.col("is_dir"), scalars.natural_key(F.col("name")), "name")
    return pages(spark, sf_dir).select("name", F.row_number().over(w).cast("long").alias("rank"))


@query(f"WITH {NAMES} SELECT name, row_number() OVER (ORDER BY k % 3, k) AS rank FROM n")
def q_natural_sort(spark, sf_dir):
    return global_rank(names(spark, sf_dir), scalars.natural_key(F.col("name")), "name", first=1).select("name", "rank")


@query("SELECT vec_id AS frame_no FROM embeddings WHERE vec_id % 91 = 17 AND vec_id < (SELECT max(vec_id) FROM embeddings WHERE vec_id % 91 <> 17)")
def q_scan_missing_frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit("emb").alias("dataset_id"), F.col("vec_id").alias("frame_no"))
    claimed = e.groupBy("dataset_id").agg((F.max("frame_no") + 11).alias("frames"))
    return listings.missing_frames(e.where("frame_no % 91 <> 17"), claimed).select("frame_no")


def catalog(spark, sf_dir) -> DataFrame:
    """Datasets of made-up kinds, one for each page; six to a path."""
    p = F.col("page_id")
    shape = F.when(p % 3 == 0, F.array(p + 1)).when(p % 3 == 1, F.array(F.lit(2), p + 1)).otherwise(F.array(F.lit(4), F.lit(6), p % 5 + 1))
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("file"), F.floor(p / 2).cast("string")).alias("path"),
        F.concat(F.lit("d"), p.cast("string")).alias("dataset_id"), F.transform(shape, lambda n: n.cast("long")).alias("shape"),
        F.when(p % 7 == 0, "str").otherwise("uint16").alias("dtype"), F.lit(2).cast("long").alias("item_bytes"),
    )


CATALOG = (
    "c AS (SELECT page_id, 'file' || (page_id // 2) AS path, 'd' || page_id AS dataset_id, CASE page_id % 3 WHEN 0 THEN [page_id + 1] "
    "WHEN 1 THEN [2, page_id + 1] ELSE [4, 6, page_id % 5 + 1] END AS shape, CASE WHEN page_id % 7 = 0 THEN 'str' ELSE 'uint16' END AS "
    "dtype FROM pages)"
)


@query(
    f"WITH {CATALOG}, g AS (SELECT path, list_sort(list(dataset_id) FILTER (len(shape) >= 2 AND dtype <> 'str')) AS ids FROM c GROUP BY "
    f"1) SELECT path, CASE WHEN len(ids) = 1 THEN ids[1] END AS dataset_id, CASE WHEN ids IS NULL OR len(ids) = 0 THEN 'no image "
    f"dataset' WHEN len(ids) > 1 THEN 'choose one of ' || array_to_string(ids, ', ') END AS problem FROM g"
)
def q_select_dataset(spark, sf_dir):
    return listings.select_dataset(catalog(spark, sf_dir))


@query(
    f"WITH {CATALOG} SELECT dataset_id, CASE WHEN len(shape) = 2 THEN 'y,x' WHEN len(shape) = 3 AND shape[3] IN (3, 4) THEN "
    f"'y,x,channel' WHEN len(shape) = 3 THEN 'frame,y,x' END AS axes FROM c"
)
def q_default_axes(spark, sf_dir):
    axes = listings.default_axes(F.col("shape"))
    return catalog(spark, sf_dir).select("dataset_id", F.when(axes.isNotNull(), F.array_join(axes, ",")).alias("axes"))


@query(
    f"WITH {CATALOG} SELECT dataset_id, CASE WHEN len(shape) = 3 AND shape[3] NOT IN (3, 4) THEN shape[1] ELSE 1 END AS frames, "
    f"list_product(shape)::BIGINT * 2 AS bytes FROM c WHERE len(shape) >= 2"
)
def q_dataset_size(spark, sf_dir):
    c = catalog(spark, sf_dir).withColumn("axes", listings.default_axes(F.col("shape"))).where("size(shape) >= 2")
    return aggregates.dataset_size(c)


@query(f"WITH {CATALOG} SELECT dataset_id, 'time,y,x' AS axes FROM c WHERE len(shape) = 3")
def q_rename_axes(spark, sf_dir):
    from framelake.frames import check_axes

    axes = F.array(*[F.lit(a) for a in check_axes(("time", "y", "x"))])
    return catalog(spark, sf_dir).where("size(shape) = 3").select(
        "dataset_id", F.array_join(listings.default_axes(F.col("shape"), axes), ",").alias("axes"),
    )


@query(
    f"WITH {PAGES} SELECT 'folder' AS reference, path FROM f WHERE folder = 'site/2' AND (name LIKE '%.tif' OR name LIKE '%.VTK') UNION "
    f"ALL SELECT 'file', path FROM f WHERE page_id = 5"
)
def q_reference_files(spark, sf_dir):
    f = pages(spark, sf_dir)
    refs = f.where("page_id = 5").select(
        F.lit("file").alias("reference"), F.col("path").alias("entry"),
    ).union(f.where("page_id = 2").select(F.lit("folder"), "folder"))
    return listings.reference_files(refs, f).select("reference", "path")


# --- pointwise -------------------------------------------------------------------------------------------------------


@query(point("1.5 - 0.5 - v"))
def q_invert(spark, sf_dir):
    return out(pointwise(emb_tiles(spark, sf_dir).df, fn.invert(-0.5, 1.5)))


@query(point("least(greatest(v, -0.1), 0.15)"))
def q_clip(spark, sf_dir):
    return out(pointwise(emb_tiles(spark, sf_dir).df, fn.clip(-0.1, 0.15)))


@query(point("CASE WHEN v >= 0.05 THEN 1.0 ELSE 0.0 END"))
def q_threshold(spark, sf_dir):
    return out(pointwise(to_tiles(emb(spark, sf_dir).df, 4), fn.threshold(0.05)))


CURVE = [[0.0, 0.0], [0.25, 0.2], [0.5, 0.6], [0.75, 0.7], [1.0, 1.0]]


def _tone_sql(v: str) -> str:
    lim = lambda e: f"least(greatest({e}, 0.0::DOUBLE), 1.0::DOUBLE)"
    parts = []
    for k, (x0, c0, c1, c2, c3) in enumerate(fn.pchip(CURVE)):
        t = f"(c - {x0!r}::DOUBLE)"
        inner = f"{c1!r}::DOUBLE + {t} * ({c2!r}::DOUBLE + {t} * ({c3!r}::DOUBLE))"
        parts.append(f"WHEN c < {CURVE[k + 1][0]!r} THEN {c0!r}::DOUBLE + {t} * ({inner})")
    cubic = f"CASE WHEN c <= 0 THEN 0.0 {' '.join(parts)} ELSE 1.0 END"
    return f"""a AS (SELECT *, {lim(f'({v}) * pow(2.0::DOUBLE, 0.5)')} AS t0 FROM px),
b AS (SELECT *, {lim('(t0 - 0.025) / (0.925 - 0.025)')} AS t1 FROM a),
s AS (SELECT *, {lim('t1 + 0.945::DOUBLE * t1 * (1 - t1) * (0.2 * (1 - t1) + (-0.4) * t1)')} AS t2 FROM b),
k AS (SELECT *, t2 + 0.25 * (t2 * t2 * (3 - 2 * t2) - t2) AS c FROM s),
q AS (SELECT *, {lim(cubic)} AS t FROM k)"""


SLIDERS = {"exposure": 0.5, "contrast": 25, "highlights": -40, "shadows": 20, "whites": 30, "blacks": -10}


@query(f"WITH {PX}, {_tone_sql('v + 0.3')} SELECT frame_no, y, x, round(t, 6) + 0.0 AS value FROM q")
def q_tone_map(spark, sf_dir):
    f = fn.chain(fn.Stage(lambda v: v + F.lit(0.3), lambda a: a + 0.3), fn.tone_map(**SLIDERS, curve=CURVE))
    return out(pointwise(emb_tiles(spark, sf_dir).df, f))


@query(f"WITH {PX}, {_tone_sql('(v + 0.2) / 0.5')} SELECT frame_no, y, x, round(t * 0.5 - 0.2, 6) + 0.0 AS value FROM q")
def q_tone(spark, sf_dir):
    return out(pointwise(emb_tiles(spark, sf_dir).df, fn.tone(-0.2, 0.3, **SLIDERS, curve=CURVE)))


@query(point("round_even(least(greatest((v + 0.2) / 0.4 * 255.0, 0), 255), 0)"))
def q_to_uint8(spark, sf_dir):
    return out(pointwise(emb(spark, sf_dir).df, fn.to_uint8(-0.2, 0.2)))


@query(point("v", "y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 3", "y - 2", "x - 1"))
def q_crop(spark, sf_dir):
    return out(geometry.crop(emb_tiles(spark, sf_dir), 2, 1, 5, 3).df)


@query(point("v", y="x", x="7 - y"))
def q_rotate(spark, sf_dir):
    return out(geometry.rotate(emb_tiles(spark, sf_dir), "90").df)


@query(point("v", x="7 - x"))
def q_flip(spark, sf_dir):
    return out(geometry.flip(emb_tiles(spark, sf_dir), "horizontal").df)


def _frames(spark, sf_dir) -> int:
    return table(spark, sf_dir, "embeddings").count()


@query(
    f"WITH {PX}, p AS (SELECT unnest([7, 3, 3]) AS f, unnest([0, 1, 2]) AS i) SELECT CAST(i AS BIGINT) AS frame_no, y, x, round(v, 6) + "
    f"0.0 AS value FROM px JOIN p ON f = frame_no"
)
def q_select_frames(spark, sf_dir):
    return out(geometry.list_frames(emb(spark, sf_dir).df, _frames(spark, sf_dir), [7, 3, 3]))


@query(point("v", "frame_no % 3 = (SELECT (count(*) - 1) % 3 FROM embeddings)", f="((SELECT count(*) FROM embeddings) - 1 - frame_no) // 3"))
def q_every_nth_frame(spark, sf_dir):
    return out(geometry.slice_frames(emb(spark, sf_dir).df, _frames(spark, sf_dir), None, None, -3))


@query(point("v", "y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 7"))
def q_select_region(spark, sf_dir):
    return out(geometry.select_region(emb(spark, sf_dir).df, (2, 5), (3, 8)))


@query(f"WITH {EV} SELECT frame_no, y, x, CAST(trunc(least(v, 65535)) AS INTEGER) AS value FROM px")
def q_cast_dtype(spark, sf_dir):
    df = pointwise(pointwise(events(spark, sf_dir).df, fn.clip(high=65535.0)), fn.cast_dtype("uint16"))
    return df.select("frame_no", "y", "x", "value")


@query(f"WITH {PX} SELECT frame_no, y, x, row_number() OVER (ORDER BY frame_no, y, x) - 1 AS place FROM px")
def q_frame_order(spark, sf_dir):
    return global_rank(emb(spark, sf_dir).df, "dataset_id", "frame_no", "y", "x", "channel", name="place").select("frame_no", "y", "x", "place")


# --- joins -----------------------------------------------------------------------------------------------------------

REFS = (
    f"WITH {PX}, d AS (SELECT y, x, avg(v) AS d FROM px WHERE label = 0 GROUP BY 1, 2), f AS (SELECT y, x, avg(v) AS f FROM px WHERE "
    f"label = 1 GROUP BY 1, 2)"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat-field correction of the samples by averaged darks and flats, on pixels: column expressions only."""
    e = table(spark, sf_dir, "embeddings")
    of = lambda condition: from_array_column(e.where(condition), "vec_id", "embedding", 8, F.lit("emb"))
    dark, flat = (aggregates.average_frames(of(f"label = {k}")) for k in (0, 1))
    return out(joins.flat_field(of("label > 1"), 64, dark, flat))


@query(
    f"{REFS} SELECT frame_no, px.y, px.x, round(CASE WHEN f - d > 0 THEN (v - d) / (f - d) ELSE 0 END, 6) + 0.0 AS value FROM px JOIN d "
    f"USING (y, x) JOIN f USING (y, x) WHERE label > 1"
)
def q_flat_field(spark, sf_dir):
    dark, flat = (aggregates.average_frames(labelled(spark, sf_dir, f"label = {k}").df) for k in (0, 1))
    return out(joins.flat_field_tiles(labelled(spark, sf_dir, "label > 1"), dark, flat).df)


def _fire_sql() -> str:
    n = len(FIRE[0])
    pick = lambda c, i: f"({list(FIRE[c])!r})[CAST({i} AS INTEGER) + 1]"
    return ", ".join(
        f"CAST(floor((1 - (p - l)) * {pick(c, 'l')} + (p - l) * {pick(c, f'least(l + 1, {n - 1})')}) AS INTEGER) AS {name}" for c,
        name in enumerate("rgb")
    )


@query(
    f"WITH {PX}, i AS (SELECT frame_no, y, x, round_even(least(greatest((v + 0.2) / 0.4 * 255.0, 0), 255), 0) * 0.125 AS p FROM px), j "
    f"AS (SELECT *, floor(p) AS l FROM i) SELECT frame_no, y, x, {_fire_sql()} FROM j"
)
def q_apply_colormap(spark, sf_dir):
    grey = pointwise(emb(spark, sf_dir).df, fn.to_uint8(-0.2, 0.2))
    return joins.apply_colormap(grey, color_tables(spark), "fire", 1).select("frame_no", "y", "x", "r", "g", "b")


def manifests(spark, sf_dir):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    a = pages(spark, sf_dir).select("page_id", "path", "length", t.alias("modified"), "is_dir")
    b = a.where("page_id % 5 <> 0").withColumn("length", F.col("length") + (F.col("page_id") % 7 == 0).cast("long"))
    return a.drop("page_id", "is_dir"), b.drop("page_id")


DIFF = (
    f"{PAGES}, m AS (SELECT path, length, page_id, CASE WHEN page_id % 5 = 0 THEN 'copy' WHEN is_dir THEN 'error' WHEN page_id % 7 = 0 "
    f"THEN 'conflict' ELSE 'skip' END AS status FROM f)"
)


@query(f"WITH {DIFF} SELECT path, length, status FROM m")
def q_manifest_diff(spark, sf_dir):
    return joins.manifest_diff(*manifests(spark, sf_dir))


@query(
    f"WITH {DIFF} SELECT count(*) FILTER (status = 'copy') AS copied, count(*) FILTER (status = 'skip') AS skipped, count(*) FILTER "
    f"(status = 'conflict') AS conflicts, CAST(sum(length) FILTER (status = 'copy') AS BIGINT) AS bytes, count(*) FILTER (status = "
    f"'copy' AND page_id % 10 = 0) AS checksummed FROM m"
)
def q_copy_summary(spark, sf_dir):
    source, target = manifests(spark, sf_dir)
    told = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select("page_id", F.md5(F.encode("html", "utf-8")).alias("md5"))
    known = pages(spark, sf_dir).select("page_id", "path").join(told, "page_id").select("path", "md5")
    return joins.copy_summary(joins.manifest_diff(source.join(known, "path", "left"), target))


@query(
    "SELECT 'p' || page_id AS path, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'size' WHEN page_id % 4 = 0 "
    "THEN 'md5' ELSE 'digest' END AS problem FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0 OR page_id % 6 = 0"
)
def q_verify_copies(spark, sf_dir):
    p = F.col("page_id")
    a = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("p"), p.cast("string")).alias("path"), F.encode("html", "utf-8").alias("content"),
    )
    b = a.where(p % 5 != 0).withColumn(
        "content",
        F.when(p % 7 == 0, F.concat("content", F.encode(F.lit("x"), "utf-8"))).when(
            p % 6 == 0, F.concat(F.encode(F.lit("~"), "utf-8"), F.expr("substring(content, 2)")),
        ).otherwise(F.col("content")),
    )
    d = lambda df: joins.digests(df.withColumn("length", F.octet_length("content")))
    told = d(a).withColumn("md5", F.when(F.substring("path", 2, 20).cast("long") % 4 == 0, F.col("md5")))  # a store tells some
    return joins.verify_copies(told, d(b))


STEPS = (
    "t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'notes' || o_orderkey || '.txt' ELSE 'run_001' || "
    "lpad(CAST(o_orderkey % 40 AS VARCHAR), 4, '0') || '_a_b_' || o_orderkey || '.tif' END AS name FROM orders)"
)


def steps(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(
        k % 10 == 0, F.concat(F.lit("notes"), k.cast("string"), F.lit(".txt")),
    ).otherwise(F.concat(F.lit("run_001"), F.lpad((k % 40).cast("string"), 4, "0"), F.lit("_a_b_"), k.cast("string"), F.lit(".tif")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), name.alias("name"))


@query(f"WITH {STEPS} SELECT name, CASE WHEN k % 10 <> 0 THEN CAST(k % 40 AS INTEGER) END AS step FROM t")
def q_parse_timestep(spark, sf_dir):
    return steps(spark, sf_dir).select("name", scalars.parse_timestep(F.col("name")).alias("step"))


@query(f"WITH {STEPS} SELECT CAST(k % 40 AS INTEGER) AS step, count(*) AS files, min(name) AS first FROM t WHERE k % 10 <> 0 GROUP BY 1")
def q_group_timesteps(spark, sf_dir):
    return aggregates.group_timesteps(steps(spark, sf_dir))


@query(
    f"WITH {STEPS} SELECT DISTINCT CAST(k % 40 AS INTEGER) AS step FROM t WHERE k % 10 <> 0 AND k % 40 NOT IN (SELECT CAST(s_suppkey % "
    f"9 AS INTEGER) FROM supplier)"
)
def q_pending_timesteps(spark, sf_dir):
    s = steps(spark, sf_dir).select(scalars.parse_timestep(F.col("name")).alias("step")).where("step is not null")
    return joins.pending_timesteps(s, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 9).cast("int").alias("step")))


@query(
    f"WITH {PX} SELECT frame_no, count(*) AS pixels, count(*) FILTER (x = 7) AS unmatched, count(*) FILTER (x < 7 AND y = 3 AND abs(v * "
    f"0.01) > 1e-8 + 1e-5 * abs(v * 1.01)) AS different, round(max(CASE WHEN x < 7 AND y = 3 THEN abs(v * 0.01) WHEN x < 7 THEN 0 END), "
    f"6) + 0.0 AS max_difference FROM px GROUP BY 1"
)
def q_frame_comparison(spark, sf_dir):
    a = emb(spark, sf_dir).df
    b = a.where("x < 7").withColumn("value", F.when(F.col("y") == 3, F.col("value") * 1.01).otherwise(F.col("value")))
    return joins.frame_comparison(a, b).select("frame_no", "pixels", "unmatched", "different", r6("max_difference").alias("max_difference"))


# --- aggregates ------------------------------------------------------------------------------------------------------


def averaged(tiles: DataFrame) -> DataFrame:
    """y, x, value of averaged tiles."""
    one = tiles.select("*", F.lit("average").alias("dataset_id"), F.lit(0).cast("long").alias("frame_no"))
    return to_pixels(one).select("y", "x", r6("value").alias("value"))


@query(f"WITH {PX} SELECT y, x, round(avg(v), 6) + 0.0 AS value FROM px GROUP BY 1, 2")
def q_average_frames_mean(spark, sf_dir):
    return averaged(aggregates.average_frames(emb_tiles(spark, sf_dir).df))


@query(f"WITH {PX} SELECT y, x, round(quantile_cont(v, 0.5), 6) + 0.0 AS value FROM px GROUP BY 1, 2")
def q_average_frames_median(spark, sf_dir):
    return averaged(aggregates.average_frames(emb_tiles(spark, sf_dir).df, "median"))


@query(
    f"WITH {PX} SELECT CASE label WHEN 0 THEN 'dark' ELSE 'flat' END AS reference, y, x, round(avg(v), 6) + 0.0 AS value FROM px WHERE "
    f"label < 2 GROUP BY 1, 2, 3"
)
def q_reference_average(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("folder", F.concat(F.lit("refs/"), F.col("label").cast("string")))
    e = e.withColumn("name", F.concat(F.col("vec_id").cast("string"), F.lit(".tif"))).withColumn("path", F.concat_ws("/", "folder", "name"))
    refs = spark.createDataFrame([("dark", "refs/0"), ("flat", "refs/1")], "reference string, entry string")
    named = listings.reference_files(refs, e.select("path", "folder", "name"))
    stack = tiles_from_array_column(e, "vec_id", "embedding", 8, 8, F.col("path"), 5)
    made = [averaged(aggregates.load_reference(named, stack, name)).select(F.lit(name).alias("reference"), "*") for name in ("dark", "flat")]
    return made[0].unionByName(made[1])


@query(
    f"WITH {PX} SELECT 'a' AS part, frame_no, y, x, round(v, 6) + 0.0 AS value FROM px WHERE frame_no < 100 UNION ALL SELECT 'b', "
    f"frame_no, y, x, round(v, 6) + 0.0 FROM px WHERE frame_no >= 100"
)
def q_concat_references(spark, sf_dir):
    df = emb(spark, sf_dir).df
    a, b = df.where("frame_no < 100"), df.where("frame_no >= 100").withColumn("frame_no", F.col("frame_no") - 100)
    both = vtk.union_frames([a, b])
    return both.select(F.when(F.col("frame_no") < 100, "a").otherwise("b").alias("part"), "frame_no", "y", "x", r6("value").alias("value"))


@query(f"WITH {PX} SELECT min(v) AS low, max(v) AS high FROM px")
def q_value_range(spark, sf_dir):
    return aggregates.value_range(emb_tiles(spark, sf_dir).df)


@query(
    f"WITH {PX} SELECT frame_no, min(v) AS min, max(v) AS max, round(coalesce(quantile_cont(v, 0.001) FILTER (y % 4 = 0 AND x % 4 = 0), "
    f"min(v)), 6) + 0.0 AS low, round(coalesce(quantile_cont(v, 0.999) FILTER (y % 4 = 0 AND x % 4 = 0), max(v)), 6) + 0.0 AS high FROM "
    f"px GROUP BY 1"
)
def q_frame_stats(spark, sf_dir):
    return aggregates.frame_stats(emb_tiles(spark, sf_dir).df).select("frame_no", "min", "max", r6("low").alias("low"), r6("high").alias("high"))


@query(
    f"WITH {PX}, e AS (SELECT frame_no, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), c AS (SELECT frame_no, CAST(least(floor((v - "
    f"lo) / (hi - lo) * 16), 15) AS INTEGER) AS bin, count(*) AS n FROM px JOIN e USING (frame_no) GROUP BY 1, 2) SELECT e.frame_no, "
    f"CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM e CROSS JOIN unnest(range(16)) t(b) LEFT JOIN c ON c.frame_no = e.frame_no "
    f"AND c.bin = b"
)
def q_histogram(spark, sf_dir):
    return aggregates.histogram(emb_tiles(spark, sf_dir).df, 16).select("frame_no", "bin", "n")


@query(
    f"WITH {PX}, a AS (SELECT frame_no, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM px WHERE y < 7 GROUP BY 1, 2, 3) SELECT frame_no, "
    f"CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) + 0.0 AS value FROM a GROUP BY 1, 2, 3"
)
def q_pyramid_level(spark, sf_dir):
    odd = geometry.crop(emb_tiles(spark, sf_dir), 0, 0, 7, 8)
    return out(tile_stats.pyramid_level(tile_stats.pyramid_level(odd)).df)


TILED = (
    "count(*) AS n, CAST(max(y) - min(y) + 1 AS INTEGER) AS h, CAST(max(x) - min(x) + 1 AS INTEGER) AS w, round(avg(v), 6) + 0.0 AS "
    "mean, string_agg(CAST(CAST(round_even(v * 1000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY y, x) AS pixels"
)


@query(f"WITH {PX} SELECT frame_no, CAST(y // 5 AS INTEGER) AS ty, CAST(x // 5 AS INTEGER) AS tx, {TILED} FROM px GROUP BY 1, 2, 3")
def q_tile_frames(spark, sf_dir):
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v) / F.size("pixels")
    said = F.array_join(F.transform("pixels", lambda v: F.rint(v * 1000).cast("long").cast("string")), ",")
    return emb_tiles(spark, sf_dir).df.select(
        "frame_no", "ty", "tx", F.size("pixels").cast("long").alias("n"), "h", "w", r6(mean).alias("mean"), said.alias("pixels"),
    )


@query(f"WITH {NAMES} SELECT 'scan_' || (k % 3) || '_*.tif' AS pattern, count(*) AS n, arg_min(name, k) AS first FROM n GROUP BY 1 HAVING count(*) >= 2")
def q_find_sequences(spark, sf_dir):
    return aggregates.find_sequences(names(spark, sf_dir))


# --- conversion and sinks --------------------------------------------------------------------------------------------


@query(point("CAST(v AS FLOAT)::DOUBLE"))
def q_convert_exact(spark, sf_dir):
    df = pointwise(emb(spark, sf_dir).df, fn.cast_dtype("float32"))
    return out(convert.convert_exact(df, "float32", "float64"))


SCALED = (
    f"WITH {PX}, e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 65535.0::DOUBLE AS s FROM px), c AS (SELECT frame_no, y, x, "
    f"CAST(round_even(least(greatest((v - lo) / s, 0), 65535), 0) AS BIGINT) AS value, lo, s, v FROM px, e)"
)


@query(f"{SCALED} SELECT frame_no, y, x, value, false AS clipped FROM c")
def q_convert_scaled(spark, sf_dir):
    return convert.convert_scaled(emb(spark, sf_dir).df, "uint16").select("frame_no", "y", "x", "value", "clipped")


@query(f"{SCALED} SELECT frame_no, y, x, round(lo + value * s, 6) + 0.0 AS value FROM c")
def q_recover_values(spark, sf_dir):
    return out(convert.recover_values(convert.convert_scaled(emb(spark, sf_dir).df, "uint16")))


def scratch(spark: SparkSession) -> str:
    """A new path, with its store, in the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


@query(
    f"WITH {PX} SELECT 'time' AS axis, 'float32' AS dtype, 25.0::DOUBLE AS energy, (SELECT count(*) FROM embeddings) AS frames, "
    f"frame_no, y, x, round(v, 6) + 0.0 AS value FROM px"
)
def q_write_frames(spark, sf_dir):
    stack = emb_tiles(spark, sf_dir)
    told = stack.with_(stack.df, axes=("time", "y", "x"), counts=(_frames(spark, sf_dir),), dtype="float32", metadata={"energy_kev": 25.0})
    path = scratch(spark)
    writers.write_frames(told, path)
    back = writers.read_frames(spark, path)
    said = [F.lit(back.axes[0]).alias("axis"), F.lit(back.dtype).alias("dtype"), F.lit(back.metadata["energy_kev"]).alias("energy")]
    return out(back.df).select(*said, F.lit(back.counts[0]).cast("long").alias("frames"), "frame_no", "y", "x", "value")


@query("SELECT 'r1' AS run_id, 'embeddings' AS source, count(*) AS frames FROM embeddings")
def q_run_record(spark, sf_dir):
    n = _frames(spark, sf_dir)
    r = writers.run_record(spark, "r1", "embeddings", (0, n, 1), "float32", None, None, Pipeline([Step("invert")]).to_yaml())
    return r.select("run_id", "source", F.regexp_extract("frames", r"stop: (\d+)", 1).cast("long").alias("frames"))


# --- neighbourhoods --------------------------------------------------------------------------------------------------

MIRROR = "CASE WHEN {0} < 0 THEN -1 - {0} WHEN {0} > 7 THEN 15 - {0} ELSE {0} END"


def _around(r: int) -> str:
    return (
        f"WITH {PX}, o AS (SELECT dy, dx FROM unnest(range(-{r}, {r} + 1)) a(dy), unnest(range(-{r}, {r} + 1)) b(dx)), "
        "n AS (SELECT p.frame_no, p.y, p.x, dy, dx, q.v FROM px p CROSS JOIN o JOIN px q "
        f"ON q.frame_no = p.frame_no AND q.y = {MIRROR.format('(p.y + dy)')} AND q.x = {MIRROR.format('(p.x + dx)')})"
    )


@query(
    f"WITH {PX} SELECT frame_no, y, x, round((w - quantile_cont(v, 0.1)) / (quantile_cont(v, 0.9) - quantile_cont(v, 0.1)), 6) + 0.0 AS value "
    "FROM (SELECT a.frame_no, a.y, a.x, a.v AS w, b.v FROM px a JOIN px b USING (frame_no)) GROUP BY frame_no, y, x, w"
)
def q_normalise(spark, sf_dir):
    return out(aggregates.normalise(emb_tiles(spark, sf_dir).df, 10, 90))


@query(f"{_around(1)} SELECT frame_no, y, x, round(quantile_cont(v, 0.5), 6) + 0.0 AS value FROM n GROUP BY 1, 2, 3")
def q_median_filter(spark, sf_dir):
    return out(neighbourhood.median_filter(emb_tiles(spark, sf_dir), 3).df)


@query(
    f"{_around(4)} SELECT frame_no, y, x, round(sum(v * ({neighbourhood.gaussian_weights(1.0)!r}::DOUBLE[])[dy + 5] * "
    f"({neighbourhood.gaussian_weights(1.0)!r}::DOUBLE[])[dx + 5]), 6) + 0.0 AS value FROM n GROUP BY 1, 2, 3"
)
def q_gaussian_filter(spark, sf_dir):
    return out(neighbourhood.gaussian_filter(emb_tiles(spark, sf_dir), 1.0).df)


@query(
    f"WITH {PX}, o AS (SELECT dy, dx, 2.0 - sqrt(4.0 - dy * dy - dx * dx) AS up FROM unnest(range(-2, 3)) a(dy), unnest(range(-2, 3)) "
    f"b(dx) WHERE dy * dy + dx * dx <= 4) SELECT p.frame_no, p.y, p.x, round(any_value(p.v) - min(q.v + up), 6) + 0.0 AS value FROM px "
    f"p CROSS JOIN o JOIN px q ON q.frame_no = p.frame_no AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3"
)
def q_rolling_ball(spark, sf_dir):
    return out(neighbourhood.rolling_ball(emb_tiles(spark, sf_dir), 2.0).df)


@query(
    f"WITH {PX}, a AS (SELECT i AS p, {MIRROR.format('i')} AS s, t FROM unnest(range(-1, 9)) u(i), unnest(range(2)) w(t) WHERE i "
    f"BETWEEN t * 5 - 1 AND least(t * 5 + 5, 8)) SELECT frame_no, CAST(ay.t AS INTEGER) AS ty, CAST(ax.t AS INTEGER) AS tx, count(*) AS "
    f"n, round(sum(v), 6) + 0.0 AS total FROM px JOIN a ay ON ay.s = y JOIN a ax ON ax.s = x GROUP BY 1, 2, 3"
)
def q_halo_tiles(spark, sf_dir):
    t = neighbourhood.halo_tiles(emb(spark, sf_dir), 1, 5)
    return t.groupBy("frame_no", "ty", "tx").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS DOUBLE) / 8 END AS seconds FROM events")
def q_parse_time_title(spark, sf_dir):
    i = F.col("event_id")
    title = F.when(i % 3 == 0, F.concat(F.lit("step "), i.cast("string"))).otherwise(F.concat(F.lit("t = "), (i / 8).cast("string"), F.lit(" s")))
    return table(spark, sf_dir, "events").select("event_id", scalars.parse_time_title(title).alias("seconds"))


@query(f"WITH {NAMES} SELECT name, 'scan_' || (k % 3) || '_*.tif' AS pattern FROM n")
def q_sequence_pattern(spark, sf_dir):
    return names(spark, sf_dir).select("name", scalars.sequence_pattern(F.col("name")).alias("pattern"))


@query(f"WITH {NAMES} SELECT name, name GLOB 'scan_[02]_?5*.tif' AS matches FROM n")
def q_glob_match(spark, sf_dir):
    return names(spark, sf_dir).select("name", scalars.glob_match(F.col("name"), "scan_[02]_?5*.tif").alias("matches"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/' || page_id WHEN 1 THEN 'b/c' || page_id END AS path FROM pages")
def q_normalise_path(spark, sf_dir):
    p = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("./a//"), p)).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("b\\.\\c"), p, F.lit("/")),
    ).otherwise(F.concat(F.lit("a/../"), p))
    return table(spark, sf_dir, "pages").select("page_id", scalars.normalise_path(raw).alias("path"))


@query(f"WITH {PAGES} SELECT path, CASE WHEN folder = 'site/3' THEN name ELSE path END AS relative FROM f")
def q_relative_path(spark, sf_dir):
    return pages(spark, sf_dir).select("path", scalars.relative_path(F.col("path"), F.lit("site/3")).alias("relative"))


@query(
    f"WITH {PAGES} SELECT path, CASE page_id % 4 WHEN 0 THEN '.tif' WHEN 1 THEN '.vtk' WHEN 2 THEN '.txt' ELSE '' END AS extension, "
    f"page_id % 4 < 2 AS openable FROM f"
)
def q_extension(spark, sf_dir):
    return pages(spark, sf_dir).select("path", scalars.extension(F.col("path")).alias("extension"), scalars.openable(F.col("path")).alias("openable"))


@query(
    "SELECT event_id, CAST(event_id // 35 % 50 AS INTEGER) AS a, CAST(event_id // 7 % 5 AS INTEGER) AS b, CAST(event_id % 7 AS "
    "INTEGER) AS c, event_id % 1750 AS back FROM events"
)
def q_frame_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", frame_index(F.col("event_id"), (50, 5, 7)).alias("i"))
    back = frame_rank([F.col("i")[k] for k in range(3)], (50, 5, 7))
    return e.select("event_id", *[F.col("i")[k].alias(n) for k, n in enumerate("abc")], back.alias("back"))


@query("SELECT event_id, CASE WHEN m < 13 THEN m ELSE 25 - m END AS i FROM (SELECT event_id, (((event_id - 500) % 26) + 26) % 26 AS m FROM events)")
def q_reflect_index(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.reflect_index(F.col("event_id") - 500, 13).alias("i"))


@query(
    "SELECT event_id, "
    "'{\"a\":' || (event_id % 5) || ',\"b\":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE (event_id % 3) || '.5' END || '}' AS json "
    "FROM events"
)
def q_json_metadata(spark, sf_dir):
    i = F.col("event_id")
    b = F.when(i % 4 == 0, F.lit(float("inf"))).otherwise((i % 3) + 0.5)
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.json_metadata(F.struct((i % 5).alias("a"), scalars.finite(b).alias("b"))).alias("json"),
    )


# --- user functions and pipelines ------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT frame_no, y, x, round(sum(v) OVER (PARTITION BY frame_no, y ORDER BY x), 6) + 0.0 AS value FROM px")
def q_map_frames(spark, sf_dir):
    return out(convert.map_frames(emb(spark, sf_dir), lambda a: np.cumsum(a, axis=1)).df)


@query(point("v * 3.0 + 1.0"))
def q_register_operation(spark, sf_dir):
    register("linear", Param("a", "float", 1.0), Param("b", "float", 0.0))(
        lambda frames, a, b: frames.with_(pointwise(frames.df, lambda v: v * a + b)),
    )
    try:
        return out(Pipeline([Step("linear", {"a": 3.0, "b": 1.0})])(emb(spark, sf_dir)).df)
    finally:
        del OPERATIONS["linear"]


@query(point("least(greatest(1.0 - v, 0.9), 1.1)", "y BETWEEN 1 AND 6", "7 - x", "y - 1"))
def q_frame_pipeline(spark, sf_dir):
    steps_ = [
        Step("invert", {"low": 0, "high": 1}), Step("crop", {"top": 1, "height": 6}), Step("median", {}, False),
        Step("rotate", {"angle": "270"}), Step("clip", {"low": 0.9, "high": 1.1}),
    ]
    return out(Pipeline(steps_)(emb_tiles(spark, sf_dir)).df)


RESOLVED = SQL["flat_field"].replace(
    "CASE WHEN f - d > 0 THEN (v - d) / (f - d) ELSE 0 END", "1.0 - CASE WHEN f - d > 0 THEN (v - d) / (f - d) ELSE 0 END",
)


@query(RESOLVED)
def q_pipeline_resolve(spark, sf_dir):
    load = lambda name: aggregates.average_frames(labelled(spark, sf_dir, f"label = {['dark', 'flat'].index(name)}").df)
    p = Pipeline([Step("flat_field", {"dark": "dark", "flat": "flat"}), Step("invert", {"high": 1.0})]).resolve(load)
    return out(p(labelled(spark, sf_dir, "label > 1")).df)


@query(point("CASE WHEN 65535.0 - v >= 65535.0 THEN 1.0 ELSE 0.0 END"))
def q_pipeline_yaml(spark, sf_dir):
    text = Pipeline([Step("invert"), Step("flip", {}, False), Step("threshold", {"value": 65535.0})]).to_yaml()
    again = Pipeline.from_yaml(text)
    assert again.to_yaml() == text
    return out(again(emb_tiles(spark, sf_dir)).df)


@query(
    f"WITH {PX}, k AS (SELECT frame_no // 2 AS frame_no, 7 - y AS y, x, v FROM px WHERE frame_no % 2 = 0), e AS (SELECT min(v) AS lo, "
    f"(max(v) - min(v)) / 255.0::DOUBLE AS s FROM k) SELECT frame_no, CAST(y AS INTEGER) AS y, x, round_even(least(greatest((v - lo) / "
    f"s, 0), 255), 0) + 0.0 AS value FROM k, e"
)
def q_run_pipeline(spark, sf_dir):
    p = Pipeline([Step("flip", {"direction": "vertical"})])
    stored = run_pipeline(emb_tiles(spark, sf_dir), p, scratch(spark), "r1", "embeddings", _frames(spark, sf_dir), (None, None, 2), "uint8")
    return to_pixels(stored).select("frame_no", "y", "x", (F.col("value") + 0.0).alias("value"))


@query(
    f"WITH {STEPS} SELECT name, CASE WHEN k % 10 = 0 THEN 'notes' ELSE 'projections' END AS role, CASE WHEN k % 10 <> 0 THEN CAST(k % "
    f"40 AS INTEGER) END AS step FROM t WHERE k % 10 = 0 OR k % 40 IN (5, 15, 21)"
)
def q_experiment_scan(spark, sf_dir):
    return experiment_scan({"projections": "run_*.tif", "notes": "notes*.txt"}, [5, 15, 21], steps(spark, sf_dir))
