"""Colour tables as DataFrames (cmap, index, r, g, b). Other tables are data: see `read_color_tables`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import FrameError

# Control points of the public-domain "fire" table.
FIRE = (
    (
        0, 0, 1, 25, 49, 73, 98, 122, 146, 162, 173, 184, 195, 207, 217, 229, 240, 252, 255, 255, 255, 255, 255, 255, 255, 255,
        255, 255, 255, 255, 255, 255,
    ),
    (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 14, 35, 57, 79, 101, 117, 133, 147, 161, 175, 190, 205, 219, 234, 248, 255, 255, 255, 255),
    (0, 61, 96, 130, 165, 192, 220, 227, 210, 181, 151, 122, 93, 64, 35, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 35, 98, 160, 223, 255),
)


def control_table(spark: SparkSession, name: str, points: tuple[tuple[int, ...], ...]) -> DataFrame:
    """256 rows between control points, straight lines cut off to whole numbers; the last points are held."""
    n = len(points[0])
    p = F.col("id") * F.lit(n / 256)
    low = F.floor(p).cast("int")
    part = p - low

    def channel(values: tuple[int, ...]):
        a = F.array(*[F.lit(float(v)) for v in values])
        return F.floor((1 - part) * F.get(a, low) + part * F.get(a, F.least(low + 1, F.lit(n - 1)))).cast("int")

    return spark.range(256).select(
        F.lit(name).alias("cmap"), F.col("id").cast("int").alias("index"),
        *[channel(v).alias(c) for c, v in zip("rgb", points, strict=True)],
    )


def color_tables(spark: SparkSession) -> DataFrame:
    """grey, grey_inverted and fire."""
    i = F.col("id").cast("int")
    grey = spark.range(256).select(F.lit("grey").alias("cmap"), i.alias("index"), *[i.alias(c) for c in "rgb"])
    inverted = spark.range(256).select(F.lit("grey_inverted").alias("cmap"), i.alias("index"), *[(255 - i).alias(c) for c in "rgb"])
    return grey.unionByName(inverted).unionByName(control_table(spark, "fire", FIRE))


def read_color_tables(spark: SparkSession, path: str) -> DataFrame:
    """Colour maps that are data: a CSV file with a header, or a Parquet table, of cmap, index, r, g, b (256 rows a map), beside
    the built-in ones. A map that lacks an index, has one twice or a colour beyond 0 to 255 is refused by name."""
    given = spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    table = given.select(F.col("cmap").cast("string").alias("cmap"), *[F.col(c).cast("int").alias(c) for c in ("index", "r", "g", "b")])
    right = F.col("index").between(0, 255) & F.col("r").between(0, 255) & F.col("g").between(0, 255) & F.col("b").between(0, 255)
    by = table.groupBy("cmap").agg(F.count("*").alias("n"), F.count_distinct("index").alias("different"), F.count(F.when(right, 1)).alias("right"))
    bad = by.where("n <> 256 or different <> 256 or right <> 256").first()
    if bad:
        raise FrameError(f"colour map {bad['cmap']!r} is not 256 colours of 0 to 255")
    built = color_tables(spark)
    return built.join(table.select("cmap").distinct(), "cmap", "left_anti").unionByName(table)
