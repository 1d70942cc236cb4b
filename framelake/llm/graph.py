"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import ordering


#: Edges for each task of a round beyond the first few tasks, and nodes whose least neighbours are broadcast at most.
EDGES, FEW_TASKS, NODES = 50_000, 8, 200_000
#: Under this setting Spark removes a query's shuffle files at its end, and not when the driver next collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir (see `ordering.shared_folder`)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(ordering.shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared checkpoint folder, with their lineage cut. What was shuffled for them is removed."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(FREE, None)
    conf.set(FREE, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            conf.unset(FREE)
        else:
            conf.set(FREE, before)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """Broadcast a stored table of a few fixed-width columns behind a count of its rows; leave a longer one to a shuffle join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def components(edges: DataFrame) -> DataFrame:
    """Component of every node of an edge table.

    edges: columns a, b (long). Returns node, component (the least node that links reach). Loops and repeated edges are
    allowed, nulls are dropped, an empty table gives an empty table. Each round is two aggregations and two joins by
    key; no neighbour list is ever gathered in one task. A round has as many tasks as its edges need, and where there are few
    nodes, their least neighbours are broadcast, so that a round's cost is that of its edges and not of empty tasks.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut(e), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(2**40))).first()
        if now == before or now[0] == 0:
            break
        before = now
        tasks, held = FEW_TASKS + now[0] // EDGES, 2 * now[0] <= NODES
        low = lambda df: F.broadcast(df.coalesce(tasks)) if held else df  # noqa: E731, B023
        e = e.coalesce(tasks)
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low(least), "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = e if held else e.distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low(least), "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
        )).alias("x")).select("x.*").where("a <> b").distinct()
        e = cut(e.coalesce(tasks))
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b"), F.col("b"))).distinct().coalesce(FEW_TASKS + now[0] // EDGES)
