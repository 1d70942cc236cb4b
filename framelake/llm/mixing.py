"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import graph

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's draw that make a bucket; 16**3 buckets a source.
BUCKET_DIGITS = 3


def with_draw(docs: DataFrame, seed: str) -> DataFrame:
    """docs with _size (words of the text; null: 0) and _draw (hexadecimal digits that depend on seed and doc_id alone)."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": size, "_draw": F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))})


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with _rank (from 0) in a total order: ranks within range partitions plus the sizes of the partitions before."""
    held = graph.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    total, before = 0, []
    for part, n in sorted((r[0], r[1]) for r in held.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    if not before:
        return held.withColumn("_rank", F.lit(0).cast("long")).drop("_part")
    offset = F.element_at(F.create_map([F.lit(x) for pair in before for x in pair]), F.col("_part")) if len(before) < 100 else None
    if offset is None:
        held = held.join(df.sparkSession.createDataFrame(before, "_part int, _before long"), "_part")
        offset = F.col("_before")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + offset
    return held.withColumn("_rank", rank.cast("long")).drop("_part", "_before")


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources (size, weight) with target (double): share x all sizes by weight, none above cap x its size.

    What is cut off at a cap goes to the other sources by weight, until no target is above its cap: the level rises and the
    set of capped sources grows with every pass, so the passes end. Each pass is one aggregation that returns one row.
    """
    sources = sources.withColumn("_cap", F.lit(cap) * F.col("size"))
    budget = (sources.agg(F.sum("size")).first()[0] or 0) * share
    level_of, state = F.lit(-1.0), None
    while True:
        capped = F.col("_cap") <= level_of
        c, w, n = sources.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if state is not None and n == state:
            break
        c, w, state = c or 0.0, w or 0, n
        if not w:
            level_of = F.col("_cap")
            break
        level_of = F.col("weight") * F.lit(max(budget - c, 0.0)) / F.lit(float(w))
    return sources.withColumn("target", F.when(F.col("_cap") <= level_of, F.col("_cap")).otherwise(level_of).cast("double")).drop("_cap")


def mixing_plan(drawn: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each source: source, source_size, target, whole (repetitions of each document), cut (draw up to which a document has one more).

    drawn: source, _size, _draw (stored). The fractional repetition goes to documents in the order of their draws until
    their words come nearest to the rest of the target. Sums by bucket of draws find the bucket where that is; only that
    bucket's documents are put in order.
    """
    x = drawn.select("source", "_size", "_draw", F.substring("_draw", 1, BUCKET_DIGITS).alias("_bucket"))
    buckets = graph.cut(x.groupBy("source", "_bucket").agg(F.sum("_size").alias("n")))
    order = F.col("source").asc_nulls_last()
    sources = ranked(buckets.groupBy("source").agg(F.sum("n").alias("size")), order)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    filled = water_fill(graph.cut(sources.withColumn("weight", weight)), share, cap)
    filled = filled.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long"))
    filled = graph.cut(filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("size")))
    running = Window.partitionBy("source").orderBy("_bucket")
    edge = buckets.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    plan = filled.select(F.col("source").alias("_s"), "rest")
    edge = edge.join(plan, F.col("source").eqNullSafe(F.col("_s"))).where("before <= rest and rest < upto").select(
        F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "before", "rest",
    )
    inside = x.join(
        F.broadcast(edge) if filled.limit(20_001).count() <= 20_000 else edge,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")),
    )
    upto = F.sum("_size").over(Window.partitionBy("source").orderBy("_draw", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = inside.withColumn("_upto", F.col("before") + upto).where("_upto - _size / 2 <= rest")
    cuts = edge.select(F.col("_s").alias("_e"), "_b").join(
        near.groupBy(F.col("source").alias("_n")).agg(F.max("_draw").alias("_cut")), F.col("_e").eqNullSafe(F.col("_n")), "left",
    ).select("_e", F.coalesce("_cut", "_b").alias("cut"))
    out = filled.join(cuts, F.col("source").eqNullSafe(F.col("_e")), "left")
    return out.select("source", F.col("size").alias("source_size"), "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def with_repetitions(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """drawn with source_size, target and repetitions (0, 1, 2, ...) of each row."""
    p = plan.withColumnRenamed("source", "_source")
    p = F.broadcast(p) if p.limit(20_001).count() <= 20_000 else p
    out = drawn.join(p, F.col("source").eqNullSafe(F.col("_source")))
    return out.withColumn(
        "repetitions", F.col("whole") + ((F.col("_draw") <= F.col("cut")) & (F.col("_size") > 0)).cast("long"),
    ).drop("_source", "whole", "cut")


def mixture_table(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target (double) and taken words of every row of docs.

    docs: doc_id, text, source and any others. Sources by code point, null last, have the weights in turn; the mix is `share`
    times all words, no source beyond `cap` times its own. A null text has size 0; a source without words has target 0; rows
    that repeat a doc_id in a source have one draw and stay together as far as the target's edge; an empty table gives none.
    """
    drawn = graph.cut(with_draw(
        docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")),
        seed,
    ).drop("text"))
    out = with_repetitions(drawn, graph.cut(mixing_plan(drawn, weights, share, cap)))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("repetitions")).alias("taken"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mixture itself: the rows of docs (all columns, of any names), each as often as it is taken. Texts are not shuffled.

    Odd rows as in `mixture_table`; a document without words is repeated as often as its source is taken whole."""
    drawn = graph.cut(with_draw(docs.select("doc_id", "text", "source"), seed).drop("text"))
    plan = graph.cut(mixing_plan(drawn, weights, share, cap))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    out = with_repetitions(with_draw(whole, seed), plan)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("repetitions").cast("int")))).select("row.*")
