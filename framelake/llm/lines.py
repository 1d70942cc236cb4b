"""Line dedup in column expressions only: a segment-partition edit join over all different lines.

The whole job (`whole`, the default) takes exact repeats of lines of any length but empty ones, and links lines of
MIN_CHARS characters or more by `max_edits` edits. Without `whole`, shorter lines stay and lines are linked by one edit for
each 20 characters of the shorter one, `max_edits` at most.

Two lines within that many edits agree on one of edits + 1 segments of the shorter one. Segments are indexed by length and
number; longer lines probe with the few substrings that an alignment allows. A segment's index is first reduced to one row,
so that a probe meets one row at most. Only what hits goes on. A segment that more than BUCKET different lines have in common
is refined instead of paired: what is left of a line beside the segment holds the edits, is cut into parts again, and a
finer key covers all but the parts that may differ. Refining ends where lines of one key can differ in no more characters
than edits are allowed: there they are linked to one of them. So the pairs to verify grow with the lines, not with the
square of a group. Candidates are verified by a banded edit distance: Spark's compiled one. `within_edits` is the
bit-parallel form, whose column of 2 * max_edits + 1 cells is one integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph

MIN_CHARS = 20
#: Different lines of a segment that are paired with every line that probes it; more of them are refined.
BUCKET = 64
#: A line is frequent if more than one in so many lines equals it; so there are fewer than this many frequent lines.
FREQUENT = 10_000
#: Characters whose counts make a line's signature; an edit changes two of them by one at most.
SIGNED = "etaoinsrhldcumfpgwybvk ."


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segment(length: Column, i: Column, parts: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of `parts`; the last ones have a character more."""
    size, more = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    longer = F.greatest(i - parts + more, F.lit(0))
    return i * size + longer + 1, size + (i >= parts - more).cast("int")


def edits_for(length: Column, max_edits: int) -> Column:
    """Edits that a line of this length may differ by."""
    return F.least(F.floor(length / MIN_CHARS), F.lit(max_edits)).cast("int")


def signature(line: Column) -> Column:
    """An integer whose bits differ in 2 * edits places at most between lines within that many edits.

    Two bits for each character: its count modulo 4 in Gray code, so that counts which differ by one differ in one bit."""
    code = lambda c: F.element_at(F.array(*map(F.lit, (0, 1, 3, 2))), (F.length(line) - F.length(F.replace(line, F.lit(c)))) % 4 + 1)
    return sum((code(c).cast("long") * (1 << 2 * i) for i, c in enumerate(SIGNED)), F.lit(0).cast("long"))


def _places(max_edits: int, least: int | None) -> list[tuple[int, int, int, int]]:
    """(edits, characters less than the line, segment, offset) of every probe; those of no characters less and no offset
    are a line's own segments."""
    by_edits = range(1 if least is None else max_edits, max_edits + 1)
    return [(e, less, i, off) for e in by_edits for less in range(e + 1) for i in range(e + 1) for off in range(
        max(-i, less - (e - i)), min(i, less + (e - i)) + 1,
    )]


def _place_array(max_edits: int, least: int | None, own: bool = False) -> Column:
    """The places as a constant array of structs with their numbers; only those of a line's own segments with `own`."""
    return F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in zip(("place", "edits", "less", "i", "off"), (no, *p), strict=True)])
        for no, p in enumerate(_places(max_edits, least)) if not own or p[1] == p[3] == 0
    ])


def line_keys(lines: DataFrame, max_edits: int, least: int | None = None, own: bool = False) -> DataFrame:
    """place, key, a of the lines (line, a) at every place where a line's length has a key.

    By these keys a line finds lines of its length and somewhat shorter ones (multi-match-aware substrings); those of its own
    segments (`own`) are the index. least: characters from which all edits are allowed; None for one edit for each 20
    characters. Each place is a row before it is keyed, so that one key is compiled for all places: a method of all keys of
    a line has more than the 8,000 bytes up to which the JVM compiles methods, and would be interpreted. Lines of one-byte
    characters are cut as binary, which takes no walk over the characters; equal parts have equal keys either way."""
    chars, n, part = F.col("chars"), F.col("n"), (F.col("start"), F.col("size"))
    rows = lines.select("line", "a", F.length("line").alias("chars"))
    rows = rows.withColumn("bytes", F.when(F.octet_length("line") == chars, F.col("line").cast("binary")))
    rows = rows.withColumn("p", F.explode(_place_array(max_edits, least, own))).withColumn("n", chars - F.col("p.less"))
    start, size = segment(n, F.col("p.i"), F.col("p.edits") + 1)
    rows = rows.withColumns({"start": start + F.col("p.off"), "size": size})
    rows = rows.where(edits_for(n, max_edits) == F.col("p.edits") if least is None else n >= least)
    rows = rows.where((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= chars))
    cut = F.when(F.col("bytes").isNotNull(), F.substr("bytes", *part)).otherwise(F.substr("line", *part).cast("binary"))
    return rows.select("p.place", F.xxhash64(n, F.col("p.i"), cut).alias("key"), "a")


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings, both longer than `edits`, is at most `edits` and what their lengths allow.

    A column of the distance matrix is kept in a band around the diagonal as two bit vectors of its vertical steps."""
    width = 2 * edits + 1
    mask = (1 << width) - 1
    no = lambda x: F.lit(mask) - x.bitwiseAND(F.lit(mask))
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1))

    def distance(given: Column) -> Column:
        m, n = given["m"], given["n"]

        def step(s: Column, j: Column) -> Column:
            def column(here: Column) -> Column:
                pm = sum((F.when(F.get(given["chars"], j + (k - 1)) == here, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)), F.lit(0))
                return let(pm, vertical)

            def vertical(pm: Column) -> Column:
                d0 = (pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(pm).bitwiseOR(s["vn"]).bitwiseAND(F.lit(mask))
                return let(
                    d0,
                    lambda d: let(
                        F.struct(
                            d.alias("d0"), s["vn"].bitwiseOR(no(d.bitwiseOR(s["vp"]))).alias("hp"),
                            d.bitwiseAND(s["vp"]).alias("hn"), F.shiftright(d, 1).alias("x"),
                        ),
                        settle,
                    ),
                )

            def settle(h: Column) -> Column:
                row = F.greatest(m - j + edits, F.lit(0))
                d = F.when(j <= m - edits, s["d"] + 1 - bit(h["d0"], F.lit(width - 1))).otherwise(s["d"] + bit(h["hp"], row) - bit(h["hn"], row))
                return F.struct(h["hn"].bitwiseOR(no(h["x"].bitwiseOR(h["hp"]))).alias("vp"), h["x"].bitwiseAND(h["hp"]).alias("vn"), d.alias("d"))

            return let(F.get(given["text"], j - 1), column)

        start = F.struct(F.lit((mask << edits) & mask).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
        done = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"])
        return (F.abs(m - n) <= edits) & (done <= edits_for(F.least(m, n), edits))

    chars = F.concat(F.array_repeat(F.lit(""), edits), F.split(a, ""), F.array_repeat(F.lit(""), width + edits))
    return let(F.struct(chars.alias("chars"), F.split(b, "").alias("text"), F.length(a).alias("m"), F.length(b).alias("n")), distance)


# --- segments that many lines have in common --------------------------------------------------------------------------
#
# A row of a bucket is a line that agrees with the others outside of two gaps of an indexed line of n characters: gap 1
# [lo1, hi1) with at most k1 edits and gap 2 [lo2, hi2) with at most k2. What lies between the gaps is shifted by s1 in a
# probing line, what follows by `less`. Where there is one gap, gap 2 is empty and begins where gap 1 ends.

STATE = ("lo1", "hi1", "k1", "lo2", "hi2", "k2", "s1", "less", "own")
#: Parts of a gap that holds one edit, and of one that holds two.
PARTS = {1: 2, 2: 3}


def _gaps(rows: DataFrame, max_edits: int, least: int | None) -> DataFrame:
    """rows (y, place, line) with the gaps that their segments leave; rows of more edits than two gaps can hold have none."""
    rows = rows.withColumn("p", F.get(_place_array(max_edits, least), F.col("place")))
    n = F.length("line") - F.col("p.less")
    start, size = segment(n, F.col("p.i"), F.col("p.edits") + 1)
    rows = rows.withColumns({"n": n, "s0": start - 1, "e0": start - 1 + size})
    first, last = F.col("p.i") == 0, F.col("p.i") == F.col("p.edits")
    pick = lambda a, b, c: F.when(first, a).when(last, b).otherwise(c).cast("int")
    zero, e, i, less = F.lit(0), F.col("p.edits"), F.col("p.i"), F.col("p.less")
    return rows.select(
        "key", "y", "line",
        pick(F.col("e0"), zero, zero).alias("lo1"), pick(F.col("n"), F.col("s0"), F.col("s0")).alias("hi1"), pick(e, e, i).alias("k1"),
        pick(
            F.col("n"), F.col("s0"), F.col("e0"),
        ).alias("lo2"), pick(F.col("n"), F.col("s0"), F.col("n")).alias("hi2"), pick(zero, zero, e - i).alias("k2"),
        pick(less, less, F.col("p.off")).alias("s1"), less.alias("less"), ((less == 0) & (F.col("p.off") == 0)).alias("own"),
    )


def _finer(rows: DataFrame) -> DataFrame:
    """The rows with their gaps cut into parts: one for every choice of the parts that may hold the edits."""
    at = lambda g, j, k=1: (F.col(f"lo{g}") + F.floor((F.col(f"hi{g}") - F.col(f"lo{g}")) * j / PARTS[k])).cast("int")
    col, out = F.col, []

    def child(when, lo1, hi1, k1, lo2, hi2, k2, s1, own):
        given = [x.cast("int") for x in (lo1, hi1, k1, lo2, hi2, k2, s1)]
        out.append(F.when(when, F.struct(*[x.alias(k) for x, k in zip(given, STATE, strict=False)], own.alias("own"))))

    one, two, none = (col("k2") == 0) & (col("k1") == 1), (col("k2") == 0) & (col("k1") == 2), F.lit(0)
    for a in range(PARTS[1]):
        child(one & (at(1, a) < at(1, a + 1)), at(1, a), at(1, a + 1), F.lit(1), at(1, a + 1), at(1, a + 1), none, col("less"), col("own"))
    for a in range(PARTS[2] - 1):
        child(
            two & (at(1, a, 2) < at(1, a + 2, 2)), at(1, a, 2), at(1, a + 2, 2), F.lit(2), at(1, a + 2, 2), at(1, a + 2, 2), none,
            col("less"), col("own"),
        )
        for b in range(a + 2, PARTS[2]):
            for s in (-1, 0, 1):
                ok = two & (at(1, a, 2) < at(1, a + 1, 2)) & (at(1, b, 2) < at(1, b + 1, 2)) & (F.abs(col("less") - s) <= 1)
                child(ok, at(1, a, 2), at(1, a + 1, 2), F.lit(1), at(1, b, 2), at(1, b + 1, 2), F.lit(1), F.lit(s), col("own") & F.lit(s == 0))
    wide = {g: col(f"hi{g}") - col(f"lo{g}") > 1 for g in (1, 2)}
    ends = lambda g, j: F.when(wide[g], at(g, j)).otherwise(col(f"lo{g}") if j == 0 else col(f"hi{g}"))
    for a in range(PARTS[1]):
        for b in range(PARTS[1]):
            ok = (col("k2") > 0) & (wide[1] | F.lit(a == 0)) & (wide[2] | F.lit(b == 0))
            ok = ok & (~wide[1] | (at(1, a) < at(1, a + 1))) & (~wide[2] | (at(2, b) < at(2, b + 1)))
            child(ok, ends(1, a), ends(1, a + 1), col("k1"), ends(2, b), ends(2, b + 1), col("k2"), col("s1"), col("own"))
    rows = rows.select("y", "line", "less", F.explode(F.array(*out)).alias("x")).where("x is not null").select("y", "line", "less", "x.*")
    rows = rows.where("hi1 + s1 >= lo1 and hi2 + less >= lo2 + s1 and lo2 >= hi1")
    part = lambda a, b: F.substr("line", a + 1, F.greatest(b - a, F.lit(0)))
    n = F.length("line") - col("less")
    clean = [part(F.lit(0), col("lo1")), part(col("hi1") + col("s1"), col("lo2") + col("s1")), part(col("hi2") + col("less"), F.length("line"))]
    return rows.withColumn("key", F.xxhash64(n, "lo1", "hi1", "lo2", "hi2", *clean)).drop("line")


def _bucket_pairs(rows: DataFrame, max_edits: int) -> DataFrame:
    """x < y of every indexed line and every other line of a bucket, but those whose signatures show more than max_edits edits.

    rows: key, y, own, s (signature)."""
    index = rows.where("own").select("key", F.col("y").alias("x"), F.col("s").alias("sx"))
    alike = F.bit_count(F.col("sx").bitwiseXOR(F.col("s"))) <= 2 * max_edits
    return rows.join(index, "key").where("x <> y").where(alike).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _refined_pairs(hot: DataFrame, texts: DataFrame, max_edits: int, least: int | None) -> list[DataFrame]:
    """Pairs of lines of hot buckets (key, y, place) by finer keys, round after round."""
    lines = texts.select(F.col("a").alias("y"), "line", "s")
    rows, pairs = _gaps(hot.join(lines.drop("s"), "y"), max_edits, least).drop("line"), []
    while True:
        rows = _finer(rows.drop("key").join(lines.drop("s"), "y"))
        rows = graph.cut(rows.dropDuplicates(["key", "y", "own"]))
        size = rows.groupBy("key").agg(
            F.count(F.when(F.col("own"), 1)).alias("m"), F.count("*").alias("all"),
            F.min(F.when(F.col("own"), F.col("y"))).alias("lead"),
            F.max((F.col("hi1") - F.col("lo1") <= F.col("k1")) & (F.col("hi2") - F.col("lo2") <= F.col("k2"))).alias("last"),
        )
        size = graph.cut(size.where("m > 0 and all > 1"))
        rows = rows.join(size, "key")
        pairs.append(rows.where("last and m > {0} and y <> lead".format(BUCKET)).select(
            F.least("lead", "y").alias("x"), F.greatest("lead", "y").alias("y"),
        ))
        few = rows.where(f"m <= {BUCKET}").select("key", "y", "own").join(lines.select("y", "s"), "y")
        pairs.append(_bucket_pairs(few, max_edits))
        rows = graph.cut(rows.where(f"m > {BUCKET} and not last").drop("m", "all", "lead", "last"))
        if not rows.limit(1).count():
            return pairs


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), line of every line of every text; a null text has none."""
    return docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"),
    )


def _ids(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"a": F.xxhash64("line"), "b": F.xxhash64(F.lit(1), "line")})


def near_lines(docs: DataFrame, firsts: DataFrame, max_edits: int, least: int | None = None) -> DataFrame:
    """node, component of different lines that are linked by edit distance.

    firsts: a, b, doc_id, pos, n of each line's first place and its repeats. least: characters from which all edits are
    allowed; None for one edit for each 20 characters. Lines that are not frequent give their keys wherever they stand; of
    the frequent ones, fewer than FREQUENT in all, only the first place does."""
    total = firsts.agg(F.sum("n")).first()[0] or 0
    often = firsts.where(F.col("n") * FREQUENT > total).where("n > 1").select(
        F.col("a").alias("fa"), F.col("doc_id").alias("fd"), F.col("pos").alias("fp"),
    )
    lines = _ids(line_table(docs.where("doc_id is not null"))).where(F.length("line") >= (MIN_CHARS if least is None else least))
    lines = lines.join(F.broadcast(often), F.col("a") == F.col("fa"), "left").where("fa is null or (doc_id = fd and pos = fp)")
    index = line_keys(lines, max_edits, least, own=True).groupBy("key").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    probes = line_keys(lines, max_edits, least).withColumnRenamed("a", "y")
    hits = graph.cut(probes.join(index.hint("shuffle_hash"), "key").where("low <> high or y <> low").distinct())
    single = hits.where("low = high").select(F.least("low", "y").alias("x"), F.greatest("low", "y").alias("y"))
    several = hits.where("low <> high").select("key", "y", "place")
    ids = graph.cut(single.select("x").union(single.select("y")).union(several.select("y")).distinct().withColumnRenamed("x", "a"))
    places = graph.cut(firsts.join(graph.small(ids), "a").select("a", "doc_id", "pos"))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).join(graph.small(places), "doc_id").select("a", F.get(F.split(F.col("text"), "\n", -1), F.col("pos")).alias("line"))
    texts = texts.where(F.xxhash64("line") == F.col("a")).dropDuplicates(["a"])  # rows of one doc_id may differ
    texts = graph.cut(texts.withColumn("s", signature(F.col("line"))))
    own = [no for no, p in enumerate(_places(max_edits, least)) if p[1] == p[3] == 0]
    several = several.withColumn("own", F.col("place").isin(own))
    # two gaps hold two edits at most
    wide = graph.cut(several.where("own").groupBy("key").agg(F.count("*").alias("m")).where(f"m > {BUCKET if max_edits <= 2 else 1 << 60}").select("key"))
    hot = several.join(graph.small(wide), "key", "left_semi")
    few = several.join(graph.small(wide), "key", "left_anti")
    found = [single, _bucket_pairs(few.join(texts.select(F.col("a").alias("y"), "s"), "y"), max_edits)]
    if wide.limit(1).count():
        found += _refined_pairs(hot, texts, max_edits, least)
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    pairs = graph.cut(pairs.distinct())
    both = pairs.join(
        texts.select(F.col("a").alias("x"), F.col("line").alias("lx")), "x",
    ).join(texts.select(F.col("a").alias("y"), F.col("line").alias("ly")), "y")
    # Spark's own banded distance is compiled; `within_edits` gives the same answers in interpreted lambdas
    off = F.levenshtein("lx", "ly", max_edits)
    near = (off >= 0) & (off <= (F.lit(max_edits) if least is not None else edits_for(F.least(F.length("lx"), F.length("ly")), max_edits)))
    return graph.components(both.where(near).select(F.col("x").alias("a"), F.col("y").alias("b")))


def kept_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """doc_id, pos, kept, exact, near of every line.

    Lines of at least `min_chars` characters that are equal or linked by edit distances of at most `max_edits` are a class;
    its first line (least doc_id, then position) is kept, the others go as exact copies of a line before them or as near
    ones. Shorter lines go as exact copies; only empty lines stay always. Without `whole`, shorter lines stay, and no more
    than one edit for each 20 characters links. docs: doc_id (integer), text,
    others ignored. Rows of one doc_id are one document, so a repeated row adds no lines; rows of null doc_id or text have no
    lines; an empty text has one empty line; texts and lines may be of any length; an empty table gives no rows.
    """
    chars = F.length("line")
    docs = docs.select("doc_id", "text")
    lines = graph.cut(_ids(line_table(docs.where("doc_id is not null"))).withColumns({
        "long_": chars >= (1 if whole else min_chars), "near_": chars >= min_chars,
    }).drop("line"))
    firsts = lines.where("long_").groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.first("near_").alias("near_"), F.count("*").alias("n"),
    )
    firsts = graph.cut(firsts.select("a", "b", "first.doc_id", "first.pos", "near_", "n"))
    cls = graph.cut(near_lines(
        docs, firsts.where("near_").drop("near_"), max_edits, min_chars if whole else None,
    ).select(F.col("node").alias("a"), "component"))
    members = firsts.select("a", "b", "doc_id", "pos").join(graph.small(cls), "a")
    leads = members.groupBy("component").agg(F.min(F.struct("doc_id", "pos")).alias("lead"))
    led = graph.cut(members.join(leads, "component").select(F.col("a").alias("la"), F.col("b").alias("lb"), "lead"))
    f = firsts.where("n > 1").select("a", "b", F.struct("doc_id", "pos").alias("first"))
    out = lines.where("long_").join(f, ["a", "b"], "left").join(graph.small(led), (F.col("a") == F.col("la")) & (F.col("b") == F.col("lb")), "left")
    here = F.struct("doc_id", "pos")
    exact = F.coalesce(here != F.col("first"), F.lit(False))
    near = ~exact & F.col("lead").isNotNull() & (F.coalesce("lead", here) != here)
    out = out.select("doc_id", "pos", (~exact & ~near).alias("kept"), exact.alias("exact"), near.alias("near"))
    short = lines.where("not long_").select("doc_id", "pos", F.lit(True).alias("kept"), F.lit(False).alias("exact"), F.lit(False).alias("near"))
    return out.unionByName(short)


def line_digest(docs: DataFrame, max_edits: int = 2, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near (lines that go) and kept_sha256 (positions that stay, comma-joined) of every document."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    by_doc = kept_lines(docs, max_edits, min_chars, whole).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), n("exact").alias("n_exact"), n("near").alias("n_near"),
        F.array_sort(F.collect_set(F.when(F.col("kept"), F.col("pos")))).alias("at"),
    )
    by_doc = by_doc.withColumn("kept_sha256", F.sha2(F.array_join("at", ","), 256)).drop("at")
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    zero = F.lit(0).cast("long")
    return rest.join(by_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_exact", zero).alias("n_exact"),
        F.coalesce("n_near", zero).alias("n_near"), F.coalesce("kept_sha256", F.sha2(F.lit(""), 256)).alias("kept_sha256"),
    )


def dedup_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = MIN_CHARS, whole: bool = True) -> DataFrame:
    """docs (all columns) with the lines that go taken out of the texts. Odd rows as in `kept_lines`; other columns may have any names."""
    at, gone = graph.unused(docs, "_id"), graph.unused(docs, "_gone")
    lost = kept_lines(docs, max_edits, min_chars, whole).where("not kept").groupBy(F.col("doc_id").alias(at)).agg(F.collect_set("pos").alias(gone))
    out = docs.join(lost, docs["doc_id"].cast("long") == lost[at], "left")
    text = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)).select(docs.columns)
