"""Secret scans in column expressions only: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a run of key-like characters. Its character class sets the window's entropy threshold; the entropy of each
window follows from the one before by the counts of the character that leaves and the one that enters. Spans are code-point
ranges, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: The lookbehinds only save attempts within a run: a leftmost match begins at a run's first character anyway.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: The characters of candidates, in the order of their counters.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counters of 5 bits (a window's counts are 20 at most) in a 64-bit word.
COUNTERS = 12
#: Entropies are summed as integers of this many to a bit, so that no rounding gathers over a long candidate.
SCALE = 1 << 40
#: Matches that are put together at a time; arrays of all matches are only copied once for so many.
BLOCK = 256
#: Character classes in order: name, pattern of the whole candidate, least entropy in bits of a window of 20.
CLASSES = (("hexadecimal", "[0-9A-Fa-f-]+", 2.93), ("upper", "[A-Z0-9]+", 3.37), ("base64", "[A-Za-z0-9+/_=-]+", 3.77))
#: Candidates that are suppressed, in full or in part.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i).*(example|sample|placeholder|dummy|changeme|redacted|xxxxx|abcdefghij|0123456789).*",
    r"[0-9=_+-]+",
    r"(/?[a-z]+[/_-])+[a-z]*[0-9]*",
)
#: The last one as Java runs it without a call for each part: a part can't be read in two ways, so nothing is lost by giving none back.
RUN_AS = {ALLOWED[3]: r"(?:/?[a-z]++[/_-])++[a-z]*+[0-9]*+"}
KINDS = ("assign", "access", "hex", "entropy")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _located(text: Column, pattern: str, keep) -> Column:
    """array<struct<start,stop,match>> of the matches that `keep` accepts; the gaps between all matches give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint,match:string>>)")
    long = lambda x: x.cast("long")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["match"])
        here = F.array(F.struct(long(start).alias("start"), long(stop).alias("stop"), pair["match"].alias("match")))
        return F.struct(long(stop).alias("at"), F.when(keep(pair["match"]), F.concat(state["spans"], here)).otherwise(state["spans"]).alias("spans"))

    def block(state: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(state["pairs"], i * BLOCK + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return let(inner, lambda x: F.struct(state["pairs"].alias("pairs"), x["at"].alias("at"), F.concat(state["spans"], x["spans"]).alias("spans")))

    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    spans = F.aggregate(blocks, F.struct(pairs.alias("pairs"), F.lit(0).cast("long").alias("at"), none.alias("spans")), block)["spans"]
    return F.when(F.exists(found, keep), spans).otherwise(none)


def _entropy_span(match: Column) -> Column:
    """struct<first,last>: the first and the last window of a candidate at or above its class's threshold, -1 if none.

    A window's entropy is log2(20) - sum(n log2 n) / 20 over the counts n of its characters. The counts stand in the fold's
    state; each step changes that of the character that enters and that of the one that leaves, and the sum by them."""
    weights = F.array(*[F.lit(round(n * math.log2(n) * SCALE) if n else 0) for n in range(WINDOW + 2)])
    weight = lambda n: F.element_at(weights, (n + 1).cast("int"))
    most = F.lit(-1).cast("long")
    for _, pattern, bits in reversed(CLASSES):
        most = F.when(match.rlike(f"^{pattern}$"), F.lit(math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE))).otherwise(most)
    places = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    words = range(-(-len(ALPHABET) // COUNTERS))

    def counter(ch: Column) -> Column:
        return let(
            F.element_at(places, F.ascii(ch) + 1),
            lambda p: F.struct(F.floor(p / COUNTERS).cast("int").alias("word"), (p % COUNTERS * 5).alias("bit")),
        )

    def moved(counts: Column, c: Column, by: int, use) -> Column:
        """use(count of c before, counts after)."""
        now = F.call_function("shiftright", F.get(counts, c["word"]), c["bit"]).bitwiseAND(F.lit(31))
        changed = F.transform(
            counts, lambda w,
            k: F.when(k == c["word"], w + F.call_function("shiftleft", F.lit(by).cast("long"), c["bit"])).otherwise(w),
        )
        return let(F.struct(now.alias("n"), changed.alias("counts")), lambda x: use(x["n"], x["counts"]))

    def window(given: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            """i: the position (from 0) of the character that enters."""

            def settle(total: Column, counts: Column) -> Column:
                hot = (i >= WINDOW - 1) & (total <= given["most"])
                at = (i - (WINDOW - 1)).cast("long")
                first = F.when(hot & (state["first"] < 0), at).otherwise(state["first"])
                return F.struct(
                    total.alias("sum"), counts.alias("counts"), first.alias("first"),
                    F.when(hot, at).otherwise(state["last"]).alias("last"),
                )

            def enter(total: Column, counts: Column) -> Column:
                return moved(counts, F.get(given["chars"], i), 1, lambda n, after: settle(total + weight(n + 1) - weight(n), after))

            left = moved(
                state["counts"], F.get(given["chars"], i - WINDOW), -1, lambda n,
                after: F.struct((state["sum"] + weight(n - 1) - weight(n)).alias("sum"), after.alias("counts")),
            )
            before = F.when(i >= WINDOW, left).otherwise(F.struct(state["sum"].alias("sum"), state["counts"].alias("counts")))
            return let(before, lambda x: enter(x["sum"], x["counts"]))

        zero = F.lit(0).cast("long")
        start = F.struct(
            zero.alias("sum"), F.array(*[zero for _ in words]).alias("counts"), F.lit(-1).cast("long").alias("first"),
            F.lit(-1).cast("long").alias("last"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(given["chars"]) - 1), start, step,
            lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
        )

    return let(F.struct(F.transform(F.split(match, ""), counter).alias("chars"), most.alias("most")), window)


def _candidate(match: Column) -> Column:
    keep = match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        keep = keep & ~match.rlike(f"^(?:{RUN_AS.get(pattern, pattern)})$")
    return keep


def with_secrets(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """docs with a column of this name: array<struct<start,kind_no,kind,stop>> ordered by start, then kind. No row moves.

    docs: text (string; null counts as empty) and any other columns, of any names but `name`, which is replaced. Kinds
    assign, access and hex are those of the fixed patterns; an entropy span runs from a candidate's first to its last window
    at its class's threshold, unless the candidate is allowed or the span meets one of the fixed patterns. Texts and
    candidates may be of any length: work grows with the length. Repeated rows are treated alike; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, lambda m: F.length(m) >= 18, lambda m: F.length(m) >= 16)
    names = [graph.unused(docs, f"_s{no}") for no in range(4)]
    base_name, hot_name = graph.unused(docs, "_base"), graph.unused(docs, "_hot")
    kinds = {names[no]: _located(text, pattern, ok) for no, (pattern, ok) in enumerate(zip((ASSIGN, ACCESS, HEX), keep, strict=True))}
    kinds[names[3]] = _located(text, CANDIDATE, _candidate)
    named = lambda no: F.transform(F.col(names[no]), lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(KINDS[no]).alias("kind"), x["stop"].alias("stop")))
    hot = F.transform(F.col(names[3]), lambda x: F.struct(x["start"].alias("at"), _entropy_span(x["match"]).alias("w")))
    spans = F.transform(
        F.filter(hot, lambda x: x["w"]["first"] >= 0),
        lambda x: F.struct(
            (x["at"] + x["w"]["first"]).alias("start"), F.lit(3).alias("kind_no"), F.lit(KINDS[3]).alias("kind"),
            (x["at"] + x["w"]["last"] + WINDOW).alias("stop"),
        ),
    )
    out = docs.withColumns(kinds).withColumn(base_name, F.concat(named(0), named(1), named(2))).withColumn(hot_name, spans)
    more = F.filter(hot_name, lambda x: ~F.exists(base_name, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return out.withColumn(name, F.array_sort(F.concat(base_name, more))).drop(*names, base_name, hot_name)


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs (doc_id, text, others ignored)."""
    out = with_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n = lambda no: F.size(F.filter("secrets", lambda s: s["kind_no"] == no)).cast("long")
    base = F.filter("secrets", lambda s: s["kind_no"] < 3)
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs (all columns, of any names) with the texts' secrets replaced; overlapping spans become one mark."""
    name = graph.unused(docs, "secrets")
    out = with_secrets(docs, name)
    text = F.col("text").cast("string")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("gaps"))

    def step(state: Column, s: Column) -> Column:
        gap = F.array(F.struct(state["at"].alias("start"), s["start"].alias("stop")))
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"),
        )

    def joined(done: Column) -> Column:
        kept = F.transform(done["gaps"], lambda g: F.substr(text, (g["start"] + 1).cast("int"), (g["stop"] - g["start"]).cast("int")))
        return F.concat(F.array_join(kept, mark), F.lit(mark), F.substr(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))

    return out.withColumn("text", F.when(F.size(name) > 0, let(F.aggregate(name, start, step), joined)).otherwise(F.col("text"))).select(docs.columns)
