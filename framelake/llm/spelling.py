"""Spelling variants: words one edit apart, found by neighbourhoods of their forms in a reduced alphabet."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph
from framelake.llm.words import LOWER, mix, slices

#: Letters of words after lower-casing A-Z: a-z and U+00C0 to U+00FF, by code point.
LETTERS = np.concatenate((np.arange(97, 123), np.arange(192, 256)))
#: Alphabets that letters are hashed to, one after the other; the last is the letters themselves.
ALPHABETS = (8, 30, len(LETTERS))
#: Words of one reduced form that a probe may meet; forms of more are told apart in the next alphabet.
MOST_WORDS = 32
#: Neighbours are made for so many (word, neighbour) pairs at a time; a longer word is a block of its own.
BLOCK = 1 << 20
#: Runs of more bytes are checked by zlib one by one.
LONG_RUN = 64

_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LEAD = 0xC3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def run_sums(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of what has the checksum `before` followed by raw[start:end], for every run."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long_ = int(np.count_nonzero(size > LONG_RUN))
    out = np.empty(len(starts), np.uint32)
    for i in order[:long_]:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(before[i]))
    short = order[long_:]
    c, at, size = before[short].astype(np.uint32) ^ np.uint32(0xFFFFFFFF), starts[short], size[short]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # runs of more than j bytes
        c[:n] = _CRC[(c[:n] ^ raw[at[:n] + j]) & 255] ^ (c[:n] >> 8)
    out[short] = c ^ np.uint32(0xFFFFFFFF)
    return out


def letter_runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes), code points and text number of every maximal run of letters; runs end at texts' edges."""
    lead = raw == _LEAD  # in UTF-8 the lead byte of U+00C0 to U+00FF and of nothing else
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.concatenate(([0], np.cumsum(lead)))
    return starts, ends, ends - starts - (leads[ends] - leads[starts]), np.searchsorted(off, starts, "right") - 1


def _strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as an Arrow array, copied together without a loop."""
    size = ends - starts
    off = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])


def _words_of(ids: list, raw: np.ndarray, off: np.ndarray, least: int, every: int) -> list[pa.Array]:
    """Words of texts (raw, off) of at least `least` code points, in two arrays: those taken as they are, those cut."""
    low = LOWER[raw]
    starts, ends, chars, text = letter_runs(raw, off)
    long_ = chars >= least
    starts, ends, chars, text = starts[long_], ends[long_], chars[long_], text[long_]
    if not every:
        return [_strings(low, starts, ends)]
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    sums = run_sums(low, starts, ends, heads[text])
    drawn = sums % np.uint32(every) == 0
    cut = []
    for i in np.flatnonzero(drawn & (chars > least)):
        word = low[starts[i] : ends[i]].tobytes().decode()
        at = int(sums[i]) % int(chars[i])
        cut.append(word[:at] + word[at + 1 :])
    return [_strings(low, starts[~drawn], ends[~drawn]), pa.array(cut, pa.large_string())]


def count_words(docs: DataFrame, least_chars: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n of all maximal letter runs of docs (doc_id, text), A-Z in lower case: those of least_chars or more that occur
    least_count times or more. Counts are summed by Arrow batch, by task, then by word.

    Where every (0: never) divides the CRC-32 of `<doc_id>:<run>`, the run loses the code point of that number modulo its
    length: planted misspellings, alike on every run. Null texts have no words, a null doc_id counts as no digits."""

    def task(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), []
            for a, raw, off in slices(batch.column(1)):
                for words in _words_of(ids[a : a + len(off) - 1], raw, off, least_chars, every):
                    if len(words):
                        seen = words.value_counts()
                        parts.append(pa.table({"word": seen.field(0), "n": seen.field(1)}))
            if parts:
                total = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
                yield from pa.table({"word": total.column("word"), "n": total.column("n_sum")}).to_batches()

    counts = docs.select("doc_id", "text").mapInArrow(task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def reduction(symbols: int) -> np.ndarray:
    """The symbol, from 1, of every code point below 256: letters hashed to so many symbols, or each its own."""
    out, place = np.zeros(256, np.uint64), np.arange(len(LETTERS), dtype=np.uint64)
    own = symbols >= len(LETTERS)
    out[LETTERS] = (place if own else mix(place + np.uint64(symbols)) % np.uint64(symbols)) + np.uint64(1)
    return out


def _by_length(column: pa.Array):
    """(rows, matrix of code points) of the words of each length, in blocks."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        step = max(1, BLOCK // max(1, int(n)))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)


def _hashed(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, powers of the base, and hashes of all prefixes (by their length) of words of one length."""
    symbols = table[codes]
    power = np.full(codes.shape[1] + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    heads = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(symbols * power[:-1], axis=1, out=heads[:, 1:])
    return symbols, power, heads


def neighbourhood(codes: np.ndarray, table: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all reduced words within one edit of the reduced words (of one length), each once for a word, and how many.

    A neighbour's hash follows from those of a prefix and a suffix, so that no neighbour is ever spelled out."""
    s, power, heads = _hashed(codes, table)
    m, n = s.shape
    whole, every = heads[:, -1:], np.arange(1, symbols + 1, dtype=np.uint64)
    tails = whole - heads
    deleted = heads[:, :-1] + tails[:, 1:] * _INVERSE
    replaced = whole[:, :, None] + (every[None, None, :] - s[:, :, None]) * power[None, :-1, None]
    inserted = (heads + tails * _BASE)[:, :, None] + every[None, None, :] * power[None, :, None]
    near = np.concatenate((whole, deleted, replaced.reshape(m, n * symbols), inserted.reshape(m, (n + 1) * symbols)), axis=1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    return mix(near[new]), new.sum(axis=1)


def _keyed(words: DataFrame, symbols: int) -> DataFrame:
    """Words (id, word, n) with the key of their reduced form."""
    table = reduction(symbols)

    def task(batches):
        for batch in batches:
            key = np.zeros(len(batch), np.uint64)
            for rows, codes in _by_length(batch.column(1)):
                key[rows] = mix(_hashed(codes, table)[2][:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", "id", "word", "n"])

    return words.select("id", "word", "n").mapInArrow(task, "key long, id long, word string, n long")


def _probes(words: DataFrame, symbols: int) -> DataFrame:
    """key, probe: the keys of all reduced forms within one edit of that of each word."""
    table = reduction(symbols)

    def task(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, codes in _by_length(batch.column(1)):
                step = max(1, BLOCK // (2 * symbols * codes.shape[1] + symbols + 1))
                for a in range(0, len(rows), step):
                    keys, counts = neighbourhood(codes[a : a + step], table, symbols)
                    probe = np.repeat(ids[rows[a : a + step]], counts)
                    for b in range(0, len(keys), BLOCK):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[b : b + BLOCK].view(np.int64)), pa.array(probe[b : b + BLOCK])],
                            names=["key", "probe"],
                        )

    return words.select("id", "word").mapInArrow(task, "key long, probe long")


def candidates(words: DataFrame, alphabets: tuple[int, ...] = ALPHABETS, most: int = MOST_WORDS) -> DataFrame:
    """probe, word, n: for each word's id the words whose reduced form is within one edit of its own, themselves included.

    words: id, word, n, stored. No pair within one edit is missing; some are further apart. A reduced form that more than
    `most` words share isn't paired: those words, and the words that probe it, meet in the next, larger alphabet instead. In
    the last, which must tell all letters apart, a form has one word."""
    found, listed, probing = [], words, words
    for level, symbols in enumerate(alphabets):
        keyed, heavy = _keyed(listed, symbols), None
        if level < len(alphabets) - 1:
            heavy = graph.cut(keyed.groupBy("key").count().where(F.col("count") > most).select("key"))
            heavy = heavy if heavy.limit(1).count() else None
        if heavy is None:
            met = _probes(probing, symbols).join(keyed.select("key", "word", "n").hint("shuffle_hash"), "key")
            found.append(met.select("probe", "word", "n"))
            break
        light = keyed.join(graph.small(heavy), "key", "left_anti").select("key", "word", "n")
        marked = heavy.select("key", F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("n"))
        met = _probes(probing, symbols).join(light.unionByName(marked).hint("shuffle_hash"), "key")
        met = graph.cut(met.select("probe", "word", "n"))
        found.append(met.where("word is not null"))
        again = met.where("word is null").select(F.col("probe").alias("id")).distinct()
        probing = graph.cut(words.join(again, "id", "left_semi"))
        listed = graph.cut(keyed.join(graph.small(heavy), "key", "left_semi").select("id", "word", "n"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def follow(links: DataFrame) -> DataFrame:
    """word, root of links (word, root; without circles): the end of the chain of links from each word, by pointer doubling."""
    now = graph.cut(links)
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = graph.cut(now.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"),
        ))
        if not moved.where("moved").limit(1).count():
            return now
        now = moved.drop("moved")


def spelling_variants(
    docs: DataFrame, least_chars: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199, most: int = MOST_WORDS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs (doc_id, text): see `count_words` for words and n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. A word's form is its near
    word of largest n (of several the first in code-point order) if that n, form_n, is at least ratio (2 or more) times the
    word's; else both are null. root: the end of the chain of forms; a word without form is its own.

    Candidates come from reduced alphabets (`candidates`) and are verified on the words by Spark's banded distance. Very long
    runs are words like others: a word has about 16 neighbours a letter, each a hash. Null and empty texts have no words,
    repeated rows count each time, empty tables give no rows; columns other than doc_id and text are not read."""
    if ratio < 2:
        raise ValueError("the ratio is 2 or more, so that chains of forms have an end")
    words = graph.cut(count_words(docs, least_chars, least_count, every).withColumn("id", F.monotonically_increasing_id()).select("id", "word", "n"))
    own = words.select(F.col("id").alias("probe"), F.col("word").alias("own"))
    pairs = candidates(words, most=most).join(own, "probe").where("word <> own and levenshtein(word, own, 1) = 1")
    best = F.min(F.struct((-F.col("n")).alias("less"), "word")).alias("best")
    near = pairs.groupBy(F.col("probe").alias("id")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "id", "left").withColumn("most", -F.col("best.less"))
    has = F.col("most") >= ratio * F.col("n")
    out = graph.cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"),
        F.when(has, F.col("most")).alias("form_n"),
    ))
    chains = follow(out.where("form is not null").select("word", F.col("form").alias("root")))
    out = out.join(chains, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
