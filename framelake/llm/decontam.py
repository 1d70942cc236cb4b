"""Benchmark decontamination: one FM-index per shard of the training text, searched for the windows of all items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph
from framelake.llm.fm_index import FMIndex
from framelake.llm.words import NOT_WORD, slices, split, word_hashes

SHARD_BYTES = 12 << 20
#: Benchmark text of one search; a longer benchmark is searched block after block.
BLOCK_CHARS = 4 << 20
#: Words of a piece of a benchmark text.
PIECE_WORDS = 10_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


class Windows:
    """All windows of `width` words of the items (an item of fewer words is one window), over the items' own vocabulary."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        hashes, counts = [], []
        for _, raw, off in slices(pa.array(texts, pa.string())):
            starts, ends, woff = split(raw, off, NOT_WORD)
            hashes.append(word_hashes(raw, starts, ends))
            counts.append(np.diff(woff))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.vocab, sym = np.unique(words, return_inverse=True)
        sym = sym + 1
        rows, owner = [], []
        off = np.concatenate(([0], np.cumsum(counts)))
        for i, n in enumerate(counts):
            w = sym[off[i] : off[i + 1]]
            if n == 0:
                continue
            made = np.lib.stride_tricks.sliding_window_view(w, width) if n >= width else np.concatenate((np.zeros(width - n, np.int64), w))[None]
            rows.append(made)
            owner.append(np.full(len(made), ids[i], np.int64))
        if rows:
            self.patterns, at = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([at.ravel(), np.concatenate(owner)], axis=1), axis=0)
        else:
            self.patterns, pairs = np.zeros((0, width), np.int64), np.zeros((0, 2), np.int64)
        self.lengths = (self.patterns > 0).sum(axis=1)
        self.items = pairs[:, 1]
        self.item_off = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocab & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 if no item has it."""
        out = np.zeros(len(words), np.int64)
        near = np.flatnonzero(self.maybe[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(near) and len(self.vocab):
            w = words[near]
            at = np.minimum(np.searchsorted(self.vocab, w), len(self.vocab) - 1)
            out[near] = np.where(self.vocab[at] == w, at + 1, 0)
        return out


def _runs(sym: np.ndarray, woff: np.ndarray, least: int):
    """Runs of known words within a text, of `least` words at least: first word, length, text."""
    known = sym > 0
    first, last = known.copy(), known.copy()
    first[1:] &= ~known[:-1]
    last[:-1] &= ~known[1:]
    edge = woff[1:-1]
    edge = edge[(edge > 0) & (edge < len(sym))]
    first[edge], last[edge - 1] = known[edge], known[edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = b - a >= least
    a, b = a[keep], b[keep]
    return a, b - a, np.searchsorted(woff, a, "right") - 1


def _shard_hits(windows: Windows, symbols: np.ndarray, run_len: np.ndarray):
    """(covered, pattern, start) of an index over the runs: a flag for each symbol, and all occurrences."""
    off = np.concatenate(([0], np.cumsum(run_len)))
    index = FMIndex(symbols, off)
    lo, hi = index.search(windows.patterns, windows.lengths)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    at = index.locate(rows)
    run = np.searchsorted(index.start, at, "right") - 1
    at = at - run  # without the separators
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + windows.lengths[which], -1)
    return np.cumsum(cover[:-1]) > 0, which, run


def _task(windows: Windows, keep_text: bool):
    least = int(windows.lengths.min(initial=1 << 30))

    def task(batches):
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            spans: list[list] = [list(x) for x in batch.column("spans").to_pylist()]
            items: list[set] = [set(x) for x in batch.column("items").to_pylist()]
            held, bytes_held = [], 0

            def search():
                if not held:
                    return
                sym, first, length, doc = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                if not len(sym) or not len(windows.patterns):
                    return
                hit, which, run = _shard_hits(windows, sym, length)
                off = np.concatenate(([0], np.cumsum(length)))
                pos = np.flatnonzero(hit)
                if not len(pos):
                    return
                of_run = np.searchsorted(off, pos, "right") - 1
                cut = np.ones(len(pos), bool)
                cut[1:] = (pos[1:] != pos[:-1] + 1) | (of_run[1:] != of_run[:-1])
                starts = np.flatnonzero(cut)
                ends = np.concatenate((starts[1:], [len(pos)]))
                for s, e in zip(starts, ends, strict=True):
                    r = of_run[s]
                    w = int(first[r] + pos[s] - off[r])
                    spans[doc[r]].append({"start": w, "end": w + int(e - s)})
                pairs = np.unique(np.stack([doc[run], which], axis=1), axis=0)
                for d, p in pairs:
                    items[d].update(windows.items[windows.item_off[p] : windows.item_off[p + 1]].tolist())

            for a, raw, off in slices(batch.column("text")):
                starts, ends, woff = split(raw, off, NOT_WORD)
                n_words[a : a + len(off) - 1] = np.diff(woff)
                if len(starts):
                    sym = windows.symbols(word_hashes(raw, starts, ends))
                    first, length, doc = _runs(sym, woff, least)
                    take = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
                    held.append((sym[take], first - woff[doc], length, doc + a))
                bytes_held += len(raw)
                if bytes_held >= SHARD_BYTES:
                    search()
                    bytes_held = 0
            search()
            text = batch.column("text") if keep_text else pa.nulls(n, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch(
                [
                    batch.column("doc_id"), text, pa.array(n_words), pa.array([merged(x) for x in spans], kind),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text", "n_words", "spans", "items"],
            )

    return task


#: Stands for a null item_id inside the search; no item has the least of all ids.
NO_ITEM = -(1 << 63)


def merged(spans: list[dict]) -> list[dict]:
    """Spans in order; those that meet or touch become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _pieces(benchmark: DataFrame, width: int, words: int = PIECE_WORDS) -> DataFrame:
    """item_id, text: the benchmark's texts in pieces of bounded length; every window lies in a piece of its item."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), found.alias("w")).where("size(w) > 0")
    n = F.greatest(F.ceil((F.size("w") - width + 1) / words), F.lit(1)).cast("int")
    cut = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return cut.select("item_id", F.array_join(F.slice("w", F.col("i") * words + 1, F.lit(words + width - 1)), " ").alias("text"))


def _blocks(pieces: DataFrame, width: int, block_chars: int):
    """Windows of one block after the other. A block has about `block_chars` characters: different pieces, which are short, are
    dealt by hash, and a piece that is repeated counts once. The driver and the tasks hold one block at a time."""
    pieces = graph.cut(pieces.distinct())
    blocks = max(1, -(-(pieces.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for i in range(blocks):
        part = pieces if blocks == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        rows = part.collect()
        yield i == blocks - 1, Windows([r[0] or 0 for r in rows], [r[1] for r in rows], width)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep_text: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Words of documents inside any occurrence of a window of `width` consecutive words of a benchmark item.

    docs: doc_id, text; benchmark: item_id (integer), text; other columns are ignored. Words are runs of ASCII letters and
    digits and of non-ASCII characters, ASCII capitals folded. Returns a row for each row of docs: doc_id, text (null
    unless keep_text), n_words, spans (merged word ranges, end exclusive), items (sorted ids of items that occur). Null and
    empty texts have no words; texts and items may be of any length; items without words match nothing, those without id hit words but aren't named; repeated rows
    are treated alike; an item of fewer words than `width` is one window; an empty table gives no rows, an empty benchmark
    no spans. The benchmark is searched in blocks of about `block_chars` characters, one pass over docs each, stored in
    between: neither the driver nor a task ever holds more than one block.
    """
    none = "array()"
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.expr(f"cast({none} as array<struct<start:bigint,end:bigint>>)").alias("spans"),
        F.expr(f"cast({none} as array<bigint>)").alias("items"),
    )
    named = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ITEM)).alias("item_id"), "text")
    for last, windows in _blocks(_pieces(named, width), width, block_chars):
        out = out.mapInArrow(_task(windows, keep_text or not last), SCHEMA)
        out = out if last else graph.cut(out)
    return out.withColumn("items", F.filter("items", lambda i: i != NO_ITEM))


def hit_digest(hits: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 (of the ids, sorted as strings, comma-joined) and contaminated by row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _clean_task(names: list[str], at: int):
    def task(batches):
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            for i, found in enumerate(spans):
                if found:
                    raw = texts[i].encode()
                    starts, ends, _ = split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NOT_WORD)
                    left, kept = 0, []
                    for s in found:
                        kept.append(raw[left : starts[s["start"]]])
                        left = ends[s["end"] - 1]
                    texts[i] = b"".join([*kept, raw[left:]]).decode()
            cols = [batch.column(j) if j != at else pa.array(texts, pa.string()) for j in range(len(names))]
            yield pa.record_batch(cols, names=names)

    return task


def without_spans(hits: DataFrame) -> DataFrame:
    """doc_id, text: the texts of `benchmark_hits(..., keep_text=True)` with the spans cut out."""
    df = hits.select("doc_id", "text", "spans")
    return df.mapInArrow(_clean_task(["doc_id", "text"], 1), "doc_id long, text string")


def _drop_task(windows: Windows, names: list[str], at: int):
    search = _task(windows, True)

    def task(batches):
        for batch in batches:
            n = batch.num_rows
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            x = pa.record_batch(
                [pa.array(range(n), pa.int64()), batch.column(at), pa.array([[]] * n, kind), pa.array([[]] * n, pa.list_(pa.int64()))],
                names=["doc_id", "text", "spans", "items"],
            )
            yield batch.filter(pa.array([not s for s in next(iter(search([x]))).column("spans").to_pylist()]))

    return task


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (all columns, of any names) without the rows whose text has an occurrence of a benchmark window; no row moves.

    Item ids are not used: rows without one count. Otherwise as `benchmark_hits`."""
    pieces = _pieces(benchmark.select(F.lit(0).alias("item_id"), "text"), width)
    out = docs
    for last, windows in _blocks(pieces, width, block_chars):
        out = out.mapInArrow(_drop_task(windows, docs.columns, docs.columns.index("text")), docs.schema)
        out = out if last else graph.cut(out)
    return out
