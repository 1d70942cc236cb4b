"""Katz backoff language model of order two over blocks of documents.

Counting and scoring go by requests and replies between blocks of documents and tables partitioned by hash. A block sends
its different words (to the partition of the word) and its different word pairs (to the partition of the pair's context),
each once and packed; the partitions sum what all blocks sent and answer in the order of the request. Contexts that hold
much of the text are dealt to several partitions by the word that follows. No task holds the model.

Unigrams: (c + 1) / (N + V + 1), where one word stands for all unknown ones. Pairs: Good-Turing discounts for counts up to
5, half a count off above (so every context keeps mass for what it has not seen), and backoff weights that make the
probabilities of every context sum to one:

    p(w | h) = d_r r / c(h)                  if the pair was seen r times
    p(w | h) = alpha(h) p(w)                 else,  alpha(h) = (1 - sum of seen p(w | h)) / (1 - sum of seen p(w))
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.words import mix, slices, split, word_hashes

BLOCK_CHARS = 12_000_000
#: Counts up to this one get Good-Turing discounts.
GT = 5
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543211)
W48 = np.uint64((1 << 48) - 1)
PACKET = "block int, bucket int, kind int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as zstandard-compressed byte planes."""
    import zstandard

    z, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = z.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""
        out.append(struct.pack("<cBqq", a.dtype.kind.encode(), a.itemsize, len(a), len(body)) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    z, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(blob):
        kind, item, n, size = struct.unpack_from("<cBqq", blob, at)
        at += struct.calcsize("<cBqq")
        dtype = np.dtype(f"{kind.decode()}{item}")
        out.append(np.ascontiguousarray(np.frombuffer(
            z.decompress(blob[at : at + size]), np.uint8,
        ).reshape(item, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += size
    return out


def _packets(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table(
        [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())],
        names=["block", "bucket", "kind", "blob"],
    )


class Block:
    """Tokens of a block of documents: words, then an end, over the block's own sorted vocabulary."""

    def __init__(self, docs: pa.Table):
        docs = docs.combine_chunks()
        self.doc_id = docs.column("doc_id").combine_chunks()
        self.train = ~docs.column("held_out").to_numpy().astype(bool)
        hashes, counts = [], []
        for _, raw, off in slices(docs.column("text")):
            starts, ends, woff = split(raw, off)
            hashes.append(word_hashes(raw, starts, ends))
            counts.append(np.diff(woff))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.n_tokens = (np.concatenate(counts) if counts else np.zeros(0, np.int64)) + 1
        stop = np.cumsum(self.n_tokens)
        tokens = np.full(int(stop[-1]) if len(stop) else 0, END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[stop - 1] = False
        tokens[inside] = words
        self.vocab, which = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        self.word = which[:-1].astype(np.int64)
        self.begin = int(which[-1])
        self.doc = np.repeat(np.arange(len(stop)), self.n_tokens)
        self.first = stop - self.n_tokens

    def pairs(self):
        """Sorted different pairs: context and word (places in the vocabulary), training count; and each token's pair."""
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[self.first] = self.begin
        key, of_token = np.unique(context * len(self.vocab) + self.word, return_inverse=True)
        count = np.bincount(of_token, self.train[self.doc], len(key)).astype(np.uint32)
        return key // len(self.vocab), key % len(self.vocab), count, of_token


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _word_requests(n: int):
    def task(docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        b = Block(docs)
        count = np.bincount(b.word, b.train[b.doc], len(b.vocab)).astype(np.uint32)
        cut = np.searchsorted(_bucket(b.vocab, n), np.arange(n + 1))
        return _packets([(block, i, 0, pack(b.vocab[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]])) for i in range(n)])

    return task


def _word_replies(table: pa.Table) -> pa.Table:
    """Counts of the words that each block asked for, and the partition's tokens and different training words."""
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    asked = [unpack(x) for x in table.column("blob").to_pylist()]
    words, at = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    total = np.bincount(at, np.concatenate([x[1] for x in asked]), len(words)).astype(np.uint64)
    sums = np.array([total.sum(), (total > 0).sum()], np.int64)
    stop = np.cumsum([len(x[0]) for x in asked])
    return _packets([
        (
            k, bucket, 1,
            pack(total[at[e - len(x[0]) : e]].astype(np.uint32) if total.max(initial=0) < 1 << 32 else total[at[e - len(x[0]) : e]], sums),
        ) for k,
        x, e in zip(blocks, asked, stop, strict=True)
    ])


def _word_counts(replies: pa.Table) -> tuple[np.ndarray, int, int]:
    """Training counts in the order of the block's vocabulary, N and V."""
    rows = sorted(
        (b, x) for b, kind,
        x in zip(
            replies.column("bucket").to_pylist(), replies.column("kind").to_pylist(), replies.column("blob").to_pylist(),
            strict=True,
        ) if kind == 1
    )
    got = [unpack(x) for _, x in rows]
    sums = sum((g[1] for g in got), np.zeros(2, np.int64))
    return np.concatenate([g[0].astype(np.int64) for g in got]), int(sums[0]), int(sums[1])


def _deal(b: Block, context: np.ndarray, word: np.ndarray, count: np.ndarray, total: int, n: int):
    """For every partition: the contexts asked for (places in the vocabulary) and the pairs (places in the pairs)."""
    home = _bucket(b.vocab, n)
    weight = count.copy()
    weight[b.begin] = count[np.searchsorted(b.vocab, END)]
    parts = np.clip((weight * 4 * n) // max(total, 1), 1, n)
    share = (mix(b.vocab[word]) % parts[context].astype(np.uint64)).astype(np.int64)
    to = (home[context] + share) % n
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n + 1))
    asks = np.zeros(len(b.vocab), bool)
    asks[context] = True
    single = np.flatnonzero(asks & (parts == 1))
    wide = np.flatnonzero(asks & (parts > 1))
    scut = np.searchsorted(home[single], np.arange(n + 1))
    for i in range(n):
        more = wide[(i - home[wide]) % n < parts[wide]]
        yield np.union1d(single[scut[i] : scut[i + 1]], more), order[cut[i] : cut[i + 1]]


def _pair_requests(n: int):
    def task(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _packets([])
        block = docs.column("block")[0].as_py()
        b = Block(docs)
        count, total, _ = _word_counts(replies)
        context, word, seen, _ = b.pairs()
        rows = []
        for i, (ctx, own) in enumerate(_deal(b, context, word, count, total, n)):
            each = np.bincount(np.searchsorted(ctx, context[own]), minlength=len(ctx)).astype(np.uint32)
            rows.append((
                block, i, 0,
                pack(b.vocab[ctx], each, b.vocab[word[own]] & W48, seen[own], count[word[own]].astype(np.uint32 if total < 1 << 32 else np.uint64)),
            ))
        return _packets(rows)

    return task


def _pair_replies(table: pa.Table) -> pa.Table:
    """For each block: the training count of each pair, sums for each context, and the partition's counts of counts."""
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    asked = [unpack(x) for x in table.column("blob").to_pylist()]
    contexts, at = np.unique(np.concatenate([x[0] for x in asked]), return_inverse=True)
    each = np.concatenate([x[1] for x in asked])
    ctx = np.repeat(at, each)
    key = mix(np.concatenate([x[2] for x in asked]) ^ mix(contexts[ctx] if len(contexts) else np.zeros(0, np.uint64)))
    order = np.argsort(key)
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    group = np.cumsum(first) - 1
    part = np.concatenate([x[3] for x in asked])[order]
    r_of = np.bincount(group, part, int(first.sum())).astype(np.int64)
    lead = order[first]
    own, plus = ctx[lead], np.concatenate([x[4] for x in asked])[lead].astype(float) + 1
    k = len(contexts)
    by_r = [np.bincount(own[r_of == j], minlength=k).astype(np.uint32) for j in range(1, GT + 1)]
    high = r_of > GT
    big = np.bincount(own[high], r_of[high] - 0.5, k)
    lower = np.bincount(own[r_of > 0], plus[r_of > 0], k)
    hist = np.bincount(np.minimum(r_of, GT + 2), minlength=GT + 3)[1 : GT + 2].astype(np.int64)
    r = np.empty(len(order), np.uint32)
    r[order] = r_of[group]
    rows, p, c = [], 0, 0
    for block, x in zip(blocks, asked, strict=True):
        mine = at[c : c + len(x[0])]
        rows.append((block, bucket, 2, pack(r[p : p + len(x[2])], *[v[mine] for v in by_r], big[mine], lower[mine], hist)))
        p, c = p + len(x[2]), c + len(x[0])
    return _packets(rows)


def discounts(hist: np.ndarray) -> np.ndarray:
    """d_1 .. d_GT by Katz's formula from the counts of counts 1 .. GT + 1; (r - 1/2) / r where that is not in (0, 1)."""
    n = np.concatenate(([0], hist)).astype(float)
    out = np.zeros(GT + 1)
    a = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
    for r in range(1, GT + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a != 1 else -1.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int):
    def task(docs: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(docs) if docs.num_rows else None
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in RESULT.split(", ")]
        if b is None:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        count, total, types = _word_counts(replies)
        z = float(total + types + 1)
        context, word, _, of_token = b.pairs()
        rows = sorted(
            (i, x) for i, kind,
            x in zip(
                replies.column("bucket").to_pylist(), replies.column("kind").to_pylist(), replies.column("blob").to_pylist(),
                strict=True,
            ) if kind == 2
        )
        r, v = np.zeros(len(context), np.int64), len(b.vocab)
        by_r, big, lower, hist = np.zeros((GT, v)), np.zeros(v), np.zeros(v), np.zeros(GT + 1, np.int64)
        for (ctx, own), (_, blob) in zip(_deal(b, context, word, count, total, n), rows, strict=True):
            got = unpack(blob)
            r[own] = got[0]
            for j in range(GT):
                by_r[j, ctx] += got[1 + j]
            big[ctx] += got[GT + 1]
            lower[ctx] += got[GT + 2]
            hist += got[GT + 3]
        d = discounts(hist)
        times = count.astype(float)
        times[b.begin] = count[np.searchsorted(b.vocab, END)]
        kept = big + sum(d[j + 1] * (j + 1) * by_r[j] for j in range(GT))
        known = times > 0
        alpha = np.where(known, (1 - kept / np.maximum(times, 1)) / (1 - lower / z), 1.0)
        weight = np.where(r > GT, r - 0.5, d[np.minimum(r, GT)] * r)
        p = np.where(r > 0, weight / np.maximum(times[context], 1), alpha[context] * (count[word] + 1) / z)
        base = np.log10((count + 1) / z)
        docs_n = len(b.n_tokens)
        sums = lambda x: np.bincount(b.doc, x, docs_n)
        cols = [
            b.doc_id, pa.array(~b.train), pa.array(b.n_tokens), pa.array(sums(count[b.word] > 0).astype(np.int64)),
            pa.array(np.full(docs_n, total, np.int64)), pa.array(sums(base[b.word])), pa.array(sums(np.log10(p)[of_token])),
        ]
        return pa.table(cols, names=names)

    return task


def held_out(doc_id: Column) -> Column:
    """Rows that are not learnt from: crc32 of the id's digits leaves 2 modulo 7 (and rows without id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def katz_scores(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row of docs.

    docs: doc_id, text, others ignored. Tokens are words (ASCII capitals folded), then one end. Null and empty texts are
    one end; repeated rows count as often as they stand; without training rows all words are unknown. An empty table
    gives no rows.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = df.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int")
    df = df.select(block.alias("block"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    words = df.groupBy("block").applyInArrow(_word_requests(n), PACKET).groupBy("bucket").applyInArrow(_word_replies, PACKET)
    asked = df.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_pair_requests(n), PACKET)
    pairs = asked.groupBy("bucket").applyInArrow(_pair_replies, PACKET)
    replies = words.unionByName(pairs)
    return df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(n), RESULT)
