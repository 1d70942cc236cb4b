"""Token ids in a bit-plane format: fixed-size blocks of ids, transposed to planes, each compressed with zstandard."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import graph
from framelake.llm.words import SPACE, mix, slices
from framelake.llm.words import _BYTE, _powers

BLOCK_IDS = 8192
CHUNK_IDS = 131_072
LEVEL = 3
SCHEMA = "shard int, first long, n_ids long, doc_ids array<long>, lengths array<long>, planes array<binary>"

# --- the format ------------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool = False, block: int = BLOCK_IDS, level: int = LEVEL) -> list[bytes]:
    """Planes of unsigned 32-bit ids. Within a block all bytes (bits) of one weight stand together; plane p has those of
    weight p of all blocks, one after the other. The last block is filled with zeros to a multiple of 8 ids."""
    import zstandard

    raw = np.zeros(-(-len(ids) // 8) * 8, "<u4")
    raw[: len(ids)] = ids
    planes: list[list[np.ndarray]] = [[] for _ in range(32 if bits else 4)]
    for i in range(0, len(raw), block):
        part = raw[i : i + block].view(np.uint8).reshape(-1, 4)
        if bits:
            part = np.packbits(np.unpackbits(part, axis=1, bitorder="little"), axis=0, bitorder="little")
        for p, kept in enumerate(planes):
            kept.append(part[:, p])
    z = zstandard.ZstdCompressor(level=level, write_checksum=True)
    return [z.compress(np.concatenate(x).tobytes() if x else b"") for x in planes]


def from_planes(planes: list[bytes], n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids of `to_planes`; a plane that was changed fails its checksum."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    data = [np.frombuffer(z.decompress(p), np.uint8) for p in planes]
    out = np.zeros((-(-n // 8) * 8, 4), np.uint8)
    bits, at = len(planes) == 32, 0
    for i in range(0, len(out), block):
        m = min(block, len(out) - i)
        step = m // 8 if bits else m
        part = np.stack([d[at : at + step] for d in data], axis=1)
        out[i : i + m] = np.packbits(np.unpackbits(part, axis=0, bitorder="little"), axis=1, bitorder="little") if bits else part
        at += step
    return out.reshape(-1).view("<u4")[:n]


# --- encoding --------------------------------------------------------------------------------------------------------

MEMO_PIECES = 1_000_000
#: Bytes of a piece up to which a sum of its bytes' powers tells it from others; longer ones have a cryptographic hash.
HASHED_BYTES = 64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


class Encoder:
    """Ids of texts by a byte-level BPE without a normaliser.

    Such a tokenizer splits words before a blank that a word follows, between a letter and a stop, and between a single line
    end and a letter, and merges nothing across. Texts are cut there, each different piece is encoded once by the tokenizers
    library, and the ids are put together again: the same ids as of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self):
        self.keys, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]):
        if len(self.keys) + len(keys) > MEMO_PIECES:
            self._clear()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = len(self.ids) + np.cumsum(n) - n
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum()))
        order = np.argsort(np.concatenate((self.keys, keys)), kind="stable")
        self.keys = np.concatenate((self.keys, keys))[order]
        self.at, self.len = np.concatenate((self.at, at))[order], np.concatenate((self.len, n))[order]
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row and n+1 offsets."""
        n = len(raw)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        after = np.ones(n, bool)
        after[:-1] = ~SPACE[raw[1:]] & (raw[1:] > 32) & ((raw[1:] < 127) | (raw[1:] > 0xC2) & (raw[1:] != 0xE1) & (raw[1:] != 0xE2) & (raw[1:] != 0xE3) & (raw[1:] != 0xEF))
        after[-1] = False
        begin = (raw == 32) & after
        letter = _LETTER[raw]
        begin[1:] |= _STOP[raw[1:]] & letter[:-1]
        begin[2:] |= letter[2:] & (raw[1:-1] == 10) & (raw[:-2] > 32) & (raw[:-2] < 127)
        begin[off[:-1][off[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        ends = np.concatenate((starts[1:], [n]))
        p, inverse = _powers(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * p[:n], out=s[1:])
        h = mix((s[ends] - s[starts]) * inverse[starts])
        for i in np.flatnonzero(ends - starts > HASHED_BYTES):  # the sums of long pieces can be made to meet
            h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            if len(self.keys) + new.sum() > MEMO_PIECES:
                self._clear()
                new[:] = True
            data = raw.tobytes()
            self._learn(keys[new], [data[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        length, source = self.len[at][which], self.at[at][which]
        stop = np.cumsum(length)
        take = np.repeat(source - stop + length, length) + np.arange(stop[-1])
        piece = np.searchsorted(starts, off)
        return self.ids[take], np.concatenate(([0], stop))[piece]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; what it has learnt serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _write_task(path: str, end_id: int, bits: bool, chunk: int):
    def task(batches):
        from pyspark import TaskContext

        shard, first = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        lengths: list[int] = []
        size = 0

        def flush():
            nonlocal first, size
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "planes": pa.array([to_planes(ids, bits)], pa.list_(pa.binary())),
            })
            first += len(ids)
            held.clear(), docs.clear(), lengths.clear()
            size = 0
            return row

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, raw, off in slices(batch.column(1), 1 << 20):
                ids, ioff = enc.encode(raw, off)
                n = len(off) - 1
                for d in range(n):
                    held.append(np.append(ids[ioff[d] : ioff[d + 1]], np.uint32(end_id)))
                    docs.append(names[a + d])
                    lengths.append(len(held[-1]))
                    size += lengths[-1]
                    if size >= chunk:
                        yield flush()
        if docs:
            yield flush()

    return task


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, bits: bool = False, chunk: int = CHUNK_IDS, path: str | None = None) -> DataFrame:
    """Encode texts, write them in ascending doc_id order as Parquet files, and return the files' chunks.

    docs: doc_id (integer), text, others ignored; null and empty texts have the end id alone; texts may be of any length;
    null doc_ids come first; rows of one doc_id stand together, in the order of a hash of their texts; an empty table gives
    no chunks. Shards are ranges of doc_id. A row of the files is a chunk of whole documents: shard, first (ids of the shard
    before it), n_ids, doc_ids and lengths (the chunk index: columns that Parquet reads without the planes), planes. path:
    where to write; else a new folder in the shared checkpoint folder.
    """
    spark = docs.sparkSession
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    chunks = df.mapInArrow(_write_task(tokenizer, end_id, bits, chunk), SCHEMA)
    if path is None:
        graph.shared_folder(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/token-ids-{uuid.uuid4().hex}"
    chunks.write.option("compression", "none").parquet(path)  # the planes are compressed already
    return spark.read.schema(SCHEMA).parquet(path)


def _read_task(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes(row["planes"], row["n_ids"])
            start = row["base"] + row["first"]
            out: dict[str, list] = {"doc_id": row["doc_ids"], "start": [], "n_tokens": row["lengths"], "ids_crc32": []}
            at = 0
            for n in row["lengths"]:
                out["start"].append(start + at)
                out["ids_crc32"].append(zlib.crc32(ids[at : at + n].tobytes()))
                at += n
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def read_index(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the planes read back.

    The ids before a shard are sums over the chunk index: a row for each shard, which are as many as range partitions."""
    total, rows = 0, []
    for shard, n in sorted((r[0], r[1]) for r in chunks.groupBy("shard").agg(F.sum("n_ids")).collect()):
        rows.append((shard, total))
        total += n
    base = chunks.sparkSession.createDataFrame(rows, "shard int, base long")
    return chunks.join(F.broadcast(base) if len(rows) <= 100_000 else base, "shard").select("first", "n_ids", "doc_ids", "lengths", "planes", "base").mapInArrow(
        _read_task, "doc_id long, start long, n_tokens long, ids_crc32 long",
    )


def _ids_task(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids, at, out = from_planes(row["planes"], row["n_ids"]), 0, []
            for n in row["lengths"]:
                out.append(ids[at : at + n].astype(np.int64))
                at += n
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array(out, pa.list_(pa.int64()))})


def read_ids(chunks: DataFrame) -> DataFrame:
    """doc_id and ids of every stored document."""
    return chunks.select("n_ids", "doc_ids", "lengths", "planes").mapInArrow(_ids_task, "doc_id long, ids array<long>")
