"""Media columns in Ogg: pages with checksums, lacing, logical streams and granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The payload's samples are unsigned 8-bit values, so many each second.
RATE = 8000
UNIT = 192
#: Samples of a packet; a packet's stream has a second stream beside it that holds each packet's peak.
PACKET = 4096
HEAD = b"\x80raw8\x00"
INDEX = b"\x80peak\x00"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, highest bit first, from 0. It is zlib's with all bits in reverse order."""
    x = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{x:032b}"[::-1], 2)


class StreamWriter:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number, self.pages = serial, 0, []

    def page(self, lacing: bytes, body: bytes, granule: int, flags: int) -> None:
        head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, self.serial, self.number, 0) + bytes([len(lacing)]) + lacing
        crc = page_crc(head + body)
        self.pages.append(head[:22] + struct.pack("<I", crc) + head[26:] + body)
        self.number += 1

    def packets(self, packets: list[tuple[bytes, int]], most: int = 255) -> None:
        """Write packets (data, granule at the packet's end): pages of up to `most` segments; a packet may span pages."""
        lacing, body, granule, begun = bytearray(), bytearray(), -1, False
        for i, (data, at) in enumerate(packets):
            last = i == len(packets) - 1
            sizes = [255] * (len(data) // 255) + [len(data) % 255]
            pos = 0
            for j, size in enumerate(sizes):
                if len(lacing) == most:
                    self.page(bytes(lacing), bytes(body), granule, (1 if begun else 0) | (2 if self.number == 0 else 0))
                    begun, granule = j > 0, -1
                    lacing.clear(), body.clear()
                lacing.append(size)
                body += data[pos : pos + size]
                pos += size
            granule = at
            if last or self.number == 0:  # the header packet has a page of its own
                self.page(bytes(lacing), bytes(body), granule, (1 if begun else 0) | (2 if self.number == 0 else 0) | (4 if last else 0))
                begun, granule = False, -1
                lacing.clear(), body.clear()


def encode(samples: bytes) -> bytes:
    """An Ogg file of two logical streams: the samples in packets, and the peak of each packet. Pages alternate."""
    a, b = StreamWriter(1), StreamWriter(2)
    cut = [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
    head = HEAD + struct.pack("<IQ", RATE, len(samples))
    ends = np.minimum(np.arange(1, len(cut) + 1) * PACKET, len(samples)).tolist()
    a.packets([(head, 0), *zip(cut, ends, strict=True)])
    b.packets([(INDEX, 0), *((bytes([max(c)]), e) for c, e in zip(cut, ends, strict=True))])
    out = [a.pages[0], b.pages[0]]
    for i in range(1, max(len(a.pages), len(b.pages))):
        out += a.pages[i : i + 1] + b.pages[i : i + 1]
    return b"".join(out)


class OggError(ValueError):
    """Data that is not a whole Ogg file."""


def demux(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets (data, granule of the page that ends the packet; -1 where another packet ends later on that page) by stream.

    Checks the capture pattern, version, checksum, page order, continuation flags and each stream's first and last page."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    state: dict[int, list] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or len(data) < at + 27:
            raise OggError(f"no page at byte {at}")
        version, flags, granule, serial, number, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        size = sum(lacing)
        if version or len(lacing) < n or len(data) < body + size:
            raise OggError(f"a broken page at byte {at}")
        page = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : body + size]
        if page_crc(page) != crc:
            raise OggError(f"a wrong checksum at byte {at}")
        if serial not in state:
            if not flags & 2:
                raise OggError(f"stream {serial} has no first page")
            state[serial], streams[serial] = [0, b"", False], []
        s = state[serial]
        if s[2] or number != s[0] or bool(flags & 1) != (s[1] != b"" or s[0] > 0 and s[3:] == [True]):
            raise OggError(f"a page of stream {serial} is out of order")
        s[0] += 1
        ends = [i for i, x in enumerate(lacing) if x < 255]
        pos, part, first = body, [s[1]], 0
        for i in ends:
            length = sum(lacing[first : i + 1])
            part.append(data[pos : pos + length])
            streams[serial].append((b"".join(part), granule if i == ends[-1] else -1))
            pos, part, first = pos + length, [], i + 1
        rest = data[pos : body + size]
        open_ = first < n
        s[1] = b"".join([*part, rest]) if open_ or not ends else b""
        s[3:] = [open_]
        s[2] = bool(flags & 4)
        at = body + size
    for serial, s in state.items():
        if not s[2] or s[3:] == [True]:
            raise OggError(f"stream {serial} has no last page")
    return streams


def packet_ends(packets: list[tuple[bytes, int]]) -> tuple[list[int], int, int]:
    """End of every packet in samples, how many ends a granule position gave, and by how much those were off in all.

    A page's granule position is the end of the last packet that ends on it; the packets before have theirs by their lengths."""
    ends, at, marks, off = [], 0, 0, 0
    for data, granule in packets:
        at += len(data)
        if granule >= 0:
            off += abs(granule - at)
            at = granule
            marks += 1
        ends.append(at)
    return ends, marks, off


def decode(data: bytes) -> tuple[bytes, dict]:
    """The samples and features: streams, packets, marks (granule positions), gap (samples by which they are off), ms (the
    last packet's timestamp), mid (that of the packet in the middle), sum, peak and crossings of the samples."""
    streams = demux(data)
    main = next((k for k, p in streams.items() if p and p[0][0].startswith(HEAD)), None)
    if main is None:
        raise OggError("no sample stream")
    packets = streams[main]
    rate, total = struct.unpack_from("<IQ", packets[0][0], len(HEAD))
    samples = b"".join(p for p, _ in packets[1:])
    ends, marks, gap = packet_ends(packets[1:])
    if len(samples) != total or gap or ends[-1:] != [total][: len(ends)]:
        raise OggError("samples are missing")
    x = np.frombuffer(samples, np.uint8)
    above = x >= 128
    peaks = [max(p) for s, ps in streams.items() if s != main for p, _ in ps[1:]]
    ms = [e * 1000 // rate for e in ends] or [0]
    return samples, {
        "streams": len(streams), "packets": len(packets) - 1, "marks": marks, "gap": gap, "ms": ms[-1], "mid": ms[len(ms) // 2],
        "sum": int(x.sum(dtype=np.int64)), "peak": max(peaks, default=0), "crossings": int((above[1:] != above[:-1]).sum()),
    }


def padded(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of 192 bytes."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _encode_task(batches):
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        for i in range(0, len(raw), 256):
            part = raw[i : i + 256]
            yield pa.record_batch(
                [
                    batch.column(0).slice(i, 256), pa.array([len(x) for x in part], pa.int64()),
                    pa.array([encode(padded(x)) for x in part], pa.large_binary()),
                ],
                names=["doc_id", "n_bytes", "media"],
            )


def text_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (UTF-8, unpadded) and media (Ogg of the padded text) of every row.

    docs: doc_id, text, others ignored. A null text is empty; texts may be of any length; repeated rows are treated alike;
    an empty table gives none."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(_encode_task, "doc_id long, n_bytes long, media binary")


FEATURE = "streams={streams} packets={packets} marks={marks} gap={gap} ms={ms} mid={mid} sum={sum} peak={peak} crossings={crossings}"


def _features_task(batches):
    for batch in batches:
        media = batch.column(2).to_pylist()
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m in media:
            if m is None:
                for v in out.values():
                    v.append(None)
                continue
            samples, f = decode(m)
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-16:]))
            out["media_bytes"].append(len(m))
            out["media_sha256"].append(hashlib.sha256(m).hexdigest())
            out["feature"].append(FEATURE.format(**f))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]],
            names=["doc_id", "n_bytes", *out],
        )


def media_features(media: DataFrame) -> DataFrame:
    """Features of Ogg media read from a column `media` (with doc_id, n_bytes); null media give nulls; broken media raise."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _features_task,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
