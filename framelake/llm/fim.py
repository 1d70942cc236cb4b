"""Fill-in-middle: documents as piece tables, whose descriptors are cut and permuted while the texts stay as they are."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.words import buffer_of

#: Sentinels before the prefix, the suffix and the middle (fixed values).
SENTINELS = ("<P>", "<S>", "<M>")
#: Buffers that descriptors name: the document's text, and the sentinels by what they stand before.
TEXT, PREFIX, SUFFIX, MIDDLE = 0, 1, 2, 3
#: The order of a form's pieces in terms of prefix, middle, suffix (places 0, 1, 2), each behind its sentinel or bare.
ARRANGEMENTS = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
#: Output rows are sent on in batches of about so many bytes.
BATCH_BYTES = 8 << 20

PIECES = "array<struct<buffer: int, start: long, length: long>>"
_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_ARRANGED = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("pieces", _PIECES), ("output", pa.large_string()), ("output_sha256", pa.string()),
])

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same contents with a boundary after their first `at` bytes: at most one descriptor is split in two."""
    out, left = [], at
    for buffer, start, length in pieces:
        if 0 < left < length:
            out += [(buffer, start, left), (buffer, start + left, length - left)]
        else:
            out.append((buffer, start, length))
        left -= length
    return out


def thirds(length: int, a: int, b: int) -> list[Piece]:
    """The descriptor of a whole text cut after a and after b bytes; always three, empty ones included."""
    whole = cut(cut([(TEXT, 0, length)], a), b)
    ends = {start: (buffer, start, size) for buffer, start, size in whole if size}
    return [ends.get(start, (TEXT, start, 0)) if size else (TEXT, start, 0) for start, size in ((0, a), (a, b - a), (b, length - b))]


def arrange(parts: list[Piece], form: str, sizes: tuple[int, int, int]) -> list[Piece]:
    """Descriptors of a form from those of prefix, middle and suffix, with those of the sentinels (of the sizes) between."""
    out: list[Piece] = []
    for place, sentinel in ARRANGEMENTS[form]:
        out += [(sentinel, 0, sizes[sentinel - 1]), parts[place]]
    return out


def find_parts(output: bytes, form: str, sentinels: tuple[bytes, ...]) -> list[Piece]:
    """Descriptors, over an output, of its prefix, middle and suffix: sentinels are found and their order is undone."""
    order = ARRANGEMENTS[form]
    at, places = 0, []
    for _, sentinel in order:
        mark = sentinels[sentinel - 1]
        found = output.find(mark, at)
        if found < 0:
            raise ValueError(f"a sentinel is missing in an output of form {form}")
        places.append((found, found + len(mark)))
        at = found + len(mark)
    if places[0][0]:
        raise ValueError(f"an output of form {form} doesn't begin with its sentinel")
    ends = [p[0] for p in places[1:]] + [len(output)]
    parts: list[Piece] = [(TEXT, 0, 0)] * 3
    for (place, _), (_, begin), end in zip(order, places, ends, strict=True):
        parts[place] = (TEXT, begin, end - begin)
    return parts


def stream(pieces: list[Piece], buffers: tuple) -> list[memoryview]:
    """The contents, piece by piece, without copying any."""
    return [memoryview(buffers[b])[start : start + length] for b, start, length in pieces if length]


def digest(chunks: list[memoryview]) -> str:
    h = hashlib.sha256()
    for c in chunks:
        h.update(c)
    return h.hexdigest()


def check_sentinels(sentinels: tuple[str, str, str]) -> tuple[bytes, ...]:
    """Sentinels as UTF-8. They can be told apart from texts without them only if none holds another and no end of one begins one."""
    marks = tuple(s.encode() for s in sentinels)
    inside = any(i != j and a in b for i, a in enumerate(marks) for j, b in enumerate(marks))
    overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a is not b)) if k < max(len(a), len(b)))
    if len(marks) != 3 or not all(marks) or inside or overlap:
        raise ValueError("sentinels are three texts of which none is empty, holds another, or ends as one begins")
    return marks


def _draws(doc_id: int | None, seed: int) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in range(0, 32, 8)]


def _line_ends(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (in the buffer) of the lines of all texts, and n+1 offsets into them by text. A last line may lack its \\n."""
    ends = np.flatnonzero(raw == 10) + 1
    has = np.diff(off) > 0
    open_ = off[1:][has]
    open_ = open_[raw[open_ - 1] != 10]
    ends = np.sort(np.concatenate((ends, open_)))
    return ends, np.searchsorted(ends, off, "right")


def _arrange_task(seed: int, rate: int, spm_rate: int, sentinels: tuple[bytes, ...], texts: bool):
    sizes = tuple(map(len, sentinels))

    def rows(batch: pa.RecordBatch):
        raw, off = buffer_of(batch.column(1))
        data = memoryview(raw)
        ends, first = _line_ends(raw, off)
        # code points before each byte of the batch would take 8 bytes a byte; those of the parts are counted when needed
        chars = lambda a, b: int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            a, z = int(off[i]), int(off[i + 1])
            n = int(first[i + 1] - first[i])
            text = bytes(data[a:z])
            h1, h2, h3, h4 = _draws(doc_id, seed)
            if a == z or h3 % 100 >= rate or any(m in text for m in sentinels):
                form, parts, pieces = "plain", None, [(TEXT, 0, z - a)]
            else:
                form = "spm" if h4 % 100 < spm_rate else "psm"
                places = sorted((h1 % (n + 1), h2 % (n + 1)))
                b, c = (int(ends[first[i] + k - 1]) - a if k else 0 for k in places)
                parts = thirds(z - a, b, c)
                pieces = arrange(parts, form, sizes)
            chunks = stream(pieces, (text, *sentinels))
            counts = (None, None) if parts is None else (chars(a, a + parts[0][2]), chars(a + parts[1][1], a + parts[1][1] + parts[1][2]))
            said = [dict(zip(("buffer", "start", "length"), p, strict=True)) for p in pieces]
            yield (doc_id, n, form, *counts, said, b"".join(chunks) if texts else None, digest(chunks))

    def task(batches):
        for batch in batches:
            held, size = [], 0
            for row in rows(batch):
                held.append(row)
                size += len(row[6] or b"") + 200
                if size > BATCH_BYTES:
                    yield _batch(held, _ARRANGED)
                    held, size = [], 0
            if held:
                yield _batch(held, _ARRANGED)

    return task


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = []
    for field, values in zip(schema, zip(*rows, strict=True), strict=True):
        kind = pa.large_binary() if field.type == pa.large_string() else field.type
        columns.append(pa.array(values, kind).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def fill_in_middle(
    docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS,
    texts: bool = True,
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, pieces, output and output_sha256 of every row of docs (doc_id, text).

    A text's n lines are cut at two places drawn from the SHA-256 of seed and doc_id into prefix, middle and suffix; rate
    percent of the texts take the form psm or (spm_rate percent of these) spm. pieces is the piece table: descriptors
    (buffer, start and length in UTF-8 bytes) over the text (buffer 0) and the sentinels (1 to 3), from which the output is
    read and hashed piece by piece; texts=False leaves the output null.

    Empty texts, texts that hold a sentinel and texts that aren't drawn stay as they are: form plain, null counts. Null texts
    count as empty ones, a null doc_id as no digits. Repeated rows give repeated rows, an empty table none; other columns are
    not read. Narrow: no shuffle, and a task holds one Arrow batch and its outputs of about 8 MB, or one text."""
    marks = check_sentinels(sentinels)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"doc_id long, n long, form string, prefix_chars long, middle_chars long, pieces {PIECES}, output string, output_sha256 string"
    return given.mapInArrow(_arrange_task(seed, rate, spm_rate, marks, texts), schema)


_RESTORED = pa.schema([("restored", pa.large_string()), ("restored_sha256", pa.string())])


def restore(arranged: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, texts: bool = True) -> DataFrame:
    """arranged (form, output and any others) with restored and restored_sha256: the text from its output and form alone.

    Sentinels are looked up in the output; the inverse permutation of the form puts prefix, middle and suffix back in order.
    A null output counts as an empty one; a form that is none, or an output without its sentinels, raises. texts=False leaves
    restored null. Columns of arranged of the two new names are replaced."""
    marks = check_sentinels(sentinels)
    kept = [c for c in arranged.columns if c.lower() not in ("restored", "restored_sha256")]
    names = {c: i for i, c in enumerate(kept)}

    def task(batches):
        for batch in batches:
            forms = batch.column(names["form"]).to_pylist()
            raw, off = buffer_of(batch.column(names["output"]))
            a = 0
            while a < len(forms):
                b = max(a + 1, int(np.searchsorted(off, off[a] + BATCH_BYTES, "right")) - 1)
                rows = []
                for i in range(a, b):
                    output = bytes(memoryview(raw)[off[i] : off[i + 1]])
                    if forms[i] != "plain" and forms[i] not in ARRANGEMENTS:
                        raise ValueError(f"unknown form {forms[i]!r}")
                    pieces = [(TEXT, 0, len(output))] if forms[i] == "plain" else find_parts(output, forms[i], marks)
                    chunks = stream(pieces, (output,))
                    rows.append((b"".join(chunks) if texts else None, digest(chunks)))
                made = _batch(rows, _RESTORED)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *made.columns], names=[*kept, *_RESTORED.names])
                a = b

    from pyspark.sql.types import StringType, StructType

    schema = StructType([arranged.schema[c] for c in kept]).add("restored", StringType()).add("restored_sha256", StringType())
    return arranged.select(*kept).mapInArrow(task, schema)
