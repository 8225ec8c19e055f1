"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME`` bytes, each with the number of units and of code points up to its
end. A cut after u units is found by a binary search of those counts: only the frame that holds it is decompressed. The output is a
list of frames again: whole frames are taken over as they are, the two cut ones are split, marks are frames of their own. Digests
stream the frames in order, one in memory at a time, and the text is rebuilt from output and form in the same way.

A unit is a word with the blanks before it, or the blanks that end the text. Marks that a text holds itself would make the output
ambiguous: such a text stays plain.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from caselens.functions.scratch import written
from caselens.llm import words as W

#: Bytes of text in a frame.
FRAME = 1 << 15
#: Bytes of frames that are handed on at a time.
HELD = 1 << 23
PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
#: Order of the parts behind their marks, by form.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

STORED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))])
TURNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])
DIGEST = pa.schema([*list(TURNED)[:5], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.list_(pa.binary()): "array<binary>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def packed(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, each ended once its ``size``-th column (frames) has ``HELD`` bytes."""
    held, some = 0, []
    for row in rows:
        some.append(row)
        held += sum(map(len, row[size])) + 64
        if held >= HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            held, some = 0, []
    columns = zip(*some, strict=True) if some else [()] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte offset behind each unit of a text."""
    if not len(data):
        return np.zeros(0, np.int64)
    blank = W.BLANK[data]
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(data))


def frame_bounds(data: np.ndarray, size: int) -> list[int]:
    """Ends of frames of about ``size`` bytes, none inside a code point."""
    bounds = list(range(size, len(data), size)) + [len(data)] if len(data) else []
    for k, at in enumerate(bounds[:-1]):
        while data[at] & 0xC0 == 0x80:
            at -= 1
        bounds[k] = at
    return sorted({b for b in bounds if b > 0})


def compressed(text: bytes, zip_: zstandard.ZstdCompressor, size: int = FRAME) -> tuple[list[bytes], list[int], list[int]]:
    """Frames of a text, and units and code points up to the end of each."""
    data = np.frombuffer(text, np.uint8)
    bounds = frame_bounds(data, size)
    frames = [zip_.compress(text[a:b]) for a, b in zip([0, *bounds], bounds, strict=False)]
    heads = np.cumsum((data & 0xC0) != 0x80)
    return frames, np.searchsorted(unit_ends(data), bounds, side="right").tolist(), [int(heads[b - 1]) for b in bounds]


def store(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """doc_id, n (units), marked (holds a mark), frames, units, chars (cumulative counts) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    frames, units, chars = compressed(raw, zip_, size)
                    yield doc_id, units[-1] if units else 0, any(m in raw for m in MARKS), frames, units, chars

        yield from packed(rows(), STORED, 3)

    return docs.select("doc_id", "text").mapInArrow(run, ddl(STORED))


def streamed(frames: list[bytes], start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """The bytes from start to stop, a frame at a time; frames outside are skipped by the size in their head."""
    unzip, at = zstandard.ZstdDecompressor(), 0
    for frame in frames:
        size = zstandard.frame_content_size(frame)
        if at + size > start and (stop is None or at < stop) and size:
            yield unzip.decompress(frame)[max(0, start - at) : None if stop is None else stop - at]
        at += size


def cut_place(frames: list[bytes], units: list[int], chars: list[int], u: int) -> tuple[int, int, int]:
    """(frame, byte in it, code points before) of the cut after u units; only the frame that holds it is decompressed."""
    if u == 0:
        return 0, 0, 0
    k = bisect_left(units, u)
    before, passed = (units[k - 1], chars[k - 1]) if k else (0, 0)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(frames[k]), np.uint8)
    ends = unit_ends(data)
    # a unit that ends with the frame ends behind all others of it
    at = int(ends[min(u - before, len(ends)) - 1])
    return k, at, passed + int(np.count_nonzero((data[:at] & 0xC0) != 0x80))


def span(frames: list[bytes], start: tuple[int, int, int], stop: tuple[int, int, int] | None, zip_: zstandard.ZstdCompressor) -> list[bytes]:
    """Frames of what lies between two cuts: whole frames as they are, parts of cut frames compressed anew."""
    first, a = start[:2]
    last, b = stop[:2] if stop else (len(frames), 0)
    out = []
    for k in range(first, min(last + 1, len(frames))):
        left, right = a if k == first else 0, b if k == last else None
        if left == 0 and right is None:
            out.append(frames[k])
        elif right is None or left < right:
            if part := zstandard.ZstdDecompressor().decompress(frames[k])[left:right]:
                out.append(zip_.compress(part))
    return out


def turn(doc_id: int | None, n: int, marked: bool, frames: list, units: list, chars: list, zip_: zstandard.ZstdCompressor, seed: int, rate: int, spm: int) -> tuple:
    """A row of ``transform``."""
    key = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(key[i : i + 8], 16) for i in range(0, 32, 8))
    if n == 0 or marked or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, frames
    one, two = (cut_place(frames, units, chars, u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    parts = {PREFIX: span(frames, (0, 0, 0), one, zip_), MIDDLE: span(frames, one, two, zip_), SUFFIX: span(frames, two, None, zip_)}
    form = "spm" if h4 % 100 < spm else "psm"
    output = [frame for mark in ORDER[form] for frame in (zip_.compress(mark), *parts[mark])]
    return doc_id, n, form, one[2], two[2] - one[2], output


def mark_places(output: list[bytes]) -> dict[bytes, int]:
    """Byte offset of each mark in an output; it is found even where it lies in two frames."""
    places: dict[bytes, int] = {}
    at, tail = 0, b""
    for part in streamed(output):
        window = tail + part
        for mark in MARKS:
            if mark not in places and (k := window.find(mark)) >= 0:
                places[mark] = at - len(tail) + k
        at, tail = at + len(part), window[-2:]
    return places


def rebuilt(output: list[bytes], form: str) -> Iterator[bytes]:
    """The text, a frame at a time, from output and form alone."""
    if form == "plain":
        yield from streamed(output)
        return
    places = mark_places(output)
    ordered = ORDER[form]
    stops = {mark: places.get(after) for mark, after in zip(ordered, [*ordered[1:], None], strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from streamed(output, places[mark] + len(mark), stops[mark])


def sha256(parts: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def _turned(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm: int) -> Iterator[tuple]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for i in range(batch.num_rows):
            yield turn(*(batch.column(name)[i].as_py() for name in STORED.names), zip_, seed, rate, spm)


def transform(stored: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (frames) of every row of ``store``.

    ``rate`` percent of the texts are turned, ``spm`` percent of these with the suffix first; empty texts and texts with a mark stay
    plain. Seed and doc_id decide alone, so a repeated row gives repeated rows; a null doc_id counts as empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(_turned(batches, seed, rate, spm), TURNED, 5)

    return stored.select(*STORED.names).mapInArrow(run, ddl(TURNED))


def texts(turned: DataFrame) -> DataFrame:
    """doc_id, form, output (text), restored (text) of every row of ``transform``."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string()), ("restored", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, form, output in zip(*(batch.column(c) for c in ("doc_id", "form", "output")), strict=True):
                    frames = output.as_py()
                    yield doc_id.as_py(), form.as_py(), b"".join(streamed(frames)).decode(), b"".join(rebuilt(frames, form.as_py())).decode()

        yield from packed(rows(), schema, 2)

    return turned.mapInArrow(run, "doc_id long, form string, output string, restored string")


def digests(stored: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``transform`` with the SHA-256 of the output and of the text rebuilt from it, in place of the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row in _turned(batches, seed, rate, spm):
                yield *row[:5], sha256(streamed(row[5])), sha256(rebuilt(row[5], row[2]))

        yield from packed(rows(), DIGEST, 5)

    return stored.select(*STORED.names).mapInArrow(run, ddl(DIGEST))


def fill_in_middle(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Store the frames as a table in the shared folder, then cut and digest from them; other columns are not read."""
    return digests(written(store(docs), "frames"), seed)
